"""Functions of whole rows: which columns there are, and what they are called."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def _present(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such column: {', '.join(missing)}")


def project(df: DataFrame, atts: Sequence[str], renaming: Mapping[str, str] | None = None) -> DataFrame:
    """The columns `atts`; `renaming` gives the source's name of an attribute."""
    source = [(renaming or {}).get(a, a) for a in atts]
    _present(df, source)
    return df.select(*[named(s).alias(a) for s, a in zip(source, atts)])


def copy(df: DataFrame, **renaming: str) -> DataFrame:
    """A copy in which new=old renames; an old name may feed several new ones, and a new one wins over a column."""
    _present(df, list(renaming.values()))
    used = set(renaming.values())
    kept = [c for c in df.columns if c not in used and c not in renaming]
    return df.select(*[named(c) for c in kept], *[named(old).alias(new) for new, old in renaming.items()])


def renamefromto(df: DataFrame, renaming: Mapping[str, str]) -> DataFrame:
    """Rename {old: new}.  New names that are also old names would lose a value and are refused."""
    _present(df, list(renaming))
    if set(renaming) & set(renaming.values()) - {o for o, n in renaming.items() if o == n} or len(set(renaming.values())) < len(renaming):
        raise ValueError("overlapping renames")
    gone = set(renaming.values()) - set(renaming)
    return df.select(*[named(c).alias(renaming.get(c, c)) for c in df.columns if c not in gone])


rename = renamefromto


def renametofrom(df: DataFrame, renaming: Mapping[str, str]) -> DataFrame:
    """Rename {new: old}."""
    back: dict[str, str] = {}
    for new, old in renaming.items():
        if old in back:
            raise ValueError("one column cannot take two names")
        back[old] = new
    return renamefromto(df, back)


def getvalue(name: str, mapping: Mapping[str, str] | None = None) -> Column:
    return named((mapping or {}).get(name, name))


def getvalueor(df: DataFrame, name: str, mapping: Mapping[str, str] | None = None, default: Any = None) -> Column:
    """The column if there is one (its nulls stay), else the default."""
    own = (mapping or {}).get(name, name)
    return named(own) if own in df.columns else F.lit(default)


def setdefaults(df: DataFrame, attributes: Sequence, defaults: Sequence | None = None) -> DataFrame:
    """Add the attributes that are absent, from (name, default) pairs or two sequences of one length."""
    if defaults is None:
        pairs = [(a, d) for a, d in attributes]
    else:
        if len(attributes) != len(defaults):
            raise ValueError("as many defaults as attributes are needed")
        pairs = list(zip(attributes, defaults))
    new = {a: F.lit(d) for a, d in pairs if a not in df.columns}
    return df.withColumns(new) if new else df
