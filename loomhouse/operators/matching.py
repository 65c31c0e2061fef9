"""Joins on business keys, and the first or last row of each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapped = Mapping[str, str] | None


def own(name: str) -> Column:
    return F.col(f"`{name}`")


def mapped(att: str, namemapping: Mapped) -> str:
    return (namemapping or {}).get(att, att)


def require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such column: {', '.join(missing)}")


def same(pairs: Sequence[tuple[Column, Column]], null_safe: bool = True) -> Column:
    return reduce(lambda a, b: a & b, [(l.eqNullSafe(r) if null_safe else l == r) for l, r in pairs])


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[own(c).alias(prefix + c) for c in df.columns])


def extreme(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the order given, ties broken by all columns.

    An aggregate that is combined before the shuffle, so a hot key is one row for each task.
    """
    rest = [c for c in df.columns if c not in order_by]
    rank = F.struct(*[own(c) for c in order_by], *[own(c) for c in rest])
    row = F.struct(*[own(c) for c in df.columns])
    chosen = (F.max_by if last else F.min_by)(row, rank)
    return df.groupBy(*[own(k).alias(f"_k_{n}") for n, k in enumerate(keys)]).agg(chosen.alias("_row")).select("_row.*")
