"""Snowflaked dimensions: a tree of dimensions, ensured from the leaves to the root."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dimension import Dimension
from .matching import Mapped, mapped, own, prefixed


class SnowflakedDimension:
    """references: (dimension, the dimensions it refers to) pairs; the first is the root.

    A foreign key has the name of the referenced dimension's key.
    """

    def __init__(self, references: Sequence[tuple[Dimension, Dimension | Sequence[Dimension]]], expectboguskeyvalues: bool = False):
        pairs = [(d, [r] if isinstance(r, Dimension) else list(r)) for d, r in references]
        if not pairs:
            raise ValueError("references are needed")
        self.root = pairs[0][0]
        self.refs: dict[Dimension, list[Dimension]] = {}
        for d, some in pairs:
            self.refs.setdefault(d, []).extend(some)
        self.levels: list[Dimension] = []  # root first, every level before those it refers to
        ahead = [self.root]
        while ahead:
            one = ahead.pop(0)
            if one in self.levels:
                raise ValueError("the references form no tree")
            self.levels.append(one)
            ahead += self.refs.get(one, [])
        if set(self.refs) - set(self.levels):
            raise ValueError("a dimension cannot be reached from the root")
        for d, some in self.refs.items():
            for r in some:
                if r.key not in d.attributes:
                    raise ValueError(f"{d.name} has no reference to {r.name}")
        shared = [r.key for some in self.refs.values() for r in some]
        names = [a for d in self.levels for a in d.all if a not in shared or a == d.key]
        if len(set(names)) < len(names):
            raise ValueError("attribute names must be unique")
        if len({id(d.targetconnection) for d in self.levels}) > 1:
            raise ValueError("all levels must be in one warehouse")
        self.name, self.key = self.root.name, self.root.key
        self.expectboguskeyvalues = expectboguskeyvalues

    @property
    def table(self) -> DataFrame:
        """All levels joined, along the tree."""
        out = self.root.table.select(*self.root.all)
        for d in self.levels:
            for r in self.refs.get(d, []):
                right = prefixed(r.table.select(*r.all), "_r_")
                joined = out.join(right, own(r.key) == own(f"_r_{r.key}"), "left")
                out = joined.select(*[own(c) for c in out.columns], *[own(f"_r_{a}").alias(a) for a in r.attributes])
        return out

    def lookup(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        return self.root.lookup(df, namemapping, into)

    def lookuprow(self, df: DataFrame, namemapping: Mapped = None, fullrow: bool = False) -> DataFrame:
        found = self.root.lookuprow(df, namemapping)
        return self._whole(found) if fullrow else found

    def _whole(self, found: DataFrame) -> DataFrame:
        keys = found.select(own(self.key).alias("_asked"))
        whole = prefixed(self.table, "_w_")
        return keys.join(whole, own("_asked") == own(f"_w_{self.key}"), "left").select(*[own(c).alias(c[3:]) for c in whole.columns])

    def getbykey(self, keys: Any, fullrow: bool = False) -> DataFrame:
        found = self.root.getbykey(keys)
        return self._whole(found) if fullrow else found

    def getbyvals(self, values: Mapping[str, Any], namemapping: Mapped = None, fullrow: bool = False) -> DataFrame:
        """Root members, or joined rows, equal on the attributes given; those of any level may be."""
        out = self.table
        names = [c for c in out.columns if mapped(c, namemapping) in values]
        if not names:
            raise ValueError("no attribute to search by")
        for c in names:
            out = out.where(own(c).eqNullSafe(F.lit(values[mapped(c, namemapping)])))
        return out if fullrow else out.select(*self.root.all)

    def update(self, df: DataFrame, namemapping: Mapped = None) -> None:
        """Update every level whose key the rows have, the outermost first."""
        for d in reversed(self.levels):
            if mapped(d.key, namemapping) in df.columns:
                d.update(df, namemapping)

    def _ensure_below(self, d: Dimension, df: DataFrame, namemapping: Mapped) -> DataFrame:
        """The rows with the keys of all levels that d refers to, after those levels have been ensured."""
        for r in self.refs.get(d, []):
            df = self._ensure_below(r, df, namemapping)
            df = r.ensure(df, namemapping)
        return df

    def ensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """The rows with their root members' keys.  Only rows whose root member is absent touch the other levels,

        unless the root's business key holds a reference, which then has to be found first.
        """
        into = into or mapped(self.key, namemapping)
        shared = [r.key for r in self.refs.get(self.root, [])]
        if set(self.root.lookupatts) & set(shared):
            return self.root.ensure(self._ensure_below(self.root, df, namemapping), namemapping, into)
        firsts = self._absent(df, namemapping)
        filled = self._ensure_below(self.root, firsts, namemapping)
        self.root.ensure(filled, namemapping)
        return self.root.lookup(df, namemapping, into)

    def _absent(self, df: DataFrame, namemapping: Mapped) -> DataFrame:
        """The first row of each absent root member, with all its columns."""
        members = prefixed(self.root._current(), "_m_")
        absent = df.join(members, self.root._on(df, namemapping, "_m_"), "left_anti")
        order = F.struct(*[own(c) for c in self.root._order(df)], *[own(c) for c in df.columns])
        keys = [own(mapped(a, namemapping)).alias(f"_k_{n}") for n, a in enumerate(self.root.lookupatts)]
        return absent.groupBy(*keys).agg(F.min_by(F.struct(*[own(c) for c in df.columns]), order).alias("_row")).select("_row.*")

    def insert(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        """As ensure; raises if a row's member is there in all levels already."""
        if not df.join(prefixed(self.root._current(), "_m_"), self.root._on(df, namemapping, "_m_"), "left_semi").isEmpty():
            raise ValueError("a member is there already")
        return self.ensure(df, namemapping)

    def scdensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        """Ensure the levels below the root, then the root's versions."""
        return self.root.scdensure(self._ensure_below(self.root, df, namemapping), namemapping, into)

    def endload(self) -> None:
        for d in reversed(self.levels):
            d.endload()
