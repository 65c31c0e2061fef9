"""Partitioned dimensions and facts: rows dealt to parts by a number made of their keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from loomhouse.plans.store import staged
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import Mapped, mapped, own


class BasePartitioner:
    """Parts that are used in turn; `part(df)` is the Column that says which part a row goes to."""

    def __init__(self, parts: Sequence[Any]):
        self.parts = list(parts)

    def addpart(self, part: Any) -> None:
        self.parts.append(part)

    def droppart(self, part: Any = None) -> None:
        """Drop a part, the first if none is named."""
        if part is None:
            self.parts.pop(0)
        else:
            self.parts.remove(part)

    def part(self, df: DataFrame, namemapping: Mapped = None) -> Column:
        return F.pmod(F.xxhash64(*[own(c) for c in df.columns]), F.lit(len(self.parts))).cast("int")

    def getpart(self, df: DataFrame, namemapping: Mapped = None, into: str = "part") -> DataFrame:
        return df.withColumn(into, self.part(df, namemapping))

    def _each(self, df: DataFrame, namemapping: Mapped, do: Callable[[Any, DataFrame], DataFrame | None]) -> list[DataFrame]:
        if len(self.parts) == 1:
            return [out] if (out := do(self.parts[0], df)) is not None else []
        dealt = staged(self.getpart(df, namemapping, "_part"), "parts", by="_part")  # the rows are made once, and each part reads its own
        return [out for k, p in enumerate(self.parts) if (out := do(p, dealt.where(own("_part") == k).drop("_part"))) is not None]

    def endload(self) -> None:
        for p in self.parts:
            p.endload()


class DimensionPartitioner(BasePartitioner):
    """Dimensions with one shape, dealt by a hash of the business key, or by partitioner(df) -> Column of whole numbers."""

    def __init__(self, parts: Sequence[Any], getbyvalsfromall: bool = False, partitioner: Callable[[DataFrame], Column] | None = None):
        super().__init__(parts)
        self.getbyvalsfromall, self.partitioner = getbyvalsfromall, partitioner

    def part(self, df: DataFrame, namemapping: Mapped = None) -> Column:
        number = self.partitioner(df) if self.partitioner else F.xxhash64(*[own(mapped(a, namemapping)) for a in self.parts[0].lookupatts])
        return F.pmod(number, F.lit(len(self.parts))).cast("int")

    @property
    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.table for p in self.parts])

    def lookup(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.lookup(d, namemapping, into)))

    def ensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.ensure(d, namemapping, into)))

    def insert(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.insert(d, namemapping, into)))

    def scdensure(self, df: DataFrame, namemapping: Mapped = None, into: str | None = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.scdensure(d, namemapping, into)))

    def getbykey(self, keys: Any) -> DataFrame:
        """Members of any part; keys must be unique over all parts."""
        found = reduce(DataFrame.unionByName, [p.getbykey(keys) for p in self.parts])
        return found.where(own(self.parts[0].key).isNotNull())

    def getbyvals(self, values: Mapping[str, Any], namemapping: Mapped = None) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.getbyvals(values, namemapping) for p in self.parts])

    def update(self, df: DataFrame, namemapping: Mapped = None) -> None:
        for p in self.parts:
            p.update(df, namemapping)


class FactTablePartitioner(BasePartitioner):
    """Fact tables with one shape, dealt by the sum of their keyrefs, or by partitioner(df) -> Column."""

    def __init__(self, parts: Sequence[Any], partitioner: Callable[[DataFrame], Column] | None = None):
        super().__init__(parts)
        self.partitioner = partitioner

    def part(self, df: DataFrame, namemapping: Mapped = None) -> Column:
        number = self.partitioner(df) if self.partitioner else reduce(lambda a, b: a + b, [own(mapped(k, namemapping)) for k in self.parts[0].keyrefs])
        return F.pmod(number, F.lit(len(self.parts))).cast("int")

    @property
    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.table for p in self.parts])

    def insert(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.insert(d, namemapping)))

    def lookup(self, df: DataFrame, namemapping: Mapped = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.lookup(d, namemapping)))

    def ensure(self, df: DataFrame, compare: bool = False, namemapping: Mapped = None) -> DataFrame:
        return reduce(DataFrame.unionByName, self._each(df, namemapping, lambda p, d: p.ensure(d, compare, namemapping)))
