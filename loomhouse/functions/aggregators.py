"""Aggregators: objects that make an aggregate Column of a value Column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregator:
    """What a grouping operator needs: `column(value)`, an aggregate expression, and a default for empty groups."""

    def column(self, value: Column) -> Column:
        raise NotImplementedError

    def finish(self, value: Column, default: Any = None) -> Column:
        out = self.column(value)
        return out if default is None else F.coalesce(out, F.lit(default))


class Sum(Aggregator):
    def column(self, value: Column) -> Column:
        return F.sum(value)


class Count(Aggregator):
    """Counts every value, null too."""

    def column(self, value: Column) -> Column:
        return F.count(F.lit(1))


class CountDistinct(Aggregator):
    """Null counts as a value."""

    def column(self, value: Column) -> Column:
        return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("int")), F.lit(0))


class Max(Aggregator):
    def column(self, value: Column) -> Column:
        return F.max(value)


class Min(Aggregator):
    def column(self, value: Column) -> Column:
        return F.min(value)


class Avg(Aggregator):
    def column(self, value: Column) -> Column:
        return F.avg(value.cast("double"))


class Own(Aggregator):
    """An aggregator from any function of a Column to an aggregate Column (a grouped pandas UDF too)."""

    def __init__(self, make):
        self.make = make

    def column(self, value: Column) -> Column:
        return self.make(value)
