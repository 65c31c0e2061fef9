"""Dense numbers for rows in order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from loomhouse.plans.store import staged
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import BITS, PLACE, RANGE, placed


def _columns(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_by]


def numbered(df: DataFrame, order_by: Sequence[str | Column], name: str, base: int = 0) -> DataFrame:
    """df with base + 1, base + 2, ... in the given order.

    Rows are dealt to ranges of the order and written with their range and their place in it, so
    both stay the same; a row's number is its place after the rows of the ranges before it, whose
    counts (one for each range) are all that the driver gets, and all that is sent to the tasks.
    """
    rows = placed(df, _columns(order_by), "numbered")
    counts = {r[0]: r[1] + 1 for r in rows.groupBy(RANGE).agg(F.max(PLACE)).collect()}
    if not counts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    met = rows.join(F.broadcast(_offsets(df, counts, base)), RANGE)
    return met.withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop(RANGE, PLACE, "_before")


def _offsets(df: DataFrame, counts: dict[int, int], base: int) -> DataFrame:
    """(range, rows of the ranges before it): one row for each range."""
    before, at = [], base
    for k in sorted(counts):
        before.append((k, at))
        at += counts[k]
    return df.sparkSession.createDataFrame(before, "_range int, _before bigint")


def highest(df: DataFrame, key: str) -> int:
    """The largest key, 0 without rows."""
    return int(df.agg(F.coalesce(F.max(f"`{key}`"), F.lit(0))).first()[0])


class SharedSequence:
    """Unique whole numbers for several users: each takes an interval at a time.  Not gap-free, as intervals may stay unused."""

    def __init__(self, startvalue: int = 0, intervallen: int = 5000):
        self.next, self.intervallen = startvalue, intervallen

    def interval(self) -> range:
        taken = range(self.next, self.next + self.intervallen)
        self.next += self.intervallen
        return taken

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        """df with a unique number in each row, the same whenever it is used; the next call goes on with a new interval."""
        rows = staged(df.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "sequence")
        counts = {r[0]: r[1] for r in rows.groupBy("_range").count().collect()}
        met = rows.join(_offsets(df, counts, self.next), "_range")
        self.next += -(-sum(counts.values()) // self.intervallen) * self.intervallen
        return met.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << BITS) - 1))).drop("_range", "_id", "_before")


def getsharedsequencefactory(startvalue: int = 0, intervallen: int = 5000) -> SharedSequence:
    return SharedSequence(startvalue, intervallen)
