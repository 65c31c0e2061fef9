"""Looking at the row before, in the order of a whole table, without a task that sees all rows of a key.

Rows are dealt to ranges of the order and know their place in it; what one range tells the next is a row for each
range, and that row alone is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from loomhouse.plans.store import staged
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import own

RANGE, PLACE = "_range", "_place"

#: monotonically_increasing_id is the task's number and, in so many lower bits, the row's place in the task.
BITS = 33


def _falling(names: Sequence[str], descending: bool | Sequence[str]) -> set[str]:
    return set(names) if descending is True else set(descending or ())


def _sorted(names: Sequence[str], descending: bool | Sequence[str] = ()) -> list[Column]:
    falls = _falling(names, descending)
    return [own(c).desc() if c in falls else own(c).asc() for c in names]


def placed(df: DataFrame, order: Sequence[Column], tag: str) -> DataFrame:
    """df dealt to ranges of the order and written with their number and each row's place in its range, from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(dealt.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << BITS) - 1))}), tag)


def ranged(df: DataFrame, order: Sequence[str], descending: Sequence[str] = ()) -> DataFrame:
    """df dealt to ranges of the order and written with their number; a hot key spreads over several ranges."""
    return placed(df, _sorted(order, descending), "ranged")


def last_rows(rows: DataFrame) -> DataFrame:
    """The last row of each range."""
    last = rows.groupBy(F.col(RANGE).alias("_e_range")).agg(F.max(PLACE).alias("_e_place"))
    return rows.join(F.broadcast(last), (F.col(RANGE) == F.col("_e_range")) & (F.col(PLACE) == F.col("_e_place")), "left_semi")


def follows(numbers: Sequence[int], rows: DataFrame, name: str) -> DataFrame:
    """Rows, of one range each, with the number of the next range that has rows; the last range's are left out."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(zip(numbers, numbers[1:])), f"_e_range int, {name} int")), F.col(RANGE) == F.col("_e_range")).drop("_e_range")


def with_previous(rows: DataFrame, order: Sequence[str], columns: Sequence[str], into: str, numbers: Sequence[int]) -> DataFrame:
    """Ranged rows with a struct of the row before: by a window within a range, and from the last row of the range before.

    `numbers` are the ranges that have rows; one row for each of them is joined.
    """
    row = F.struct(*[own(c) for c in columns])
    inside = rows.withColumn(into, F.lag(row).over(Window.partitionBy(RANGE).orderBy(PLACE)))
    if len(numbers) < 2:
        return inside
    lasts = follows(numbers, last_rows(rows), "_this").select("_this", row.alias("_last_row"))
    # the first row of a range alone meets a row: on any other condition all others would meet in one task
    met = inside.join(F.broadcast(lasts), (F.col(RANGE) == F.col("_this")) & (F.col(PLACE) == 0), "left")
    return met.withColumn(into, F.coalesce(own(into), own("_last_row"))).drop("_last_row", "_this")


OVER = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def within(rows: DataFrame, keys: Sequence[str], value: str, into: str, how: str = "sum", before: bool = False) -> DataFrame:
    """What `running` gives, of the rows of the same range alone."""
    upto = Window.partitionBy(RANGE, *[own(k) for k in keys]).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return rows.withColumn(into, OVER[how](own(value)).over(upto))


def carried(inside: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, part: str, into: str, how: str = "sum") -> DataFrame:
    """`inside`, the rows with `part` as `within` gives it, with the whole running value: `part` after that of the ranges before.

    A key of several ranges is the last one of all of them but its last, and the first one of all but its first. So of
    each range, its last key alone has something to carry, and its first key alone takes it.
    """
    names = [own(k) for k in keys] or [F.col(RANGE) * 0]
    told = [f"_s_{i}" for i in range(len(names))]
    key = [n.alias(s) for n, s in zip(names, told)]
    at = F.col(RANGE).alias("_s_range")
    alike = reduce(Column.__and__, [n.eqNullSafe(own(s)) for n, s in zip(names, told)], F.col(RANGE) == F.col("_s_range"))
    lasts = last_rows(rows).select(at, *key)
    tails = rows.join(F.broadcast(lasts), alike).groupBy("_s_range", *told)
    whole = F.max_by(own(value), F.when(own(value).isNotNull(), F.col(PLACE))) if how == "last" else OVER[how](own(value))
    entries = tails.agg(whole.alias("_s_sum")).withColumn("_s_kind", F.lit(1))
    entries = entries.unionByName(rows.where(F.col(PLACE) == 0).select(at, *key, F.lit(0).alias("_s_kind")), allowMissingColumns=True)
    earlier = Window.partitionBy(*[own(s) for s in told]).orderBy("_s_range", "_s_kind").rowsBetween(Window.unboundedPreceding, -1)
    carry = entries.withColumn("_s_offset", OVER[how](F.col("_s_sum")).over(earlier)).where("_s_kind = 0 and _s_offset is not null").drop("_s_sum", "_s_kind")
    met = inside.join(F.broadcast(carry), alike, "left")
    joined = {"sum": F.coalesce(own(part), F.lit(0)) + F.coalesce("_s_offset", F.lit(0)), "max": F.greatest(own(part), "_s_offset"), "min": F.least(own(part), "_s_offset"), "last": F.coalesce(own(part), own("_s_offset"))}[how]
    out = met.withColumn(into, joined.cast("bigint") if how == "sum" else joined)
    return out.drop("_s_range", "_s_offset", *told, *([part] if part != into else []))


def running(rows: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, into: str, how: str = "sum", descending: bool | Sequence[str] = (), before: bool = False) -> DataFrame:
    """The sum (or the greatest, the least, or the last that is not null) of `value` over a key's rows (all rows, without keys)

    up to each one, with it (or, with `before`, without it), of rows that are ranged by `keys` and `order`.
    """
    return carried(within(rows, keys, value, "_own_sum", how, before), rows, keys, value, "_own_sum", into, how)
