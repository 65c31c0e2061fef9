"""Steps: a graph of DataFrame functions, each pushing its rows to the next."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from loomhouse.functions.rows import renamefromto, renametofrom
from loomhouse.operators.ordered import PLACE, RANGE, ranged, running
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_named: dict[str, Step] = {}


def _c(value: Column | str) -> Column:
    return F.col(f"`{value}`") if isinstance(value, str) else value


class Step:
    """worker(df) -> df or None (the rows as they are); `next` is a step, its name, or None.

    Rows that a step ends with stay in `results`: a step may be reached from several others.
    """

    def __init__(self, worker: Callable[[DataFrame], DataFrame | None] | None = None, next: Step | str | None = None, name: str | None = None):  # noqa: A002
        self.worker, self.next, self.name = worker, next, name
        self.results: list[DataFrame] = []
        if name is not None:
            _named[name] = self

    @staticmethod
    def getstep(name: str) -> Step:
        return _named[name]

    def _to(self, step: Step | str | None, df: DataFrame) -> None:
        if step is not None:
            (self.getstep(step) if isinstance(step, str) else step).process(df)

    def process(self, df: DataFrame) -> None:
        out = self.defaultworker(df) if self.worker is None else self.worker(df)
        out = df if out is None else out
        self.results.append(out)
        self._to(self.next, out)

    def defaultworker(self, df: DataFrame) -> DataFrame | None:
        return None

    def inject(self, df: DataFrame, target: Step | str | None = None) -> None:
        """Push more rows to the next step, or to a named one."""
        self._to(target if target is not None else self.next, df)

    def __call__(self, df: DataFrame) -> None:
        self.process(df)

    def result(self) -> DataFrame:
        """All rows that have come out of this step."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.results)


def connectsteps(*steps: Step) -> None:
    for a, b in zip(steps, steps[1:]):
        a.next = b


class SourceStep(Step):
    def __init__(self, source: DataFrame, next: Step | str | None = None, name: str | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.source = source

    def start(self) -> None:
        self.process(self.source)


class MappingStep(Step):
    """targets: (column, function of a Column) pairs, in order."""

    def __init__(self, targets: Iterable[tuple[str, Callable[[Column], Column]]], requiretargets: bool = True, next: Step | str | None = None, name: str | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.targets, self.requiretargets = list(targets), requiretargets

    def defaultworker(self, df: DataFrame) -> DataFrame:
        for n, f in self.targets:
            if n in df.columns:
                df = df.withColumn(n, f(_c(n)))
            elif self.requiretargets:
                raise KeyError(n)
        return df


class ValueMappingStep(Step):
    """outputatt = mapping[inputatt], or the default; a value that is mapped to None gives null."""

    def __init__(self, outputatt: str, inputatt: str, mapping: Mapping[Any, Any] | DataFrame, requireinput: bool = True, defaultvalue: Any = None, next: Step | str | None = None, name: str | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.outputatt, self.inputatt, self.mapping, self.requireinput, self.defaultvalue = outputatt, inputatt, mapping, requireinput, defaultvalue

    def defaultworker(self, df: DataFrame) -> DataFrame:
        if self.inputatt not in df.columns:
            if self.requireinput:
                raise KeyError(self.inputatt)
            return df.withColumn(self.outputatt, F.lit(self.defaultvalue))
        table = self.mapping
        if not isinstance(table, DataFrame):  # a table like any other: Spark joins it as its size allows
            if not table:
                return df.withColumn(self.outputatt, F.lit(self.defaultvalue))
            values = [v for v in (*table.values(), self.defaultvalue) if v is not None]
            value = T.StructField("v", T.StringType()) if not values else df.sparkSession.createDataFrame([(v,) for v in values], ["v"]).schema["v"]
            shape = T.StructType([T.StructField("k", df.schema[self.inputatt].dataType), T.StructField("v", value.dataType)])
            table = df.sparkSession.createDataFrame(list(table.items()), shape)
        table = table.toDF("_k", "_v").withColumn("_hit", F.lit(True))
        met = df.join(table, _c(self.inputatt).eqNullSafe(F.col("_k")), "left")
        return met.withColumn(self.outputatt, F.when(F.col("_hit"), F.col("_v")).otherwise(F.lit(self.defaultvalue))).drop("_k", "_v", "_hit")


class PrintStep(Step):
    def defaultworker(self, df: DataFrame) -> None:
        df.show(truncate=False)


class DimensionStep(Step):
    """ensure, with the key as `keyfield`."""

    def __init__(self, dimension: Any, keyfield: str | None = None, next: Step | str | None = None, name: str | None = None, namemapping: Mapping[str, str] | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.dimension, self.keyfield, self.namemapping = dimension, keyfield, namemapping

    def defaultworker(self, df: DataFrame) -> DataFrame:
        return self.dimension.ensure(df, self.namemapping, self.keyfield)


class SCDimensionStep(DimensionStep):
    def defaultworker(self, df: DataFrame) -> DataFrame:
        return self.dimension.scdensure(df, self.namemapping, self.keyfield)


class RenamingFromToStep(Step):
    rename = staticmethod(renamefromto)

    def __init__(self, renaming: Mapping[str, str], next: Step | str | None = None, name: str | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.renaming = renaming

    def defaultworker(self, df: DataFrame) -> DataFrame:
        return self.rename(df, self.renaming)


RenamingStep = RenamingFromToStep


class RenamingToFromStep(RenamingFromToStep):
    rename = staticmethod(renametofrom)


class GarbageStep(Step):
    """The end of rows that nobody wants."""

    def process(self, df: DataFrame) -> None:
        self.results.append(df.limit(0))


class ConditionalStep(Step):
    """Rows for which the condition holds go one way, all others the other way or nowhere."""

    def __init__(self, condition: Column | Callable[[DataFrame], Column], whentrue: Step | str, whenfalse: Step | str | None = None, name: str | None = None):
        super().__init__(None, None, name)
        self.condition, self.whentrue, self.whenfalse = condition, whentrue, whenfalse

    def process(self, df: DataFrame) -> None:
        condition = self.condition(df) if not isinstance(self.condition, Column) else self.condition
        holds = F.coalesce(condition, F.lit(False))
        self.results.append(df)
        self._to(self.whentrue, df.where(holds))
        self._to(self.whenfalse, df.where(~holds))


class CopyStep(Step):
    """All rows to two steps, the copy first."""

    def __init__(self, originaldest: Step | str | None, copydest: Step | str, deepcopy: bool = False, name: str | None = None):
        if copydest is None:
            raise ValueError("copydest is needed")
        super().__init__(None, originaldest, name)
        self.copydest = copydest

    def process(self, df: DataFrame) -> None:
        self._to(self.copydest, df)
        super().process(df)


class AggregatingStep(Step):
    """Aggregates of the rows since the last punctuation, on each row that is one.

    punctuation: the Column that marks the end of a group; order_by: arrival order; by: columns
    within which order holds (a partition of the stream).  aggregates: {column: aggregate}; a group
    without rows gets what the aggregate gives for no rows.  Rows are dealt to ranges of (by, order), so
    no task sees all rows, or all of a hot key.
    """

    def __init__(self, aggregates: Mapping[str, Column], punctuation: Column, order_by: list[str], by: list[str] = (), next: Step | str | None = None, name: str | None = None):  # noqa: A002
        super().__init__(None, next, name)
        self.aggregates, self.punctuation, self.order_by, self.by = dict(aggregates), punctuation, list(order_by), list(by)

    def defaultworker(self, df: DataFrame) -> DataFrame:
        order = [*self.by, *self.order_by]
        marked = ranged(df.withColumn("_end", F.coalesce(self.punctuation, F.lit(False)).cast("bigint")), order)
        counted = running(marked, self.by, self.order_by, "_end", "_group")
        group = counted.withColumns({"_group": F.col("_group") - F.col("_end"), "_end": F.col("_end") == 1}).drop(RANGE, PLACE)
        keys = [_c(b) for b in self.by]
        rows = group.where(~F.col("_end")).groupBy(*keys, "_group").agg(*[v.alias(n) for n, v in self.aggregates.items()])
        ends = group.where(F.col("_end")).drop(*self.aggregates, "_end")
        right = rows.select(*[_c(b).alias(f"_b_{b}") for b in self.by], F.col("_group").alias("_g"), *[_c(n) for n in self.aggregates], F.lit(True).alias("_met"))
        on = F.col("_group") == F.col("_g")
        for b in self.by:
            on = on & _c(b).eqNullSafe(F.col(f"`_b_{b}`"))
        met = ends.join(right, on, "left")
        none = df.where(F.lit(False)).agg(*[v.alias(n) for n, v in self.aggregates.items()]).first()
        met = met.withColumns({n: F.when(F.col("_met"), _c(n)).otherwise(F.lit(none[n])) for n in self.aggregates if none[n] is not None})
        return met.drop("_group", "_g", "_met", *[f"_b_{b}" for b in self.by])


def sumaggregator(field: str) -> Column:
    """The sum, 0 without values."""
    return F.coalesce(F.sum(_c(field)), F.lit(0))


def avgaggregator(field: str) -> Column:
    """The average, 0 without values."""
    return F.coalesce(F.avg(_c(field)), F.lit(0))


def maxaggregator(field: str) -> Column:
    return F.max(_c(field))


def minaggregator(field: str) -> Column:
    return F.min(_c(field))
