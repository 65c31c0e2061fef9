"""Sources made from other sources: mapping, filtering, SQL, pivot, joins and unions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from loomhouse.functions.aggregators import Aggregator, Sum
from loomhouse.operators.keys import numbered
from loomhouse.plans.store import made, shared_dir, staged
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mappingsource(source: DataFrame, callables: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Each named column replaced by a function of it."""
    if not isinstance(callables, Mapping) or not all(isinstance(k, str) and callable(f) for k, f in callables.items()):
        raise TypeError("callables must map column names to functions")
    missing = set(callables) - set(source.columns)
    if missing:
        raise KeyError(f"no such column: {', '.join(sorted(missing))}")
    return source.withColumns({n: f(F.col(f"`{n}`")) for n, f in callables.items()}) if callables else source


def transformingsource(source: DataFrame, *transformations: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Functions of the whole DataFrame, applied in order."""
    return reduce(lambda df, f: df.transform(f), transformations, source)


def rowtransformation(function: Callable[[dict], dict | None], schema: T.StructType | str) -> Callable[[DataFrame], DataFrame]:
    """A DataFrame function from a Python function of one row as a dict, which changes it or returns another.

    For what Columns cannot express: rows go through Python in Arrow batches.
    """
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def apply(df: DataFrame) -> DataFrame:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(target)

        def run(batches):
            for batch in batches:
                rows = batch.to_pylist()
                out = [(lambda got, row: row if got is None else got)(function(row), row) for row in rows]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in target.names} for r in out], schema=shape)

        return df.mapInArrow(run, target)

    return apply


def filteringsource(source: DataFrame, filter: Column | Callable[[DataFrame], Column] | None = None) -> DataFrame:  # noqa: A002
    """The rows for which the condition holds; without one, all rows."""
    if filter is None:
        return source
    return source.where(filter(source) if callable(filter) and not isinstance(filter, Column) else filter)


#: Plans of single batches that are put together in one job.
PLANS = 64


def _lateral(view: DataFrame, name: str, query: str, batches: int) -> DataFrame | None:
    """The rows of the query over each batch in one plan, or None if Spark cannot plan it so."""
    spark, tag = view.sparkSession, uuid.uuid4().hex
    rows, numbers = f"_rows_{tag}", f"_numbers_{tag}"
    view.createOrReplaceTempView(rows)
    spark.range(batches).toDF("_number").createOrReplaceTempView(numbers)
    columns = ", ".join(f"`{c.replace('`', '``')}`" for c in view.columns if c != "_batch")
    one = f"with `{name}` as (select {columns} from {rows} where _batch = {numbers}._number) select * from (\n{query}\n)"
    try:
        view.drop("_batch").createOrReplaceTempView(name)
        if not spark.sql(query)._jdf.queryExecution().analyzed().subqueriesAll().isEmpty():
            return None  # a batch's number does not reach subqueries of the query
        out = spark.sql(f"select _answer.* from {numbers}, lateral ({one}) _answer")
        out._jdf.queryExecution().executedPlan()
        return out
    except (CapturedException, Py4JJavaError):
        return None
    finally:
        for v in (rows, numbers):
            spark.catalog.dropTempView(v)


def _batch_by_batch(view: DataFrame, name: str, query: str, batches: int) -> DataFrame:
    """The same by a plan for each batch, which reads the folder of that batch alone."""
    spark = view.sparkSession
    path = f"{shared_dir(spark)}/apart-{uuid.uuid4().hex}"
    if batches > 1:
        apart = view.repartitionByRange("_batch")
        apart.write.partitionBy("_batch").parquet(path)
        made.append(path)
    shape, parts = view.drop("_batch").schema, []
    for k in range(batches):
        own = spark.read.schema(shape).parquet(f"{path}/_batch={k}") if batches > 1 else view.drop("_batch")
        own.createOrReplaceTempView(name)
        parts.append(spark.sql(query))
        if len(parts) == PLANS and k + 1 < batches:
            parts = [staged(reduce(DataFrame.unionAll, parts), "batches")]
    return reduce(DataFrame.unionAll, parts)


def sqltransformingsource(source: DataFrame, temptablename: str, query: str, batchsize: int = 10_000, perbatch: bool = False, columnnames: Sequence[str] | None = None, order_by: Sequence[str] | None = None, batchcolumn: str | None = None) -> DataFrame:
    """The rows of a query over the source as a view.

    With `perbatch`, the source is cut into batches of `batchsize` rows in the order given, and
    the query runs over each by itself: as one lateral join of batches and query, which Spark plans by the
    batch for any number of them, or, where it cannot, planned for each batch, which alone is read, PLANS of them a job.  With
    `batchcolumn`, the view has the batch's number in a column of that name, and the query runs once over all
    batches: it must group or partition by that column, and is one plan for any number of batches.
    """
    spark = source.sparkSession
    view, batches = source, None
    if batchcolumn is not None and not perbatch:
        raise ValueError("a batch column needs perbatch")
    if perbatch:
        if batchsize < 1:
            raise ValueError("batchsize must be positive")
        rank = numbered(source, order_by or source.columns, "_row")
        number = "_batch" if batchcolumn is None else batchcolumn
        view = rank.withColumn(number, F.floor((F.col("_row") - 1) / batchsize).cast("bigint")).drop("_row")
        if batchcolumn is None:
            view = staged(view, "batches")
            batches = int(view.agg(F.coalesce(F.max("_batch"), F.lit(0))).first()[0]) + 1
    try:
        if batches is None:
            view.createOrReplaceTempView(temptablename)
            out = spark.sql(query)
        else:
            out = _lateral(view, temptablename, query, batches) if batches > 1 else None
            if out is None:
                out = _batch_by_batch(view, temptablename, query, batches)
    finally:
        spark.catalog.dropTempView(temptablename)
    if columnnames is not None:
        if len(columnnames) != len(out.columns):
            raise ValueError("as many names as columns are needed")
        out = out.toDF(*columnnames)
    return out


#: Columns that a table may be given by the values of an attribute.
COLUMNS = 10_000


def crosstab(source: DataFrame, rowvaluesatt: str, colvaluesatt: str, values: str, aggregator: Aggregator | None = None, nonevalue: Any = 0, sortrows: bool = False, columns: Sequence[Any] | None = None) -> DataFrame:
    """Rows by columns with an aggregate in each cell, `nonevalue` where there is none; columns in sorted order.

    Give `columns` where they are known: one pass over the source less.  More than COLUMNS of them raise.
    """
    if columns is None:
        columns = sorted(r[0] for r in source.select(colvaluesatt).where(F.col(colvaluesatt).isNotNull()).distinct().limit(COLUMNS + 1).collect())
        if len(columns) > COLUMNS:
            raise ValueError(f"{colvaluesatt} has more than {COLUMNS} values")
    cell = (aggregator or Sum()).column(F.col(f"`{values}`"))
    out = source.groupBy(rowvaluesatt).pivot(colvaluesatt, list(columns)).agg(cell)
    if nonevalue is not None:
        out = out.select(F.col(f"`{rowvaluesatt}`"), *[F.coalesce(F.col(f"`{c}`"), F.lit(nonevalue)).alias(c) for c in out.columns[1:]])
    return out.orderBy(rowvaluesatt) if sortrows else out


def hashjoin(src1: DataFrame, key1: str, src2: DataFrame, key2: str, hint: str | None = None) -> DataFrame:
    """Inner equi-join on one key each.  Nulls match nulls; of columns in both, the right one stays.

    Spark broadcasts the right side only if its size allows.
    """
    right = src2.select(*[F.col(f"`{c}`").alias(f"_right_{c}") for c in src2.columns])
    right = right.hint(hint) if hint else right
    met = src1.join(right, F.col(f"`{key1}`").eqNullSafe(F.col(f"`_right_{key2}`")), "inner")
    keep = [F.col(f"`{c}`") for c in src1.columns if c not in src2.columns]
    return met.select(*keep, *[F.col(f"`_right_{c}`").alias(c) for c in src2.columns])


joiningsource = hashjoin


def mergejoin(src1: DataFrame, key1: str, src2: DataFrame, key2: str) -> DataFrame:
    """The same as a sort-merge join; the sources need not come sorted."""
    return hashjoin(src1, key1, src2, key2, hint="merge")


def unionsource(*sources: DataFrame, index: str | None = None) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null.  `index` adds the source's number."""
    if not sources:
        raise ValueError("no source")
    parts = [s.withColumn(index, F.lit(k)) if index else s for k, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def roundrobinsource(sources: Sequence[DataFrame], batchsize: int = 500, order_by: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
    """All rows of all sources.  With `position`, a column (round, source, row) that puts batches in turn when sorted by."""
    if batchsize < 1:
        raise ValueError("batchsize must be positive")
    if position is None:
        return unionsource(*sources)
    parts = []
    for k, s in enumerate(sources):
        rank = numbered(s, order_by or s.columns, "_row")
        spot = F.struct(F.floor((F.col("_row") - 1) / batchsize).cast("bigint").alias("round"), F.lit(k).alias("source"), F.col("_row").alias("row"))
        parts.append(rank.withColumn(position, spot).drop("_row"))
    return unionsource(*parts)
