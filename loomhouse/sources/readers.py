"""Where rows come from: files, queries, pandas, PEP 249 drivers, sequences, calendars."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader


def csvsource(spark: SparkSession, path: str | list[str], fieldnames: Sequence[str] | None = None, restval: str = "", sep: str = ",", **options: Any) -> DataFrame:
    """A CSV file of strings: names from the header unless given, quotes doubled, line feeds in quotes kept.

    Spark reads an empty field and one that is missing alike; both become `restval`.
    """
    reader = spark.read.option("header", fieldnames is None).option("multiLine", True).option("escape", '"').option("sep", sep).options(**options)
    if fieldnames is not None:
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in fieldnames]))
    df = reader.csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(restval)).alias(c) for c in df.columns])


def typedcsvsource(spark: SparkSession, path: str | list[str], casts: Mapping[str, str | T.DataType | Callable], fieldnames: Sequence[str] | None = None, **options: Any) -> DataFrame:
    """A CSV file with casts by column: a type, or a function of a Column.  A value that does not fit raises."""
    if not isinstance(casts, Mapping) or not all(isinstance(c, (str, T.DataType)) or callable(c) for c in casts.values()):
        raise TypeError("casts must map column names to types or functions")
    df = csvsource(spark, path, fieldnames, **options)
    missing = set(casts) - set(df.columns)
    if missing:
        raise KeyError(f"no such column: {', '.join(sorted(missing))}")
    return df.withColumns({n: (c(F.col(f"`{n}`")) if callable(c) else F.col(f"`{n}`").cast(c)) for n, c in casts.items()})


def sqlsource(spark: SparkSession, query: str, names: Sequence[str] = (), initsql: str | None = None, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """The rows of a Spark SQL query; `names` renames by position."""
    if initsql:
        spark.sql(initsql)
    df = spark.sql(query, args=dict(parameters) if parameters else None)
    return _named(df, names)


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if not names:
        return df
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


class _Cursor(DataSourceReader):
    def __init__(self, options: Mapping[str, str], connect: Callable):
        self.options, self.connect = options, connect

    def read(self, partition):
        connection = self.connect()
        try:
            cursor = connection.cursor()
            if self.options.get("initsql"):
                cursor.execute(self.options["initsql"])
            cursor.execute(self.options["query"])
            size = int(self.options.get("fetchsize", 500))
            while rows := cursor.fetchmany(size) if size > 0 else cursor.fetchall():
                for row in rows:
                    yield tuple(row)
                if size <= 0:
                    return
        finally:
            connection.close()


def dbsource(spark: SparkSession, connect: Callable, query: str, schema: str | T.StructType, names: Sequence[str] = (), initsql: str | None = None, fetchsize: int = 500) -> DataFrame:
    """The rows of a query on any PEP 249 driver: `connect()` runs on an executor, which streams the cursor.

    For databases with a JDBC driver, JdbcWarehouse reads in parallel.
    """

    class Pep249(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loomhouse_pep249"

        def schema(self):
            return schema

        def reader(self, schema):
            return _Cursor(self.options, connect)

    spark.dataSource.register(Pep249)
    options = {"query": query, "fetchsize": str(fetchsize)} | ({"initsql": initsql} if initsql else {})
    return _named(spark.read.format("loomhouse_pep249").options(**options).load(), names)


def pandassource(spark: SparkSession, frame: Any) -> DataFrame:
    return spark.createDataFrame(frame)


def rowfactory(spark: SparkSession, rows: Iterable[tuple] | Any, names: Sequence[str], close: bool = True) -> DataFrame:
    """Rows of an iterable of tuples or of a cursor-like object (fetchmany, fetchone or fetchall), which is then closed."""
    if hasattr(rows, "fetchmany"):
        taken = []
        while some := rows.fetchmany(200):
            taken += some
    elif hasattr(rows, "__next__") or not any(hasattr(rows, f) for f in ("fetchone", "fetchall")):
        taken = list(rows)
    elif hasattr(rows, "fetchone"):
        taken = []
        while (row := rows.fetchone()) is not None:
            taken.append(row)
    else:
        taken = rows.fetchall()
    if close and hasattr(rows, "close"):
        rows.close()
    return spark.createDataFrame([tuple(r) for r in taken], list(names))


def foreachsource(seq: Sequence[Any], callee: Callable[[Any], DataFrame]) -> DataFrame:
    """The rows of the source that `callee` makes for each element, one after the other."""
    made = [callee(x) for x in seq]
    if not made:
        raise ValueError("no element to make a source of")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)


def processsource(source: DataFrame, batchsize: int = 500, queuesize: int = 20) -> DataFrame:
    """The source itself: Spark's tasks already run beside the driver."""
    if batchsize < 1 or not isinstance(batchsize, int):
        raise ValueError("batchsize must be a positive integer")
    return source


backgroundsource = processsource

# Directives of date formats and the patterns that give the same text.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%B": "MMMM", "%b": "MMM",
    "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS",
}


def strftime(day: Column, pattern: str) -> Column:
    """The text of a date for a strftime pattern; %w, %u, %U, %W and %V are computed, the rest by date_format."""
    parts: list[Column] = []
    at = 0
    weekday = F.dayofweek(day) - 1
    special = {
        "%w": weekday.cast("string"),
        "%u": F.when(weekday == 0, 7).otherwise(weekday).cast("string"),
        "%U": F.lpad(F.floor((F.dayofyear(day) + 6 - weekday) / 7).cast("string"), 2, "0"),
        "%W": F.lpad(F.floor((F.dayofyear(day) + 6 - F.pmod(weekday + 6, F.lit(7))) / 7).cast("string"), 2, "0"),
        "%V": F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
        "%%": F.lit("%"),
    }
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two in special:
            parts.append(special[two])
            at += 2
        elif two in STRFTIME:
            parts.append(F.date_format(day, STRFTIME[two]))
            at += 2
        elif pattern[at] == "%":
            raise ValueError(f"no pattern for {two}")
        else:
            parts.append(F.lit(pattern[at]))
            at += 1
    return F.concat(*parts) if parts else F.lit("")


def _day(value: Any) -> datetime.date:
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    if isinstance(value, str):
        return datetime.date(*map(int, value.strip().split("-")))
    raise ValueError("a date or text like 2020-01-31 is needed")


DATE_STRINGS = {"date": "%Y-%m-%d", "monthname": "%B", "weekday": "%A"}
DATE_INTS = {"year": "%Y", "month": "%m", "day": "%d"}


def datespan(spark: SparkSession, fromdate: Any, todate: Any, fromdateincl: bool = True, todateincl: bool = True, key: str | None = "dateid", strings: Mapping[str, str] | None = None, ints: Mapping[str, str] | None = None, expander: Callable[[Column, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each day of an interval: an int key like 20200131, text and int columns by strftime pattern.

    `expander(day, df)` may add columns; day is the date Column.
    """
    first, last = _day(fromdate), _day(todate)
    first += datetime.timedelta(days=not fromdateincl)
    last -= datetime.timedelta(days=not todateincl)
    if first <= last:
        days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_day"))
    else:
        days = spark.createDataFrame([], "_day date")
    day = F.col("_day")
    made = {n: strftime(day, p) for n, p in (DATE_STRINGS if strings is None else strings).items()}
    made |= {n: strftime(day, p).cast("int") for n, p in (DATE_INTS if ints is None else ints).items()}
    if key:
        made = {key: strftime(day, "%Y%m%d").cast("int")} | made
    out = days.select(day, *[v.alias(n) for n, v in made.items()])
    if expander is not None:
        out = expander(day, out)
    return out.drop("_day")
