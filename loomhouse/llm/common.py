"""What the operators of this subpackage share: tables, folds, shared folders, Arrow passes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def in_fold(column: str, mod: int, remainder: int) -> Column:
    """True where the id falls in the fold; a null id is in no fold."""
    return F.coalesce(fold(column, mod) == remainder, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests, a local master) a temporary folder takes its place; on a
    cluster that is refused, as executors would not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="loomhouse-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths of the tables that `written` has made and `remove` has not deleted, in order.
made: list[str] = []


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made and nothing reads any more."""
    if path in made:
        made.remove(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs (it does so when the JVM collects garbage)."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def strings(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty; offsets start at 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "" if not pa.types.is_binary(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row stands alone and whole."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lean() -> None:
    """In a Python worker: arrays of a megabyte and more go back to the system when they are freed.

    Left alone, glibc and Arrow's pool keep the largest batch's memory for as long as the worker lives.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def annotate(df: DataFrame, text: str, result: str, name: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], pa.StructArray]]) -> DataFrame:
    """df with one struct column `name` of type `result` (DDL), computed from the texts.

    `make()` runs once in each task and returns a function of (bytes, offsets) for some
    whole rows; if it has a `close`, that is called when the task has no more rows.  All other columns pass through untouched, nulls of `text` read as empty.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(name, T._parse_datatype_string(result))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        work = make()
        for batch in batches:
            data, offsets = strings(batch.column(batch.schema.get_field_index(text)))
            for a, b in pieces(offsets):  # a piece goes back before the next is worked on
                column = work(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], names=[*batch.schema.names, name])
        if hasattr(work, "close"):
            work.close()

    return df.mapInArrow(run, schema)


def struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def lists(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
