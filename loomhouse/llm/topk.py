"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x).  Candidates are packed, task by task, into blocks
that hold one posting list for each dimension (the rows where it is not zero, and its
weights); queries are packed into blocks of sparse rows.  Every block of candidates meets
every block of queries once, on a grid: blocks of queries are dealt to its rows and copied to all its columns,
blocks of candidates are dealt to its columns and copied to all its rows, so candidates travel once for every
QUERY_BLOCKS x QUERIES queries.  The grid is as coarse as four cells a core allow, since finer
ones copy more.  Then, dimension after dimension, each query row scatters its
weight times the posting list into a dense array of scores; partition selection takes the k
best, with ties decided by the smaller id, and the block's lists are merged into the
running ones.  The last merge is a window over at most k rows for each query and task.

What one task holds is a cell's blocks of queries, a batch of pairs and the running lists; neither side is broadcast or collected.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part; those of other lengths than a query's meet it in the dimensions both have.  A row is
no candidate for the queries of its own id.  Repeated rows are candidates each, and a repeated
query id has one list, that of its least vector.  Fewer candidates than k: all of them.
Products beyond 63 bits wrap around, as Spark's longs do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates and of a block of queries: a pair is what a task holds (2 MB and 0.2 MB for 64 dimensions).
CANDIDATES, QUERIES = 4096, 512
#: The grid on which blocks meet: a cell has about so many blocks of each side at most; a small table gets four cells a core, up to CELLS.
QUERY_BLOCKS, CANDIDATE_BLOCKS, CELLS = 64, 64, 1024
#: Rows of running lists that a task holds at most (50 MB); beyond that they go out as they are.
HELD = 1 << 21
_HEAD = "n int, dims int, ids binary, weights binary"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): the rows that take part, as arrays of longs."""
    v = F.col(f"`{vector_col}`")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & fine).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), whole.alias("v"))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most `most` rows from each task: ids and a dims x n matrix of longs, or of ints if they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        flat: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def block(count: int) -> pa.RecordBatch:
            nonlocal ids, flat, held
            every = np.concatenate(ids)
            size = np.concatenate([s for _, s in flat])
            values = np.concatenate([v for v, _ in flat])
            edge = np.concatenate([[0], np.cumsum(size)])
            dims = int(size[:count].max())
            grid = np.zeros((count, dims), np.int64)
            grid[np.arange(dims)[None, :] < size[:count, None]] = values[: edge[count]]
            small = np.abs(grid).max(initial=0) < 2**15
            out = np.ascontiguousarray(grid.T, np.int16 if small else np.int64)
            mine = every[:count].tobytes()
            ids, flat, held = [every[count:]], [(values[edge[count] :], size[count:])], held - count
            return pa.RecordBatch.from_arrays([pa.array([count], pa.int32()), pa.array([dims], pa.int32()), pa.array([mine], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["n", "dims", "ids", "weights"])

        for batch in batches:
            column = batch.column(1)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            flat.append((column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())))
            held += len(batch)
            while held >= most:
                yield block(most)
        if held:
            yield block(held)

    return rows.mapInArrow(run, _HEAD)


def grid(asked: int, own: int, cores: int) -> tuple[int, int]:
    """(rows, columns) for so many blocks: all queries are copied `columns` times, all candidates `rows` times."""
    down, across = -(-asked // QUERY_BLOCKS), -(-own // CANDIDATE_BLOCKS)
    cells = min(4 * cores, CELLS)
    across = max(across, min(own, -(-cells // down)))
    return max(down, min(asked, -(-cells // across))), across


def _matrix(n: int, dims: int, raw: pa.Buffer) -> np.ndarray:
    kind = np.int16 if raw.size == 2 * n * dims else np.int64
    return np.frombuffer(raw, kind).reshape(dims, n)


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates) of dims x n matrices, one term after the other."""
    dims = min(len(queries), len(candidates))
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(candidates.astype(float)).max(initial=0)) * dims
    kind = np.int32 if bound < 2**31 else np.int64
    n, m = queries.shape[1], candidates.shape[1]
    scores = np.zeros((n, m), kind)
    postings = []
    for d in range(dims):
        rows = np.flatnonzero(candidates[d])
        postings.append((rows, candidates[d][rows].astype(kind)) if 4 * len(rows) < m else (None, candidates[d].astype(kind)))
    some = max(1, (1 << 17) // max(m, 1))
    held = np.empty((some, m), kind)
    for a in range(0, n, some):  # a few rows of scores stay in the processor's cache for all terms
        part = scores[a : a + some]
        for d, (rows, weights) in enumerate(postings):
            own = queries[d, a : a + some].astype(kind)
            if rows is None:  # a posting list of most rows is added as a whole
                product = held[: len(own)]
                np.multiply(own[:, None], weights[None, :], out=product)
                part += product
            elif len(rows):
                for q in np.flatnonzero(own).tolist():
                    part[q, rows] += own[q] * weights
    return scores


def select(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each query's k best other rows; of equal scores the smaller ids.  None below its `floor`.  Overwrites `scores`."""
    n, m = scores.shape
    kind = np.iinfo(scores.dtype)
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids, query_ids, side, sorter=order) for side in ("left", "right"))
    for q in np.flatnonzero(hi > lo).tolist():
        scores[q, order[lo[q] : hi[q]]] = kind.min
    kth = np.full(n, kind.min, scores.dtype) if floor is None else np.clip(floor, kind.min, kind.max).astype(scores.dtype)
    hit = scores >= kth[:, None]
    if m > k and np.count_nonzero(hit) > 4 * k * n:
        kth = np.maximum(kth, np.partition(scores, m - k, axis=1)[:, m - k])
        hit = scores >= kth[:, None]
    rows, cols = np.nonzero(hit)
    other = ids[cols] != query_ids[rows]  # where fewer than k others are there, the least score lets own rows in
    rows, cols = rows[other], cols[other]
    return _first(rows, ids[cols], scores[rows, cols].astype(np.int64), k)


def _first(rows: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row."""
    best = np.lexsort((ids, ~value, rows))
    rows = rows[best]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[best][keep], value[best][keep]


def _floor(rows: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The score of the last of each full list."""
    held = np.bincount(rows, minlength=n)
    floor = np.full(n, np.iinfo(np.int64).min)
    floor[held == k] = value[(np.cumsum(held) - 1)[held == k]]
    return floor


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, candidates_a_block: int = CANDIDATES, queries_a_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, id, score) for the rows that `is_query` marks, against all rows."""
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, scale)
    asked = integers(vectors.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    blocks, _ = written(_packed(rows, candidates_a_block), "candidates")
    queries, _ = written(_packed(asked, queries_a_block), "queries")
    asked_blocks, own_blocks = queries.count(), blocks.count()
    if not asked_blocks:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    # a grid: blocks of queries are dealt to rows and go to all columns, blocks of candidates to columns and to all rows
    down, across = grid(asked_blocks, own_blocks, spark.sparkContext.defaultParallelism)
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.struct("n", "dims", "ids", "weights")
    asked = queries.select(dealt(down).alias("r"), every(across).alias("c"), block.alias("a"))
    spread = blocks.select(every(down).alias("r"), dealt(across).alias("c"), block.alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # by a block's first query: its ids and its running lists
        row, held = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for asked_ids, (at, found, score) in lists.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked_ids[at], found, score)], names=["query_id", "id", "score"])

        for batch in batches:
            r, a, b = batch.columns
            for i in range(len(batch)):
                if r[i].as_py() != row or held > HELD:  # cells come in order of their rows, so a row's lists are done when the next begins
                    yield from flush()
                    lists, row, held = {}, r[i].as_py(), 0
                (n, dims, ids, raw), (m, wide, own, weights) = ([s.field(c)[i] for c in ("n", "dims", "ids", "weights")] for s in (a, b))
                q = _matrix(n.as_py(), dims.as_py(), raw.as_buffer())
                c = _matrix(m.as_py(), wide.as_py(), weights.as_buffer())
                asked_ids, own_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, own))
                key = int(asked_ids[0])
                if key in lists:
                    asked_ids, old = lists[key]
                    new = select(accumulate(q, c), asked_ids, own_ids, k, _floor(old[0], old[2], len(asked_ids), k))
                    best = _first(*(np.concatenate(x) for x in zip(old, new)), k)
                    held -= len(old[0])
                else:
                    asked_ids, best = asked_ids.copy(), select(accumulate(q, c), asked_ids, own_ids, k)  # a view would keep its batch
                lists[key] = asked_ids, best
                held += len(best[0])
        yield from flush()

    # merged, whatever Spark takes the sizes to be: it would broadcast copies that it does not count. The right side is held, a cell at a time
    met = spread.join(asked.hint("merge"), ["r", "c"]).select("r", "a", "b").mapInArrow(run, "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
