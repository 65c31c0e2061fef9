"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words (an item of fewer words is
one window).  A document holds a window only if it holds all of the window's words, so by
the prefix principle (prefix length |x| - t + 1 with t = |x|) it is enough to join on one
token: the window's rarest word, rarity being the word's count over all documents.  From a
joined word the window's place in the document is known (positional bound), must lie inside
it (length bound), and is then verified word by word.

Defined results: null text has no words; a null or empty item has no window; rows with the
same item_id are one item; items with a null id mark words but are not counted; repeated
documents are each judged alone; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, fresh, lists, strings, struct, written
from .words import ALNUM, words

#: Windows that one pass takes to the executors: a bound on what is broadcast (about 200 bytes each).
WINDOWS_A_PASS = 250_000
RESULT = "n_words bigint, n_hit bigint, item_ids array<string>, starts array<int>, ends array<int>"


def _windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[tuple[tuple[bytes, ...], str | None]]:
    """Every window of every item, streamed partition by partition through the driver."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        data, offsets = strings(pa.array([row["t"]]))
        lowered, start, end, _, _ = words(data, offsets, ALNUM)
        raw = lowered.tobytes()
        own = [raw[a:b] for a, b in zip(start, end)]
        for at in range(max(1, len(own) - window + 1) if own else 0):
            yield tuple(own[at : at + window]), row["i"]


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, most: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    held: dict[tuple[bytes, ...], set[str]] = {}
    for key, item in _windows(benchmark, window, id_col, text_col):
        if len(held) >= most and key not in held:
            yield held
            held = {}
        held.setdefault(key, set())
        if item is not None:
            held[key].add(item)
    if held:
        yield held


def _hash_words(own: list[bytes]) -> np.ndarray:
    data, offsets = strings(pa.array(own, pa.binary()))
    from .words import hashes

    return hashes(data, offsets[:-1], offsets[1:])


def _rarity(docs: DataFrame, text_col: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Occurrences of the benchmark's words over all documents; one row for each word and task is shuffled."""
    spark = docs.sparkSession
    keys = _hash_words(vocabulary)
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast(keys[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        known = sent.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for a, b in pieces(offsets):
                _, _, _, _, h = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["k", "n"])

    counted = docs.select(text_col).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    got = {r["k"]: r["n"] for r in counted.collect()}  # at most one row for each word of the vocabulary
    sent.unpersist()
    return {vocabulary[int(i)]: got.get(k, 0) for k, i in enumerate(order)}


class _Index:
    """The windows of one pass, by the hash of their prefix word."""

    def __init__(self, block: dict[tuple[bytes, ...], set[str]], count: dict[bytes, int], width: int):
        self.words = list(block)
        self.items = [sorted(block[w]) for w in self.words]
        self.length = np.array([len(w) for w in self.words], np.int64)
        vocabulary = sorted({x for w in self.words for x in w})
        number = {x: k for k, x in enumerate(vocabulary)}
        hashed = _hash_words(vocabulary)
        grid = np.zeros((len(self.words), width), np.int64)
        prefix = np.zeros(len(self.words), np.int64)
        for k, w in enumerate(self.words):
            grid[k, : len(w)] = [number[x] for x in w]
            prefix[k] = min(range(len(w)), key=lambda i: (count.get(w[i], 0), w[i], i))
        self.grid = hashed[grid]
        self.offset = prefix
        key = self.grid[np.arange(len(self.words)), prefix]
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.many = np.unique(key[self.order], return_index=True, return_counts=True)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """Words of each row, and (row, first word, last word + 1, window) of each occurrence."""
        lowered, start, end, row, h = words(data, offsets, ALNUM)
        n = len(offsets) - 1
        count = np.bincount(row, minlength=n)
        first = np.cumsum(count) - count
        if not len(h):
            return count, []
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == h)
        if not len(place):
            return count, []
        at = at[place]
        many = self.many[at]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        window = self.order[np.repeat(self.first[at], many) + step]
        place = np.repeat(place, many)
        begin = place - self.offset[window]
        stop = begin + self.length[window]
        own = row[place]
        fits = (begin >= first[own]) & (stop <= first[own] + count[own])
        begin, stop, window, own = begin[fits], stop[fits], window[fits], own[fits]
        for i in range(self.grid.shape[1]):
            same = (i >= self.length[window]) | (h[np.minimum(begin + i, len(h) - 1)] == self.grid[window, i])
            begin, stop, window, own = begin[same], stop[same], window[same], own[same]
        found = []
        if len(begin):
            raw = lowered.tobytes()
            for d, a, b, w in zip(own.tolist(), begin.tolist(), stop.tolist(), window.tolist()):
                if all(raw[start[a + i] : end[a + i]] == x for i, x in enumerate(self.words[w])):
                    found.append((d, a - int(first[d]), b - int(first[d]), w))
        return count, found


def _annotated(docs: DataFrame, index: _Index, text_col: str, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        held = sent.value

        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            count, found = held.find(data, offsets)
            n = len(count)
            runs: list[list[list[int]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for d, a, b, w in sorted(found):
                items[d].update(held.items[w])
                if runs[d] and a <= runs[d][-1][1]:
                    runs[d][-1][1] = max(runs[d][-1][1], b)
                else:
                    runs[d].append([a, b])
            many = np.array([len(r) for r in runs], np.int32)
            flat = [x for r in runs for x in r]
            return struct(
                n_words=pa.array(count, pa.int64()),
                n_hit=pa.array([sum(b - a for a, b in r) for r in runs], pa.int64()),
                item_ids=lists(pa.array([i for s in items for i in sorted(s)], pa.string()), np.array([len(s) for s in items], np.int32)),
                starts=lists(pa.array([a for a, _ in flat], pa.int32()), many),
                ends=lists(pa.array([b for _, b in flat], pa.int32()), many),
            )

        return work

    return annotate(docs, text_col, f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>", name, make)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", name: str = "contamination", windows_a_pass: int = WINDOWS_A_PASS) -> DataFrame:
    """docs with a struct column: n_words, n_hit, item_ids (sorted), and merged hit spans in words.

    What is broadcast holds at most `windows_a_pass` windows.  A larger benchmark goes over the
    documents in several passes, each adding to the spans and items of the one before; passes
    are written to the shared folder in between.
    """
    name = fresh(docs, name)
    blocks = _blocks(benchmark, window, item_id, item_text, windows_a_pass)
    block = next(blocks, None)
    if block is None:
        return _annotated(docs, _Index({(b"\xff",): set()}, {}, 1), text_col, name)  # no word holds the byte FF
    out, earlier = docs, None
    while block is not None:
        vocabulary = sorted({x for w in block for x in w})
        index = _Index(block, _rarity(docs, text_col, vocabulary), max(map(len, block)))
        block = next(blocks, None)
        out = _annotated(out, index, text_col, name if earlier is None else fresh(out, name))
        if earlier is not None:
            out = _merged(out, earlier, out.columns[-1])
        earlier = name
        if block is not None:
            out, _ = written(out, "decontaminate")
    return out


def _merged(df: DataFrame, left: str, right: str) -> DataFrame:
    """Union of two struct columns' spans and items, with DataFrame functions."""
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    spans = F.array_sort(F.concat(F.arrays_zip(a["starts"], a["ends"]), F.arrays_zip(b["starts"].alias("starts"), b["ends"].alias("ends"))))
    zero = F.expr("cast(array() as array<struct<starts:int,ends:int>>)")
    joined = F.aggregate(
        spans,
        zero,
        lambda acc, x: F.when((F.size(acc) > 0) & (x["starts"] <= F.element_at(acc, -1)["ends"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["starts"].alias("starts"), F.greatest(F.element_at(acc, -1)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = F.struct(
        a["n_words"].alias("n_words"),
        F.aggregate(joined, F.lit(0).cast("bigint"), lambda s, x: s + (x["ends"] - x["starts"])).alias("n_hit"),
        F.array_sort(F.array_union(a["item_ids"], b["item_ids"])).alias("item_ids"),
        joined["starts"].alias("starts"),
        joined["ends"].alias("ends"),
    )
    return df.withColumn(left, merged).drop(right)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The documents without any word in a benchmark window; columns as they were."""
    out = contamination(docs, benchmark, window, text_col)
    mark = out.columns[-1]
    return out.where(F.col(f"`{mark}`.n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
