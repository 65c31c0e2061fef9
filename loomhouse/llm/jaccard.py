"""Pairs of texts whose sets of word shingles have a Jaccard similarity of num / den or more, joined without misses.

A pair at the bound shares num / den of either set, so in any one order of all shingles the first
n - ceil(n num / den) + 1 of both sets (their prefixes) have a shingle in common.  The order is: shingles by the
weight that a sample counted for them, then by hash; it decides about speed only.  So what many texts
share comes last, and stands in the prefixes only of texts made mostly of it.

Equal sets are put together first.  Prefixes go out once, and only shingles that two sets or more have in their
prefixes stay.  At each of these, every set is held against one; a set's first pair that passes is verified and
joined with the links at hand; then all sets that are still in different groups are held against each other.
"Held against" is two bounds that no true pair exceeds: the sizes, and the differing bits of
1,024-bit parity maps, which are at most the shingles that only one of both sets has.  What passes meets maps of two bits
and more a shingle, and is then verified on the whole sets in integers.  So a group of m copies gives pairs in proportion to m, and still no pair at the bound is left in two groups.

Defined results: words as in `simhash`; fewer words than a shingle make one shingle; texts without words have no
set and no links.  Sets are sets of 64-bit hashes, and a set is named by a 64-bit hash of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, release, remove, strings, written
from .components import components
from .words import NOT_SPACE, mix, words

SHINGLE = 5
LEAST = (4, 5)
#: The sample that weighs shingles: one text in so many, counted in 2^20 buckets; the heaviest of them are told apart.
SAMPLE, SHIFT, HEAVY = 8, np.uint64(44), 1 << 16
#: Prefix entries (16 bytes) and rows of shared entries (some 160 bytes) of one bin.
ENTRIES_A_BIN, ROWS_A_BIN = 500_000, 50_000
_WORDS = 16  # of 64 bits, in a parity map

SET = "k:bigint,n:int,map:binary,prefix:binary"


def sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each row's distinct shingles, sorted by row and hash."""
    _, start, end, row, h = words(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=n)
    k = np.maximum(count - size + 1, np.minimum(count, 1))
    own = np.repeat(np.arange(n), k)
    at = np.repeat(np.cumsum(count) - count, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
    stop = np.cumsum(count)[own]
    value = np.zeros(len(at), np.uint64)
    for j in range(size):
        term = np.where(at + j < stop, h[np.minimum(at + j, len(h) - 1)], np.uint64(0))
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + term)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (own[1:] != own[:-1])])
    return value[new], own[new]


def weights(docs: DataFrame, text_col: str = "text", size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their counts) of the heaviest shingles of a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen = np.zeros(1 << 20, np.int64)
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for a, b in pieces(offsets):
                h, _ = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                np.add.at(seen, (h >> SHIFT).astype(np.int64), 1)
        hot = np.flatnonzero(seen >= 4 + 4 * seen.mean())
        yield pa.RecordBatch.from_arrays([pa.array(hot.astype(np.int32)), pa.array(seen[hot])], names=["bucket", "n"])

    text = F.col(f"`{text_col}`")
    told = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).mapInArrow(count, "bucket int, n bigint")
    top = told.groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(HEAVY).collect()
    top.sort()
    return np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64)


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """64-bit values as one binary a row, `lengths` values each."""
    offsets = np.concatenate([[0], np.cumsum(lengths * 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def described(data: np.ndarray, offsets: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], least: tuple[int, int] = LEAST, size: int = SHINGLE) -> dict[str, pa.Array]:
    """For each row the columns of SET: the set's name, its size, parity map and prefix."""
    rows = len(offsets) - 1
    h, row = sets(data, offsets, size)
    n = np.bincount(row, minlength=rows)
    edge = np.concatenate([[0], np.cumsum(n)])
    raw = h.tobytes()
    names = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b], 7) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], np.uint64).view(np.int64)
    bit = h & np.uint64(64 * _WORDS - 1)
    maps = np.zeros(rows * _WORDS, np.uint64)
    np.bitwise_xor.at(maps, row * _WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    weight = np.zeros(len(h), np.int64)
    if len(heavy[0]):
        bucket = (h >> SHIFT).astype(np.int64)
        at = np.minimum(np.searchsorted(heavy[0], bucket), len(heavy[0]) - 1)
        weight = np.where(heavy[0][at] == bucket, heavy[1][at], 0)
    ordered = h[np.lexsort((h, weight, row))]
    p = np.where(n > 0, n + (-n * least[0]) // least[1] + 1, 0)
    take = np.repeat(edge[:-1], p) + (np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p))
    return {"k": pa.array(names, mask=n == 0), "n": pa.array(n.astype(np.int32)), "map": _binary(maps, np.full(rows, _WORDS)), "prefix": _binary(ordered[take], p)}


def _shared(nodes: DataFrame) -> DataFrame:
    """(entry, k): the prefix entries that two sets or more have."""
    total = nodes.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    bins = max(1, -int(-total // ENTRIES_A_BIN))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            data, offsets = strings(batch.column(1))
            names = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in pieces(offsets):
                entry = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint64)
                name = np.repeat(names[a:b], np.diff(offsets[a : b + 1]) // 8)
                to = ((mix(entry) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
                order = np.argsort(to, kind="stable")
                entry, name = entry[order], name[order]
                cut = np.searchsorted(to[order], np.arange(bins + 1, dtype=np.uint64))
                some = np.flatnonzero(cut[1:] > cut[:-1])
                blobs = [entry[cut[i] : cut[i + 1]].tobytes() + name[cut[i] : cut[i + 1]].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bin", "entries"])

    def meet(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, names = [], []
        for batch in group:
            for blob in batch.column(batch.schema.get_field_index("entries")):
                raw = blob.as_buffer()
                m = raw.size // 16
                entries.append(np.frombuffer(raw, np.int64, m))
                names.append(np.frombuffer(raw, np.int64, m, 8 * m))
        entry, name = np.concatenate(entries), np.concatenate(names)
        order = np.argsort(entry, kind="stable")
        entry, name = entry[order], name[order]
        same = entry[1:] == entry[:-1]
        stays = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield pa.RecordBatch.from_arrays([pa.array(entry[stays]), pa.array(name[stays])], names=["entry", "k"])

    sent = nodes.select("k", "prefix").mapInArrow(emit, "bin int, entries binary")
    return written(sent.groupBy("bin").applyInArrow(meet, "entry bigint, k bigint"), "shared")[0]


def _may(n: np.ndarray, maps: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether the sizes and parity maps of rows a and b allow a pair at the bound."""
    num, den = least
    na, nb = n[a], n[b]
    out = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    at = np.flatnonzero(out)
    for lo in range(0, len(at), 1 << 15):
        s = at[lo : lo + (1 << 15)]
        both = na[s] + nb[s]
        out[s] = np.bitwise_count(maps[a[s]] ^ maps[b[s]]).sum(axis=1, dtype=np.int64) <= both + 2 * ((-both * num) // (num + den))
    return out


def _pairs(entry: np.ndarray, k: np.ndarray, n: np.ndarray, maps: np.ndarray, label: np.ndarray | None, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names of sets that meet at an entry and may be a pair: each with the least name, or with labels, all of different labels."""
    order = np.lexsort((k, entry))
    entry, k, n, maps = entry[order], k[order], n[order], maps[order]
    first = np.concatenate([[0], np.flatnonzero(entry[1:] != entry[:-1]) + 1])
    size = np.diff(np.concatenate([first, [len(entry)]]))
    if label is None:
        b = np.arange(len(entry))
        a = np.repeat(first, size)
        a, b = a[a != b], b[a != b]
        ok = _may(n, maps, a, b, least)
        yield k[a[ok]], k[b[ok]]
        return
    label = label[order]
    for s, m in zip(first.tolist(), size.tolist()):
        own = label[s : s + m]
        _, which, count = np.unique(own, return_inverse=True, return_counts=True)
        if len(count) == 1:
            continue
        rest = np.flatnonzero(which != count.argmax())
        done = np.zeros(m, bool)
        for x in rest.tolist():  # against all of another label that were not in its place before
            done[x] = True
            b = np.flatnonzero((own != own[x]) & ~done)
            a = np.full(len(b), x)
            ok = _may(n[s : s + m], maps[s : s + m], a, b, least)
            if ok.any():
                yield k[s + a[ok]], k[s + b[ok]]


def _candidates(shared: DataFrame, nodes: DataFrame, least: tuple[int, int], labelled: bool) -> DataFrame:
    """(a, b), a < b: candidates among the sets (k, n, map[, label]) at the entries, not distinct."""
    bins = max(1, -(-shared.count() // ROWS_A_BIN))

    def meet(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group))
        column = lambda c: table.column(c).to_numpy()
        maps = np.frombuffer(strings(table.column("map"))[0].tobytes(), np.uint64).reshape(-1, _WORDS)
        for a, b in _pairs(column("entry"), column("k"), column("n").astype(np.int64), maps, column("label") if labelled else None, least):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = shared.join(nodes, "k").withColumn("bin", F.pmod(F.xxhash64("entry"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(meet, "a bigint, b bigint")


def _wide(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity maps of two to four bits a shingle, 1,024 at least; halves of a longer one folded give the shorter one."""
    bits = np.maximum(64 * _WORDS, 1 << np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64))
    size = bits // 64
    begin = np.cumsum(size) - size
    bit = (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    maps = np.zeros(int(size.sum()), np.uint64)
    np.bitwise_xor.at(maps, begin[row] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return _binary(maps, size)


def _near(x: np.ndarray, y: np.ndarray, both: int, least: tuple[int, int]) -> bool:
    """Whether wide maps of sets with `both` shingles together allow a pair at the bound."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= both + 2 * ((-both * least[0]) // sum(least))


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, least: tuple[int, int], size: int) -> DataFrame:
    """The pairs whose whole sets are at the bound; docs has (th, text), prints (th, k)."""
    num, den = least
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    chosen, _ = written(prints.join(wanted, "k", "left_semi").groupBy("k").agg(F.min("th").alias("w_th")), "chosen")
    texts = docs.join(chosen, F.col("th") == F.col("w_th")).select("k", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in pieces(offsets):
                h, row = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.bincount(row, minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n.astype(np.int32)), _wide(h, row, n), _binary(h, n)], names=["k", "n", "wide", "whole"])

    made, made_path = written(texts.mapInArrow(whole, "k bigint, n int, wide binary, whole binary").dropDuplicates(["k"]), "sets")
    release(docs.sparkSession)

    def held(test, x: str):
        """Pairs (a, b) whose columns x, with their sizes, pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lean()
            for batch in batches:
                values = [np.frombuffer(v.as_buffer(), np.uint64) for i in (3, 5) for v in batch.column(i)]
                n = batch.num_rows
                ok = [test(values[i], values[n + i], p + q) for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        def of(some: DataFrame) -> DataFrame:
            one = made.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col(x).alias("xa"))
            two = made.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col(x).alias("xb"))
            return some.join(one, "a").join(two, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, "a bigint, b bigint")

        return of

    def alike(x: np.ndarray, y: np.ndarray, both: int) -> bool:
        return len(np.intersect1d(x, y, assume_unique=True)) * (num + den) >= both * num

    passed, _ = written(held(lambda x, y, both: _near(x, y, both, least), "wide")(pairs), "passed")
    release(docs.sparkSession)
    out, _ = written(held(alike, "whole")(passed), "verified")
    remove(docs.sparkSession, made_path)
    release(docs.sparkSession)
    return out


def groups(docs: DataFrame, prints: DataFrame, near: DataFrame, least: tuple[int, int] = LEAST, size: int = SHINGLE) -> DataFrame:
    """(node, root) over values of `bits`: the links `near` (a, b) and all pairs at the bound, joined.

    docs has (th, text); prints, a written table, has th, bits and the columns of SET for each of its rows.
    """
    own = prints.where("n > 0")
    nodes, _ = written(own.select("k", "n", "map", "prefix").dropDuplicates(["k"]), "nodes")
    rep, _ = written(own.groupBy("k").agg(F.min("bits").alias("rep")), "rep")
    same = own.select("k", "bits").distinct().join(rep, "k").where("bits != rep").select(F.col("bits").alias("a"), F.col("rep").alias("b"))
    named = lambda pairs: pairs.join(rep.select(F.col("k").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("k").alias("b"), F.col("rep").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    shared = _shared(nodes)
    maps = nodes.select("k", "n", "map")
    spark = docs.sparkSession
    release(spark)
    star, _ = written(_candidates(shared, maps, least, False).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star")
    release(spark)
    edges, _ = written(near.union(same).union(named(_verified(star, docs, own, least, size))).distinct(), "near")
    tree = components(edges)
    labels, _ = written(rep.join(tree, rep["rep"] == tree["node"], "left").select("k", F.coalesce("root", "rep").alias("label")), "labels")
    release(spark)
    rest, _ = written(_candidates(shared, maps.join(labels, "k"), least, True).distinct().join(star, ["a", "b"], "left_anti"), "rest")
    release(spark)
    if not rest.isEmpty():
        more = _verified(rest, docs, own, least, size)
        if not more.isEmpty():
            tree = components(edges.union(named(more)))
    return tree
