"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at 3 or fewer differing bits have a point halfway.  Half the radius
is one and a half, so the halves are one bit and two; parity says who takes which.  Every
fingerprint emits the 64 points at one bit.  One with an odd number of set bits also emits
itself and the 2,016 points at two bits.  At a point of odd parity meet even fingerprints one
bit away and odd ones zero or two bits away: distances 1 and 3.  At a point of even parity
meet odd fingerprints one bit away, at a point of odd parity even ones one bit away:
distance 2.  So no pair within the radius is missed, and pairs at a point are within it unless
both are odd and two bits away.

Equal fingerprints are put together first.  The points go out in `ROUNDS` rounds, each
over its share of the points, so that the disk holds one round's shuffle at a time; within a
round they are dealt to bins by a mixed hash.  A point's members are linked as a star, and
each bin sends its links as a spanning forest, verified by Hamming distance, so a group of m
copies gives links in proportion to m.

Defined results: words are runs of non-white bytes, A-Z lower-cased; fewer words than a
shingle make one shingle, no words (null text too) the fingerprint zero, linked like any other;
a null id takes part in linking, but the component is the smallest id that is not null
(null if there is none).  Extra columns are ignored by `fingerprints` and kept by `distinct`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import annotate, fresh, made, release, remove, struct, written
from .components import components
from .words import LOWER, NOT_SPACE, mix, spans

#: Rounds of the shuffle: a constant, so the disk that one takes is this share of all points.
ROUNDS = 4
#: Points that one bin holds in a round (10 bytes each on the way, some 60 MB while it is searched).
POINTS_A_BIN = 1_000_000
SHINGLE = 3

_ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
_I, _J = np.triu_indices(64, 1)
_TWO = _ONE[_I] | _ONE[_J]
#: All flips that a fingerprint may emit: none, one bit, two bits.  Their numbers travel as 16 bits.
FLIPS = np.concatenate([np.zeros(1, np.uint64), _ONE, _TWO])


def _fingerprints(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """A bit is set where over half of a row's shingle hashes have it."""
    n = len(offsets) - 1
    start, end, row = spans(data, offsets, NOT_SPACE)
    if not len(start):
        return np.zeros(n, np.uint64)
    # the words of each row, one space between them, so that a shingle is a slice
    length = end - start
    first = np.cumsum(length + 1) - (length + 1)
    flat = np.full(int((length + 1).sum()), 0x20, np.uint8)
    take = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(first, length) + take] = LOWER[data[np.repeat(start, length) + take]]
    text = flat.tobytes()
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    k = np.maximum(count - size + 1, np.minimum(count, 1))  # shingles of each row
    own = np.repeat(np.arange(n), k)
    at = np.repeat(begin, k) + (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))
    last = np.minimum(at + size, (begin + count)[own]) - 1
    h = xxhash.xxh64_intdigest
    hashed = np.array([h(text[a:b], 42) for a, b in zip(first[at].tolist(), (first[last] + length[last]).tolist())], np.uint64)
    has = np.flatnonzero(k)
    bits = np.empty((len(has), 64), np.int64)
    edge = np.concatenate([[0], np.cumsum(k[has])])
    step = 1 << 16
    bits[:] = 0
    for a in range(0, len(hashed), step):  # 64 columns of a slice at a time
        b = min(a + step, len(hashed))
        lo, hi = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, b, "left")
        wide = np.unpackbits(hashed[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.maximum(edge[lo:hi], a) - a
        bits[lo:hi] += np.add.reduceat(wide, cuts, axis=0, dtype=np.int64)
    out = np.zeros(n, np.uint64)
    out[has] = np.packbits(2 * bits > k[has][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """docs with a struct column holding `bits`, the 64-bit SimHash as a signed long."""

    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            return struct(bits=pa.array(_fingerprints(data, offsets, shingle).view(np.int64)))

        return work

    return annotate(docs, text_col, "struct<bits:bigint>", fresh(docs, name), make)


def _emit(values: np.ndarray, share: int, rounds: int, bins: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(bins, the points of each) of one round, slice by slice; points as 64-bit points, then 16-bit numbers of their flips."""
    odd = (np.bitwise_count(values) & 1).astype(bool)
    for flips, some in ((np.arange(1, 65), values[~odd]), (np.arange(len(FLIPS)), values[odd])):
        step = max(1, most // len(flips))
        for a in range(0, len(some), step):
            point = (some[a : a + step, None] ^ FLIPS[None, flips]).ravel()
            code = np.tile(flips.astype(np.uint16), len(some[a : a + step]))
            dealt = mix(point)
            mine = np.flatnonzero(dealt & np.uint64(rounds - 1) == np.uint64(share))
            point, code = point[mine], code[mine]
            to = ((dealt[mine] >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            order = np.argsort(to.astype(np.uint32), kind="stable")
            point, code, to = point[order], code[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(to))
            if len(cut):  # one row for each bin that has points of the slice
                yield to[cut].astype(np.int32), [point[x:y].tobytes() + code[x:y].tobytes() for x, y in zip(cut.tolist(), ends.tolist())]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each kept link joined two parts when it came."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(both[: len(a)].tolist(), both[len(a) :].tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def _links(point: np.ndarray, code: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The verified links of the fingerprints that meet at equal points."""
    order = np.argsort(point, kind="stable")
    point, code = point[order], code[order]
    new = np.concatenate([[True], point[1:] != point[:-1]])
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    shared = size[group] > 1
    point, code, group = point[shared], code[shared], group[shared]
    if not len(point):
        return point, point
    value = point ^ FLIPS[code]
    one = (code >= 1) & (code <= 64)
    # the centre of a point's star is a fingerprint one bit away; without one there is no link here
    _, group = np.unique(group, return_inverse=True)
    centre = np.full(group[-1] + 1, -1)
    centre[group[one][::-1]] = np.flatnonzero(one)[::-1]
    c = centre[group]
    ok = (c >= 0) & (c != np.arange(len(c)))
    a, b = value[c[ok]], value[ok]
    low, high = np.minimum(a, b), np.maximum(a, b)
    near = (np.bitwise_count(low ^ high) <= radius) & (low != high)
    pair = np.unique(np.stack([low[near], high[near]], axis=1), axis=0)
    return _forest(pair[:, 0], pair[:, 1]) if len(pair) else (pair[:, 0], pair[:, 1])


def links(distinct: DataFrame, column: str = "bits", rounds: int = ROUNDS, points_a_bin: int = POINTS_A_BIN) -> DataFrame:
    """(a, b) longs: links that join all fingerprints within 3 bits, directly or through others.

    `distinct` has each fingerprint once and is read once a round, so give a written table.
    Every pair within 3 bits is connected by the links; every link is such a pair.
    """
    spark = distinct.sparkSession
    bins = max(1, -(-distinct.count() * 1073 // (rounds * points_a_bin)))
    most = min(1 << 22, max(1 << 20, bins << 10))  # points of a slice: with more bins larger ones, so that a bin's share of one stays worth a row
    tables = []
    for share in range(rounds):

        def emit(batches: Iterator[pa.RecordBatch], share: int = share) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for to, blobs in _emit(values, share, rounds, bins, most):
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(blobs, pa.binary())], names=["bin", "points"])

        def meet(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points, codes = [], []
            for batch in group:
                for blob in batch.column(batch.schema.get_field_index("points")):
                    raw = blob.as_buffer()
                    n = raw.size // 10
                    points.append(np.frombuffer(raw, np.uint64, n))
                    codes.append(np.frombuffer(raw, np.uint16, n, 8 * n))
            a, b = _links(np.concatenate(points), np.concatenate(codes))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        sent = distinct.select(column).mapInArrow(emit, "bin int, points binary")
        met = sent.groupBy("bin").applyInArrow(meet, "a bigint, b bigint")
        found, _ = written(met, "links")
        tables.append(found)
        release(spark)  # this round's shuffle can go before the next
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _components(prints: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(bits, root, component): for every fingerprint of (id, bits) its group's root and the smallest id reachable by links.

    With docs (th, text), pairs of alike shingle sets are links too; prints has th and the sets' columns then.
    """
    before = len(made)
    first, _ = written(prints.groupBy("bits").agg(F.min("id").alias("low")), "first")
    tree = components(links(first)) if docs is None else jaccard.groups(docs, prints, links(first))
    rooted = first.join(tree.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    rooted, _ = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named, path = written(rooted.join(lowest, "root").select("bits", "root", "component"), "named")
    for gone in [p for p in made[before:] if p != path]:  # links and trees are not read again
        remove(prints.sparkSession, gone)
    return named


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits, component) for every document; component is the smallest id reachable by links."""
    marked = fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "fp")
    prints, _ = written(marked.select("id", F.col("fp.bits").alias("bits")), "prints")
    return prints.join(_components(prints), "bits").select("id", "bits", "component")


def _described(docs: DataFrame) -> DataFrame:
    """docs (with a text) and a struct `fp`: bits, and the columns of the text's shingle set."""
    heavy = jaccard.weights(docs)

    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            return struct(bits=pa.array(_fingerprints(data, offsets, SHINGLE).view(np.int64)), **jaccard.described(data, offsets, heavy))

        return work

    return annotate(docs, "text", f"struct<bits:bigint,{jaccard.SET}>", "fp", make)


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: bool = False, null_ids: bool = False) -> DataFrame:
    """One document of each near-duplicate group: that with the group's smallest id, and one row of it.

    Groups are joined by fingerprints within 3 bits; with `alike` also by `jaccard`'s rule, sets of five-word
    shingles with a similarity of 0.8 or more.  Rows that repeat an id with another text stand in the
    group of their own text.  Rows with a null id are all kept; with `null_ids` they are members like
    others, behind every id, so that one row of each group stays.
    """
    th, key, hashed = fresh(docs, "th"), fresh(docs, "stays_id"), fresh(docs, "stays_th")
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    texts = docs.select(own.alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    marked = _described(texts) if alike else fingerprints(texts, "text", "fp")
    prints, _ = written(marked.select("id", "th", "fp.*"), "prints")
    # whole rows meet only the names of those that stay: groups are told by narrow rows, combined before the shuffle
    members = prints if null_ids else prints.where("id is not null")
    named = members.join(_components(prints, texts.select("th", "text") if alike else None).select("bits", "root"), "bits")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("first")).select("first.*")
    times = prints.groupBy(F.col("id").alias("t_id"), F.col("th").alias("t_th")).agg(F.count(F.lit(1)).alias("times"))
    stay, _ = written(first.join(times, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("th") == F.col("t_th"))).select(F.col("id").alias(key), F.col("th").alias(hashed), "times"), "stay")
    rows = docs.withColumn(th, F.xxhash64(text))
    met = lambda some: rows.join(some.select(key, hashed), own.eqNullSafe(F.col(key)) & (F.col(f"`{th}`") == F.col(hashed)), "left_semi")
    out = met(stay.where("times = 1"))
    several = stay.where("times > 1")
    if not several.isEmpty():  # rows equal in id and text: one of them
        out = out.unionByName(met(several).dropDuplicates([id_col, th]))
    if not null_ids and not prints.where("id is null").isEmpty():
        out = out.unionByName(rows.where(own.isNull()))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
