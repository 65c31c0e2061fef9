"""Language-model scoring by deleted interpolation.

P(w | v) = l2 c(v w)/c(v) + l1 c(w)/N + l0 1/(V + 1), with weights for each bucket of the
context's frequency c(v) (a power of two).  A fold of the training texts is deleted from the
counts, and the weights are those that expectation-maximisation finds for the fold's own
tokens under the counts of the rest; the model then uses the counts of all training texts.

Counts cover the whole corpus and no table of them is broadcast or collected.  Texts are
walked in blocks of one class each (rest, deleted fold, not trained on).  A block asks for
its distinct words and word pairs, as 64-bit hashes with the block's own counts; the
requests are dealt to shards by hash (a word that fills the corpus is one row a block), a
shard adds up and answers every block in the order it asked.  Texts then meet their block's
answers.  The driver gets sums: N, V, and a histogram of bounded size for the weights.

Blocks follow the order of rows in a task's input.  Should a recomputed input come in another
order, the answers' check sums do not fit and the job fails instead of scoring wrongly.

Defined results: null and empty texts are one end token; without training texts all
probabilities are 1; without a deleted fold the weights are the prior's.  Repeated rows are
each counted and scored; null ids are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, release, strings, written
from .words import NOT_SPACE, mix, words

REST, DELETED, OTHER = 0, 1, 2
#: Bytes of text in a block, and bytes of all text for each shard.
BLOCK, SHARD = 6 << 20, 16 << 20
END, START = np.uint64(0xE17D), np.uint64(0x57A7)
#: Context frequencies from 2 ** (BUCKETS - 2) on share the last bucket; the first is that of unseen contexts.
BUCKETS = 24
#: Steps a factor of two in the histogram of probability ratios.
FINE = 4
PRIOR = (0.4, 0.5, 0.1)


def _walk(batches: Iterator[pa.RecordBatch], text: int, kind: int) -> Iterator[tuple[str, int, list[tuple[pa.RecordBatch, np.ndarray]], bool]]:
    """(block, class, [(batch, its rows)], whether the block ends here), piece by piece and in order."""
    part = TaskContext.get().partitionId()
    size, number = [0, 0, 0], [0, 0, 0]
    for batch in batches:
        _, offsets = strings(batch.column(text))
        classes = batch.column(kind).to_numpy(zero_copy_only=False)
        own = np.diff(offsets)
        for c in (REST, DELETED, OTHER):
            rows = np.flatnonzero(classes == c)
            at = 0
            while at < len(rows):
                total = size[c] + np.cumsum(own[rows[at:]])
                full = int(np.searchsorted(total, BLOCK))
                stop = min(at + full + 1, len(rows))
                ends = full < len(rows) - at
                yield f"{part}-{c}-{number[c]}", c, (batch, rows[at:stop]), ends
                size[c] = 0 if ends else int(total[-1])
                number[c] += ends
                at = stop


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every token, each row closed by END; of the token before it or START; row)."""
    n = len(offsets) - 1
    _, _, _, row, h = words(data, offsets, NOT_SPACE)
    count = np.bincount(row, minlength=n)
    last = np.cumsum(count + 1) - 1
    out = np.empty(len(h) + n, np.uint64)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside], out[last] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[last - count] = START
    return out, before, np.repeat(np.arange(n), count + 1)


def _all_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = strings(column)
    parts = [(*_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a) for a, b in pieces(offsets)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + p[3] for p in parts])


def _pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD1342543DE82EF95) + token)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each comes."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _pack(counts: np.ndarray) -> bytes:
    """One byte for a count below 255, and eight more at the end for each larger one."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=n)
    return out


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the upper half of the hash, so they rise with it."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


_REQUEST = "kind int, shard int, block string, cls int, keys binary, counts binary"
_ANSWER = "block string, cls int, kind int, shard int, total binary, rest binary, checksum bigint, n bigint, tokens bigint, known bigint, rest_tokens bigint, rest_known bigint"


def _requests(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        names: dict[int, str] = {}

        def flush(c: int) -> Iterator[pa.RecordBatch]:
            token = np.concatenate([t for t, _ in held[c]])
            pair = np.concatenate([p for _, p in held.pop(c)])
            starts = np.full(int((token == END).sum()), START)
            out = []
            for kind, values in ((0, np.concatenate([token, starts])), (1, pair)):
                keys, counts = _runs(values)
                cut = np.searchsorted(_shard(keys, shards), np.arange(shards + 1, dtype=np.uint64))
                for s in range(shards):
                    if cut[s] < cut[s + 1]:
                        out.append((kind, s, names[c], c, keys[cut[s] : cut[s + 1]].tobytes(), _pack(counts[cut[s] : cut[s + 1]])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "shard", "block", "cls", "keys", "counts"])

        for block, c, (batch, rows), ends in _walk(batches, 0, 1):
            token, before, _ = _all_tokens(batch.column(0).take(pa.array(rows)))
            held.setdefault(c, []).append((token, _pairs(before, token)))
            names[c] = block
            if ends:
                yield from flush(c)
        for c in list(held):
            yield from flush(c)

    return docs.select("text", "cls").mapInArrow(run, _REQUEST)


def _answers(requests: DataFrame) -> DataFrame:
    def add(key: tuple, table: pa.Table) -> pa.Table:
        kind, shard = (k.as_py() for k in key)
        blocks, classes = table["block"].to_pylist(), table["cls"].to_pylist()
        asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]]
        counted = [_unpack(x.as_buffer(), len(k)) for x, k in zip(table["counts"], asked)]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        edge = np.concatenate([[0], np.cumsum([len(k) for k in asked])])
        rest, total = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for c, counts, a, b in zip(classes, counted, edge, edge[1:]):
            if c != OTHER:
                own = np.bincount(at[a:b], counts, len(keys)).astype(np.int64)
                total += own
                if c == REST:
                    rest += own
        sums = [0, 0, 0, 0]
        if kind == 0:
            words_ = keys != START
            sums = [int(total[words_].sum()), int((total[words_] > 0).sum()), int(rest[words_].sum()), int((rest[words_] > 0).sum())]
        out = []
        for k, (block, c, mine, a, b) in enumerate(zip(blocks, classes, asked, edge, edge[1:])):
            check = int(np.bitwise_xor.reduce(mine).view(np.int64))
            out.append((block, c, kind, shard, _pack(total[at[a:b]]), _pack(rest[at[a:b]]) if c == DELETED else None, check, int(b - a), *(sums if k == 0 else (0, 0, 0, 0))))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 6]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["block", "cls", "kind", "shard", "total", "rest", "checksum", "n", "tokens", "known", "rest_tokens", "rest_known"])

    return requests.groupBy("kind", "shard").applyInArrow(add, _ANSWER)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, id, text): the documents with the block that asked for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, (batch, rows), _ in _walk(batches, 0, 1):
            some = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows)), some.column(2), some.column(0)], names=["block", "id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("text", "cls", "id").mapInArrow(run, f"block string, id {kind}, text string")


class _Resolved:
    """The tokens of one block with their counts."""

    def __init__(self, texts: pa.Table, told: pa.Table, which: str):
        column = texts["text"].combine_chunks() if texts.num_rows else pa.array([], pa.string())
        token, before, self.row = _all_tokens(column)
        pair = _pairs(before, token)
        self.n = len(column)
        rows = sorted(zip(told["kind"].to_pylist(), told["shard"].to_pylist(), range(told.num_rows)))
        found = {}
        for kind, values in ((0, np.concatenate([token, [START]])), (1, pair)):
            keys = _runs(values)[0]
            own = [i for k, _, i in rows if k == kind]
            check = 0
            for i in own:
                check ^= told["checksum"][i].as_py()
            if sum(told["n"][i].as_py() for i in own) != len(keys) or check != int(np.bitwise_xor.reduce(keys).view(np.int64)):
                raise RuntimeError("the documents came in another order when they were read again")
            counts = np.concatenate([_unpack(told[which][i].as_buffer(), told["n"][i].as_py()) for i in own])
            found[kind] = (keys, counts)
        look = lambda kind, values: found[kind][1][np.searchsorted(found[kind][0], values)]
        self.word, self.context, self.pair = look(0, token), look(0, before), look(1, pair)

    def bucket(self) -> np.ndarray:
        return np.minimum(np.frexp(self.context.astype(float))[1], BUCKETS - 1)

    def ratios(self, tokens: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """The two estimates over the uniform one."""
        one = self.word * ((known + 1) / max(tokens, 1))
        two = self.pair * ((known + 1) / np.maximum(self.context, 1))
        return one, two


def _step(x: np.ndarray) -> np.ndarray:
    """Which FINE-th of a factor of two a ratio falls in; -1000 for none."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * FINE), -1000).astype(np.int32)


def learn(histogram: list[tuple[int, int, int, int]], rounds: int = 60, doubt: float = 20.0) -> np.ndarray:
    """Weights (pair, word, uniform) of each bucket, from (bucket, step of word, step of pair, tokens).

    A bucket starts from, and is drawn with the force of `doubt` tokens to, the weights of all buckets together.
    """
    out = np.tile(np.array(PRIOR), (BUCKETS, 1))
    if not histogram:
        return _without_context(out)
    h = np.array(histogram, float)
    value = lambda s: np.where(s <= -1000, 0.0, 2.0 ** (s / FINE))
    p = np.stack([value(h[:, 2]), value(h[:, 1]), np.ones(len(h))], axis=1)
    n, bucket = h[:, 3], h[:, 0].astype(int)

    def em(start: np.ndarray, some: np.ndarray, pull: float) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = p[some] * w
            share *= (n[some] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) + pull * start + 1e-9
            w /= w.sum()
        return w

    every = em(np.array(PRIOR), np.ones(len(h), bool), 1.0)
    for b in range(BUCKETS):
        some = bucket == b
        out[b] = em(every, some, doubt) if some.any() else every
    return _without_context(out)


def _without_context(weights: np.ndarray) -> np.ndarray:
    """An unseen context says nothing: in its bucket the pairs' weight goes to the others."""
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def _met(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def score(docs: DataFrame, training: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every document.

    `training` marks the documents to learn from, `deleted` the fold of them for the weights.
    """
    cls = F.when(training & deleted, DELETED).when(training, REST).otherwise(OTHER)
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), cls.alias("cls"), F.col(f"`{id_col}`").alias("id"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers, _ = written(_answers(_requests(rows, max(4, -(-total // SHARD)))), "answers")
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "known", "rest_tokens", "rest_known")]).first()
    release(docs.sparkSession)
    tokens, known, rest_tokens, rest_known = (int(sums[c]) for c in ("tokens", "known", "rest_tokens", "rest_known"))

    def ratios(texts: pa.Table, told: pa.Table) -> pa.Table:
        found = _Resolved(texts, told, "rest")
        one, two = found.ratios(rest_tokens, rest_known)
        cell = np.stack([found.bucket(), _step(one), _step(two)], axis=1)
        cells, many = np.unique(cell, axis=0, return_counts=True)
        return pa.Table.from_arrays([*(pa.array(cells[:, i], pa.int32()) for i in range(3)), pa.array(many, pa.int64())], names=["b", "one", "two", "n"])

    fold = _met(_blocks(rows).where(F.col("block").contains(f"-{DELETED}-")), answers.where(F.col("cls") == DELETED), ratios, "b int, one int, two int, n bigint")
    histogram = fold.groupBy("b", "one", "two").agg(F.sum("n").alias("n")).orderBy("b", "one", "two").collect()  # at most BUCKETS x steps x steps
    weights = learn([tuple(r) for r in histogram])
    if not tokens:
        weights[:] = (0, 0, 1)

    def probabilities(texts: pa.Table, told: pa.Table) -> pa.Table:
        found = _Resolved(texts, told, "total")
        one, two = found.ratios(tokens, known)
        w = weights[found.bucket()]
        logs = np.log10((w[:, 0] * two + w[:, 1] * one + w[:, 2]) / (known + 1))
        base = np.log10((found.word + 0.1) / (tokens + 0.1 * (known + 1)))
        n = found.n
        return pa.Table.from_arrays(
            [texts["id"].combine_chunks(), pa.array(np.bincount(found.row, minlength=n), pa.int64()), pa.array(np.bincount(found.row, found.word > 0, n).astype(np.int64)), pa.array(np.full(n, tokens, np.int64)), pa.array(np.bincount(found.row, base, n)), pa.array(np.bincount(found.row, logs, n))],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = rows.schema["id"].dataType.simpleString()
    return _met(_blocks(rows), answers.select("block", "kind", "shard", "total", "checksum", "n"), probabilities, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
