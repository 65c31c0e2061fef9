import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from loomhouse.llm import lm
from pyspark.sql import functions as F

from .helpers import documents, prose


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def brute(rows, training, deleted):
    """The whole model with dictionaries: (id, tokens, known, N, base, score) of each row."""
    every = [(i, tokens(t)) for i, t in rows]

    def counts(some):
        one, two, heads = Counter(), Counter(), Counter()
        for _, w in some:
            one.update(w)
            two.update(zip(["<s>", *w], w))
            heads.update(["<s>", *w[:-1]])
        return one, two, heads

    one, two, heads = counts([x for x in every if training(x[0])])
    r1, r2, rh = counts([x for x in every if training(x[0]) and not deleted(x[0])])
    n, v, rn, rv = sum(one.values()), len(one), sum(r1.values()), len(r1)
    cells = Counter()
    for i, w in every:
        if training(i) and deleted(i):
            for a, b in zip(["<s>", *w], w):
                c = rh[a]
                x1, x2 = r1[b] * (rv + 1) / max(rn, 1), r2[a, b] * (rv + 1) / max(c, 1)
                step = lambda x: -1000 if x == 0 else round(math.log2(x) * lm.FINE)
                cells[min(math.frexp(c)[1], lm.BUCKETS - 1), step(x1), step(x2)] += 1
    weights = lm.learn([(*k, x) for k, x in sorted(cells.items())])
    if not n:
        weights[:] = (0, 0, 1)
    out = []
    for i, w in every:
        base = score = 0.0
        for a, b in zip(["<s>", *w], w):
            l = weights[min(math.frexp(heads[a])[1], lm.BUCKETS - 1)]
            p = l[0] * two[a, b] / max(heads[a], 1) + l[1] * one[b] / max(n, 1) + l[2] / (v + 1)
            base += math.log10((one[b] + 0.1) / (n + 0.1 * (v + 1)))
            score += math.log10(p)
        out.append((i, len(w), sum(one[b] > 0 for b in w), n, base, score))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0], r[1:3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-7)


@pytest.mark.parametrize("block", [12 << 20, 700])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "SHARD", 2000)
    rows = [(i, prose(i % 23, 5 + 7 * (i % 11))) for i in range(90)] + [(200, None), (201, ""), (202, " \n"), (203, "The THE the the"), (7, prose(7, 30)), (7, prose(7, 30)), (204, prose(5, 4000))]
    remainder = lambda i: zlib.crc32(str(i).encode()) % 10
    docs = documents(spark, rows).repartition(3)
    r = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    close(lm.score(docs, r != 0, r == 1).collect(), brute(rows, lambda i: remainder(i) != 0, lambda i: remainder(i) == 1))


def test_edges(spark):
    rows = [(1, "a b"), (2, None), (None, "c")]
    docs = documents(spark, rows)
    never = F.lit(False)
    got = sorted(lm.score(docs, never, never).collect(), key=str)
    assert [(r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in got] == [(0, 0, 0, 0)] * 3
    close(lm.score(docs, F.coalesce(F.col("doc_id") == 1, F.lit(False)), never).collect(), brute(rows, lambda i: i == 1, lambda i: False))
    assert lm.score(docs.limit(0), F.lit(True), never).collect() == []


def test_learning_finds_the_mixture():
    """Cells in the shares that known weights would give lead back to the weights."""
    rng = np.random.default_rng(1)
    true = np.array([0.7, 0.2, 0.1])
    # three kinds of tokens, each likely under one estimate only
    draws = rng.choice(3, 200_000, p=true)
    cells = [(5, -1000 if k != 1 else 40, -1000 if k != 0 else 40, int((draws == k).sum())) for k in range(3)]
    got = lm.learn(cells)[5]
    assert abs(got.sum() - 1) < 1e-9 and np.abs(got - true).max() < 0.01


def test_counts_pack_and_unpack():
    counts = np.array([0, 1, 254, 255, 256, 10**12, 3], np.int64)
    assert lm._unpack(lm._pack(counts), len(counts)).tolist() == counts.tolist()


def test_another_order_is_noticed(spark):
    """Answers for other documents are refused."""
    docs = documents(spark, [(i, prose(i, 20)) for i in range(10)]).select(F.col("text"), F.lit(0).alias("cls"), F.col("doc_id").alias("id")).coalesce(1)
    answers = lm._answers(lm._requests(docs, 4))
    other = lm._blocks(docs.where("id < 9"))

    def run(texts, told):
        lm._Resolved(texts, told, "total")
        return texts

    with pytest.raises(Exception, match="another order"):
        lm._met(other, answers, run, "block string, id bigint, text string").collect()


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = lm.score(docs, r != 0, r == 1)
    base, score = out.where(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0).agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.85 * base


def test_weights_against_plain_expectation_maximisation():
    """Token by token, with no arrays: the weights that each bucket ends with."""
    rng = random.Random(8)
    cells = sorted({(rng.choice([0, 1, 2, 7, 23]), rng.choice([-1000, -8, 0, 12, 40]), rng.choice([-1000, 0, 20, 44])): rng.randint(1, 400) for _ in range(60)}.items())
    histogram = [(*k, n) for k, n in cells]
    value = lambda s: 0.0 if s <= -1000 else 2.0 ** (s / lm.FINE)
    tokens_ = [(b, (value(two), value(one), 1.0), n) for b, one, two, n in histogram]

    def em(start, some, pull):
        w = list(start)
        for _ in range(60):
            share = [pull * s + 1e-9 for s in start]
            for _, p, n in some:
                total = sum(a * b for a, b in zip(p, w))
                for k in range(3):
                    share[k] += n * p[k] * w[k] / total
            w = [s / sum(share) for s in share]
        return w

    every = em(lm.PRIOR, tokens_, 1.0)
    got = lm.learn(histogram)
    for b in range(lm.BUCKETS):
        own = [t for t in tokens_ if t[0] == b]
        want = em(every, own, 20.0) if own else every
        if b == 0:  # an unseen context says nothing
            want = [0.0, *(x / sum(want[1:]) for x in want[1:])]
        assert np.allclose(got[b], want, atol=1e-6)


def test_extra_and_clashing_columns(spark):
    docs = documents(spark, [(i, prose(i, 20)) for i in range(30)])
    r = F.col("doc_id") % 10
    plain = sorted(map(tuple, lm.score(docs, r != 0, r == 1).collect()))
    odd = docs.withColumns({c: F.lit(7) for c in ("id", "cls", "block", "kind", "shard", "total", "score", "h")})
    assert sorted(map(tuple, lm.score(odd, r != 0, r == 1).collect())) == plain
