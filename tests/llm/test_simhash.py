import re

import numpy as np
import xxhash
from loomhouse.llm import simhash

from .helpers import DOC, documents, prose


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(prints):
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_whole_query_against_brute_force(spark):
    base = [prose(s, 120) for s in range(12)]
    texts = [*base, *base[:4], None, "", " \n ", "one", "One", "two words", "a\x0bb\x0cc d"]
    for k, t in enumerate(base):  # near copies: a word or two changed
        w = t.split(" ")
        for j in range(6):
            w[(17 * j + k) % len(w)] = f"new{j}"
            texts.append(" ".join(w))
    texts.append(prose(99, 9000))
    docs = documents(spark, list(enumerate(texts)))
    got = {r["id"]: (r["bits"] % 2**64, r["component"]) for r in simhash.classes(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: g[0] for i, g in got.items()} == prints
    assert {i: g[1] for i, g in got.items()} == brute_components(prints)


def test_links_find_every_distance(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    values = set(base.tolist())
    for x in base.tolist():
        for d in (1, 2, 3, 4, 5):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            values.add(y)
    chain = int(base[0])
    for b in range(0, 30, 3):
        chain ^= 7 << b
        values.add(chain)
    prints = dict(enumerate(sorted(values)))
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "bits bigint")
    tree = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(simhash.links(frame, rounds=2, points_a_bin=20000)).collect()}
    want = {prints[i]: prints[r] for i, r in brute_components(prints).items()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    assert groups({v: tree.get(v, v) for v in values}) == groups(want)
    for r in simhash.links(frame).collect():
        assert 0 < bin((r["a"] ^ r["b"]) % 2**64).count("1") <= 3


def test_distinct_keeps_one_of_each_group_and_columns(spark):
    t = prose(1, 80)
    rows = [(3, t, "a", 1), (1, t, "b", 2), (1, t, "b", 2), (2, prose(2, 80), None, None), (None, t, "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, bits int")
    out = simhash.distinct(docs)
    assert out.columns == docs.columns
    assert sorted(out.collect(), key=str) == sorted([spark.createDataFrame([r], docs.schema).first() for r in (rows[1], rows[3], rows[4])], key=str)


def test_empty_table(spark):
    assert simhash.classes(spark.createDataFrame([], DOC)).collect() == []
    assert simhash.distinct(spark.createDataFrame([], DOC)).collect() == []
