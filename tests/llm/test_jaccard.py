import random
import re

import pytest
from loomhouse.llm import jaccard, simhash

from .helpers import DOC, documents, prose
from .test_simhash import brute_fingerprint


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The smallest id of each text's group, by both rules."""
    prints, sets = [brute_fingerprint(t) for t in texts], [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 3 or (either and 5 * both >= 4 * either):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def drawn():
    r, texts = random.Random(3), ["", None, "one", "two words", "x y z", "x y z"]
    for k in range(14):
        base = prose(k, r.choice([12, 40, 60, 150])).split(" ")
        texts.append(" ".join(base))
        for j in range(r.choice([1, 2, 12])):  # chains as well: each copy from the base or the copy before
            copy = list(base if j % 3 else texts[-1].split(" "))
            for _ in range(r.randint(1, max(1, len(base) // 35))):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    common = prose(500, 60)
    texts += [f"{prose(600 + k, 10)} {common} {prose(700 + k, 4)}" for k in range(12)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("rows_a_bin", [7, 50_000])
def test_pairs_beyond_three_bits_meet(spark, monkeypatch, rows_a_bin):
    monkeypatch.setattr(jaccard, "ROWS_A_BIN", rows_a_bin)
    monkeypatch.setattr(jaccard, "ENTRIES_A_BIN", 10 * rows_a_bin)
    texts = drawn()
    want = sorted(set(brute(texts)))
    frame = documents(spark, list(enumerate(texts))).repartition(3)
    assert sorted(r["doc_id"] for r in simhash.distinct(frame, alike=True).collect()) == want
    assert simhash.distinct(frame).count() > len(want)  # the fingerprints alone keep some


def test_empty_table(spark):
    assert simhash.distinct(spark.createDataFrame([], DOC), alike=True).collect() == []


def test_stage_drops_a_near_copy_beyond_three_bits(spark):
    import corpus_pipeline

    base = prose(8, 100).split(" ")
    for k in range(1000):
        copy = list(base)
        copy[30], copy[70] = f"p{k}", f"q{k}"
        a, b = " ".join(base), " ".join(copy)
        if (brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() > 3:
            break
    both = shingles(a) & shingles(b)
    assert 5 * len(both) >= 4 * len(shingles(a) | shingles(b))
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, [(4, b), (3, a)]), "").collect()] == [3]


def test_stage_keeps_one_row_of_a_group_with_null_ids(spark):
    import corpus_pipeline

    t, u = prose(1, 80), prose(2, 80)
    rows = [(None, t), (3, t), (None, t), (None, u), (None, u), (None, f"{u} more")]
    out = [tuple(r) for r in corpus_pipeline.near_dedup(spark, documents(spark, rows).repartition(3), "").select("doc_id", "text").collect()]
    assert len(out) == 2 and (3, t) in out and {i for i, x in out if x != t} == {None}
