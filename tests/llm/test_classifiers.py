import math
import re

import numpy as np
import pyarrow as pa
from loomhouse.llm import quality, toxicity
from loomhouse.llm.common import in_fold, strings
from pyspark.sql import functions as F

from .helpers import DOC, documents, prose

DATA = "/root/testdata/sf0.01"


def held_out(spark, operator, label):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    kept = in_fold("doc_id", 5, 0)
    model = operator.train(docs, labels.where(~kept))
    got = operator.score(docs.select("doc_id", "text").where(kept), model, name="s").join(labels, "doc_id").select(label, "s.score").collect()
    return [r[0] for r in got], [r[1] for r in got]


def test_quality_on_held_out_documents(spark):
    y, s = held_out(spark, quality, "quality")
    assert all(0 <= x <= 1 for x in s)
    assert np.mean([(x >= 0.3) == bool(t) for t, x in zip(y, s)]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    y, s = held_out(spark, toxicity, "toxic")
    assert np.mean([(x >= 0.5) == bool(t) for t, x in zip(y, s)]) > 0.95
    assert np.mean([t for t, x in zip(y, s) if x >= 0.5]) > 0.75  # few labels at this size


def test_votes_are_exact_blocked_cosines():
    texts = [prose(k, 30) for k in range(40)] + [(prose(k, 5) + " *** %%% ") * 6 for k in range(40)]
    labels = np.array([1] * 40 + [0] * 40)
    data, offsets = strings(pa.array(texts))
    found = quality.terms(data, offsets)
    voters = quality.Voters(found, labels)
    for block in (7, 512):
        got = voters.score(found, block)
        vectors = voters.project(found).astype(float)
        for k in range(len(texts)):
            cosine = [float(vectors[k] @ v) for v in vectors]
            near = sorted(range(len(texts)), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
            weight = [max(cosine[i], 0) ** quality.SHARPNESS for i in near]
            assert math.isclose(got[k], sum(w * labels[i] for w, i in zip(weight, near)) / sum(weight), abs_tol=1e-3)
    assert ((got >= 0.5) == (labels == 1)).all()


def test_ties_go_to_the_first_of_the_sample():
    """Hundreds of equal neighbours: the first ones vote."""
    data, offsets = strings(pa.array(["one two three four"] * 300))
    found = quality.terms(data, offsets)
    for first in (0, 1):
        labels = np.array([first] * quality.NEIGHBOURS + [1 - first] * (300 - quality.NEIGHBOURS))
        assert quality.Voters(found, labels).score(found[:3]).tolist() == [first] * 3


def test_projection_is_on_the_leading_singular_vectors():
    texts = [prose(k, 40) for k in range(120)]
    found = quality.terms(*strings(pa.array(texts)))
    voters = quality.Voters(found, np.arange(120) % 2)
    weighted = (found * voters.weight).astype(float)
    _, values, right = np.linalg.svd(weighted, full_matrices=False)
    best = np.linalg.norm(weighted - weighted @ right[: quality.DIMENSIONS].T @ right[: quality.DIMENSIONS])
    own = np.linalg.norm(weighted - weighted @ voters.basis @ voters.basis.T)
    assert voters.basis.shape == (quality.TERMS, quality.DIMENSIONS) and own < 1.02 * best


def test_words_and_pieces_by_hand():
    """Each word and each piece is counted once in a column of its own kind."""
    text = "Abcdef abcdef x, longer-word abcd ÜBER"
    n = quality.BUCKETS
    out = quality.terms(*strings(pa.array([text])))[0, quality.SHAPES :] ** 2
    lowered = [w.encode() for w in "abcdef abcdef x longer word abcd".split()] + ["ÜBER".encode().replace(b"BER", b"ber")]
    pieces = [w[i : i + quality.PIECE] for w in lowered for i in range(len(w) - quality.PIECE + 1)]
    for some, part in ((lowered, out[:n]), (pieces, out[n:])):
        want = sorted(some.count(x) / len(some) for x in set(some))
        assert math.isclose(part.sum(), 1, abs_tol=1e-5) and np.allclose(sorted(part[part > 0]), want, atol=1e-6)


def test_terms_do_not_touch_neighbours():
    texts = ["Ab, c!", "", "x x x", "Über  12"]
    data, offsets = strings(pa.array(texts))
    together = quality.terms(data, offsets)
    for k, t in enumerate(texts):
        assert (quality.terms(*strings(pa.array([t])))[0] == together[k]).all()


def test_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, prose(1, 50)), (3, prose(1, 50)), (4, "x " * 50_000), (None, "y")])
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 1), (9, 1, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    none = labels.limit(0)
    for operator in (quality, toxicity):
        for some in (labels, none, labels.where("doc_id = 3")):
            scored = operator.score(docs.withColumnRenamed("lang", operator.__name__.split(".")[-1]), operator.train(docs, some))
            assert scored.columns[-1].endswith("_")
            got = [r[0] for r in scored.select(F.col(f"`{scored.columns[-1]}`.score")).collect()]
            assert len(got) == 6 and all(0 <= x <= 1 for x in got)
        assert operator.score(spark.createDataFrame([], DOC), operator.train(docs, labels)).collect() == []


def _fit(texts, labels, counterfactual):
    return toxicity.fit(toxicity.examples(*strings(pa.array(texts))), np.array(labels), counterfactual)


def _biased(mentioned=True):
    """Labels that hold against one group; without `mentioned` no text names any group."""
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for k in range(600):
        toxic = k % 3 == 0
        words = [f"w{rng.integers(60)}" for _ in range(12)]
        if toxic and rng.random() < 0.8:
            words.append("idiot")
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslims")
        elif rng.random() < 0.3:
            words.append("christians")
        texts.append(" ".join(w for w in words if mentioned or w not in ("muslims", "christians")))
        labels.append(int(toxic))
    return texts, labels


def test_swaps_of_identity_terms_are_penalised():
    """A group that the labels hold against is forgiven by the counterfactual term, an insult is not."""
    texts, labels = _biased()
    ask = strings(pa.array(["the muslims w1 w2", "the christians w1 w2", "you idiot w1 w2"]))
    plain, fair = _fit(texts, labels, 0.0).score(*ask), _fit(texts, labels, toxicity.COUNTERFACTUAL).score(*ask)
    assert plain[0] > 0.5 and abs(plain[0] - plain[1]) > 0.3
    assert fair[0] < 0.5 and abs(fair[0] - fair[1]) < abs(plain[0] - plain[1]) / 3 and fair[2] > 0.5


def test_false_positives_on_neutral_mentions():
    """Measured: neutral sentences that name the group, with the penalty and without."""
    texts, labels = _biased()
    rng = np.random.default_rng(4)
    ask = strings(pa.array([" ".join(["muslims", *(f"w{rng.integers(60)}" for _ in range(12))]) for _ in range(200)]))
    share = lambda weight: (_fit(texts, labels, weight).score(*ask) >= 0.5).mean()
    assert share(0.0) > 0.5 and share(toxicity.COUNTERFACTUAL) < 0.05


def test_penalty_acts_where_no_text_names_a_group():
    """Mentions are inserted: what the labels of few texts would teach about a group is taken back."""
    texts, labels = _biased(mentioned=False)
    spread = lambda weight: np.ptp(_fit(texts, labels, weight).logit(*strings(pa.array([f"w1 {t}" for t in toxicity.IDENTITY.split()]))))
    assert spread(toxicity.COUNTERFACTUAL) < spread(0.0) / 5


def _words(text):
    return [w.lower().encode() for w in re.findall(r"[0-9A-Za-z]+", text)]


def test_versions_against_swapped_sentences():
    """Each version's features are those of the sentence with its mentions swapped, or with one put in."""
    texts = ["The women met women and a Black man", "no mention at all", "", "old men, older menace", "Muslims muslimsx christians"]
    of = toxicity.examples(*strings(pa.array(texts)))
    groups = [line.split() for line in toxicity.IDENTITY.strip().splitlines()]
    hashed = lambda words: set(toxicity.distinct_features(*strings(pa.array([b" ".join(words).decode()])))[0].tolist())
    edge = np.concatenate([[0], np.cumsum(of.many)])
    for r, text in enumerate(texts):
        words = _words(text)
        plain = set(of.h[edge[r] : edge[r + 1]].tolist())
        assert plain == hashed(words)
        for k in range(toxicity.PAIRS):
            mine = of.p == r * toxicity.PAIRS + k
            version = (plain - set(of.f[mine & (of.s < 0)].tolist())) | set(of.f[mine & (of.s > 0)].tolist())
            places = [[t.encode() for t in g] for g in groups]
            mentions = [g for g in places if set(g) & set(words)]
            if not mentions:
                assert any(version == hashed([*words, t]) for g in places for t in g)
                continue
            partner = lambda w, shift: next((g[(g.index(w) + 1 + shift % (len(g) - 1)) % len(g)] for g in mentions if w in g), w)
            wanted = [hashed([partner(w, shift) for w in words]) for shift in range(math.lcm(*[len(g) - 1 for g in mentions]))]
            assert version in wanted


def test_fit_is_the_optimum_of_its_objective():
    """Against plain dense gradients: no weight can be moved for the better."""
    texts, labels = _biased()
    of, y = toxicity.examples(*strings(pa.array(texts))), np.array(labels)
    made = toxicity.fit(of, y, steps=6000)
    keys = made.keys.tolist()
    place = {k: i for i, k in enumerate(keys)}
    x = np.zeros((len(texts), len(keys)))
    edge = np.concatenate([[0], np.cumsum(of.many)])
    for r in range(len(texts)):
        for f in of.h[edge[r] : edge[r + 1]].tolist():
            if f in place:
                x[r, place[f]] = 1
    versions = np.repeat(x, toxicity.PAIRS, axis=0)
    for f, s, p in zip(of.f.tolist(), of.s, of.p):
        if f in place:
            versions[p, place[f]] += s
    assert set(np.unique(versions)) <= {0.0, 1.0}
    twice, both = np.repeat(y, toxicity.PAIRS), np.repeat(x, toxicity.PAIRS, axis=0)
    error = lambda m, t: 1 / (1 + np.exp(-(m @ made.weights + made.bias))) - t
    change = (versions - both) @ made.weights
    g = x.T @ error(x, y) / len(y) + toxicity.AUGMENTED * versions.T @ error(versions, twice) / len(twice)
    g += 2 * toxicity.COUNTERFACTUAL * (versions - both).T @ change / len(twice) + toxicity.L2 * made.weights
    assert np.abs(g + toxicity.L1 * np.sign(made.weights)).max() < 2e-5


def test_distinct_features_by_hand():
    h, many = toxicity.distinct_features(*strings(pa.array(["abcdef abcdef ab", "", "AB"])))
    assert many.tolist() == [2 + sum(k < 6 for k in toxicity.STEMS), 0, 1] and h[-1] in h[:-1]
