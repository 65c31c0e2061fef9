"""Toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and word beginnings (of the lengths in STEMS, so
that forms of one stem share a feature).  Those that tell the labels of a bounded sample apart are
kept, and a logistic regression is fitted to them with a small L1 and L2 penalty.

Every labelled text has PAIRS counterfactual versions: if it mentions identity terms, all of them are
swapped for others of their groups; if it mentions none, a mention is inserted.  What is fitted
is the mean log loss of the texts, AUGMENTED times that of their versions under the same labels,
and COUNTERFACTUAL times the mean squared difference of the logits of a text and its version
(counterfactual logit pairing), so that a mention of a group by itself moves the score little,
whatever the labels' bias and whether or not the labelled texts mention the group.

The broadcast holds one weight for each kept feature, bounded by FEATURES.
Defined results: null and empty texts get the score of a text without any known word; without
labels, or with labels of one kind only, every score is that kind's smoothed share.  Repeated
rows are each scored; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate, fresh, lists, pieces, strings, struct
from .labelled import sample as labelled_sample
from .words import ALNUM, LOWER, mix, running, span_hashes, spans

#: Labelled documents to learn from, about; features that the model keeps at most.
SAMPLE = 6000
FEATURES = 20_000
#: Counterfactual versions of a labelled text; weights of their log loss and of the squared change of the logit.
PAIRS = 2
AUGMENTED = 0.25
COUNTERFACTUAL = 1.0
L1, L2 = 3e-5, 1e-5
#: Bytes of the word beginnings that are features.
STEMS = (4, 5, 6, 7)

# Identity terms, one group in each line; any two of a line may be swapped.
IDENTITY = """
men women man woman boy girl boys girls male female transgender nonbinary
gay lesbian bisexual straight queer homosexual heterosexual
christian muslim jewish hindu buddhist sikh atheist catholic protestant christians muslims jews hindus buddhists sikhs atheists catholics
black white asian latino hispanic african european arab indian indigenous
american mexican chinese german french spanish turkish polish russian syrian
immigrant immigrants refugee refugees migrant migrants citizen citizens
old young elderly teenager
blind deaf disabled autistic
männer frauen mann frau
hommes femmes homme femme
hombres mujeres hombre mujer
"""


_terms: list[tuple[list[tuple[int, int]], list[list[np.ndarray]], dict[int, tuple[int, int]]]] = []


def terms() -> tuple[list[tuple[int, int]], list[list[np.ndarray]], dict[int, tuple[int, int]]]:
    """All (group, place) of IDENTITY, each term's feature hashes (the whole word first), and the term of a word's hash."""
    if not _terms:
        own = []
        for line in IDENTITY.strip().splitlines():
            h, row = features(*strings(pa.array(line.split())))
            own.append([h[row == k] for k in range(len(line.split()))])
        every = [(g, k) for g, group in enumerate(own) for k in range(len(group))]
        _terms.append((every, own, {int(own[g][k][0]): (g, k) for g, k in every}))
    return _terms[0]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and of every beginning of a longer word."""
    total = running(LOWER[data])
    start, end, row = spans(data, offsets, ALNUM)
    out, own = [span_hashes(total, start, end)], [row]
    for k in STEMS:
        longer = end - start > k
        at = start[longer]
        out.append(mix(span_hashes(total, at, at + k) + np.uint64(k)))
        own.append(row[longer])
    return np.concatenate(out), np.concatenate(own)


def distinct_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each row's distinct features, number of them)."""
    h, row, _ = _counted(data, offsets)
    return h, np.bincount(row, minlength=len(offsets) - 1)


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) of each row's distinct features."""
    h, row = features(data, offsets)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new], np.diff(np.append(np.flatnonzero(new), len(h)))


class Examples:
    """Texts as features: `h` (`many` for each text); and for each feature in which a version differs from its text,
    its hash `f`, +1 if it comes and -1 if it goes `s`, and the version `p`, counted over all texts (PAIRS for each)."""

    def __init__(self, h: np.ndarray, many: np.ndarray, f: np.ndarray, s: np.ndarray, p: np.ndarray):
        self.h, self.many, self.f, self.s, self.p = h, many, f, s, p


def examples(data: np.ndarray, offsets: np.ndarray) -> Examples:
    """The texts' features and their counterfactual versions; the partners of a swap follow from the text's features alone."""
    every, own, known = terms()
    h, row, times = _counted(data, offsets)
    many = np.bincount(row, minlength=len(offsets) - 1)
    edge = np.concatenate([[0], np.cumsum(many)])
    words = np.sort(np.array(list(known), np.uint64))
    some = words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h
    f, s, p = [], [], []
    for r in range(len(many)):
        a, b = edge[r], edge[r + 1]
        seed = int(np.bitwise_xor.reduce(h[a:b])) if b > a else 0
        mentions = [(known[int(x)], int(n)) for x, n in zip(h[a:b][some[a:b]], times[a:b][some[a:b]])]
        for k in range(PAIRS):
            change: dict[int, int] = {}
            if mentions:
                swaps = [(own[g][t], own[g][(t + 1 + (seed + k) % (len(own[g]) - 1)) % len(own[g])], n) for (g, t), n in mentions]
            else:
                g, t = every[(seed // PAIRS * PAIRS + k) % len(every)]
                swaps = [(own[g][t][:0], own[g][t], 1)]
            for goes, comes, n in swaps:
                for x in goes.tolist():
                    change[x] = change.get(x, 0) - n
                for x in comes.tolist():
                    change[x] = change.get(x, 0) + n
            for x, n in change.items():
                at = a + int(np.searchsorted(h[a:b], np.uint64(x)))
                had = int(times[at]) if at < b and int(h[at]) == x else 0
                if (had > 0) != (had + n > 0):
                    f.append(x)
                    s.append(1 if had == 0 else -1)
                    p.append(r * PAIRS + k)
    return Examples(h, many, np.array(f, np.uint64), np.array(s, np.int64), np.array(p, np.int64))


class Classifier:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias

    def logit(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        if not len(self.keys):
            return out
        h, row = features(data, offsets)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        pair = np.unique(row[hit] * len(self.keys) + at[hit])  # each feature once for each text
        return out + np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(data, offsets), -500, 500)))


def fit(of: Examples, label: np.ndarray, counterfactual: float = COUNTERFACTUAL, augmented: float = AUGMENTED, most: int = FEATURES, steps: int = 400) -> Classifier:
    """The classifier of labelled texts; `label` is 0 or 1."""
    n, many = len(label), of.many
    if label.min(initial=1) == label.max(initial=0) or n == 0:
        share = (label.sum() + 0.5) / (n + 1)
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    row = np.repeat(np.arange(n), many)
    keys, col = np.unique(of.h, return_inverse=True)
    ones = np.bincount(col, label[row], len(keys))
    zeros = np.bincount(col, 1 - label[row], len(keys))
    p1, p0 = (ones + 0.5) / (label.sum() + 1), (zeros + 0.5) / (n - label.sum() + 1)
    pooled = (ones + zeros + 1) / (n + 2)
    z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / (label.sum() + 1) + 1 / (n - label.sum() + 1)))
    keep = (ones + zeros >= 3) & (np.abs(z) > 3)
    if keep.sum() > most:
        keep &= np.abs(z) >= np.sort(np.abs(z[keep]))[-most]
    kept = np.union1d(keys[keep], of.f)  # what a version changes is always kept
    place = np.minimum(np.searchsorted(kept, keys), len(kept) - 1) if len(kept) else np.zeros(len(keys), np.int64)
    some = (kept[place] == keys)[col] if len(kept) else np.zeros(len(col), bool)
    row, col, keys = row[some], place[col[some]], kept
    width, versions = len(keys), n * PAIRS
    of_version = np.arange(versions) // PAIRS
    at = np.searchsorted(keys, of.f)
    x = lambda w: np.bincount(row, w[col], n)
    xt = lambda r: np.bincount(col, r[row], width)
    d = lambda w: np.bincount(of.p, of.s * w[at], versions)
    dt = lambda r: np.bincount(at, of.s * r[of.p], width)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
    y = label[of_version]

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        plain, change = x(w) + bias, d(w)
        error = (sigmoid(plain) - label) / n
        other = augmented * (sigmoid(plain[of_version] + change) - y) / versions
        g = xt(error + np.bincount(of_version, other, n)) + dt(other + 2 * counterfactual * change / versions) + L2 * w
        return g, float(error.sum() + other.sum())

    # accelerated proximal steps, each column scaled by its own bound of the curvature
    differ = np.bincount(of.p, minlength=versions)
    long = np.bincount(row, minlength=n) + 1 + 2 * differ.max(initial=0)
    curve = 0.25 * (1 + augmented) / n * np.bincount(col, long[row], width) + L2
    curve += np.bincount(at, (0.25 * augmented * long[of_version] + 2 * counterfactual * differ)[of.p], width) / versions
    w = ahead = np.zeros(width)
    bias = bias_ahead = float(np.log(label.mean() / (1 - label.mean())))
    t = 1.0
    for _ in range(steps):
        g, gb = gradient(ahead, bias_ahead)
        new = ahead - g / curve
        new = np.sign(new) * np.maximum(np.abs(new) - L1 / curve, 0)
        new_bias = bias_ahead - gb / (0.25 * (1 + augmented) * long.max())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    told = w != 0
    return Classifier(keys[told], w[told], bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, counterfactual: float = COUNTERFACTUAL) -> Classifier:
    """Learn from a bounded sample of the labelled documents; the driver gets hashes, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in pieces(offsets):
                of = examples(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                each = np.bincount(of.p // PAIRS, minlength=b - a)
                columns = [lists(pa.array(of.h.view(np.int64)), of.many), lists(pa.array(of.f.view(np.int64)), each), lists(pa.array(of.s.astype(np.int8)), each), lists(pa.array((of.p % PAIRS).astype(np.int8)), each)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["label", "h", "f", "s", "p"])

    got = labelled_sample(docs, labels, label_col, sample).mapInArrow(run, "label int, h array<bigint>, f array<bigint>, s array<tinyint>, p array<tinyint>").toArrow().combine_chunks()
    flat = lambda name: pa.compute.list_flatten(got[name]).to_numpy()
    sizes = lambda name: np.array(pa.compute.list_value_length(got[name]).to_pylist(), np.int64)
    p = np.repeat(np.arange(len(got)), sizes("f")) * PAIRS + flat("p")
    of = Examples(flat("h").astype(np.int64).view(np.uint64), sizes("h"), flat("f").astype(np.int64).view(np.uint64), flat("s").astype(np.int64), p)
    return fit(of, (got["label"].to_numpy() > 0).astype(int), counterfactual)


def score(docs: DataFrame, classifier: Classifier, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with a struct column: `score`, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        held = sent.value

        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            return struct(score=pa.array(held.score(data, offsets)))

        return work

    return annotate(docs, text_col, "struct<score:double>", fresh(docs, name), make)
