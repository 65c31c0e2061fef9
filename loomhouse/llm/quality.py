"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are of three kinds: its words; the pieces of PIECE bytes of its words; and its shape, which
is pairs of adjacent character classes (a letter's case, digits, each punctuation mark by
itself), words said again shortly after, long and short words, lines.  Words and pieces are counted
in BUCKETS hashed columns.  Each kind's relative frequencies, damped by the square root and weighted by
inverse document frequency, are projected on the leading singular vectors of a bounded labelled
sample.  Every document's vector meets every labelled vector in one exact block of cosine
products; the nearest ones vote with their label, weighted by similarity.

The broadcast holds the projection and the labelled vectors, both bounded by the sample.
Defined results: null and empty texts have no terms and get the share of label 1 in the sample;
without any labelled row every score is 0.5.  Cosines are compared to DIGITS digits; ties among
neighbours go to the one that comes first in the sample, which is ordered by label and then by a digest of
the terms, whatever order the tasks ended in.  Repeated rows are each scored; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate, fresh, lists, pieces, strings, struct
from .labelled import sample as labelled_sample
from .words import ALNUM, NOT_SPACE, mix, running, span_hashes, words

#: Labelled documents that vote, about.
SAMPLE = 4000
DIMENSIONS = 48
#: Columns for words and for their pieces, the length of a piece in bytes, and what words and pieces count against shape.
BUCKETS = 2048
PIECE = 4
SAID = 0.25
#: Digits to which cosines are compared.
DIGITS = 5
NEIGHBOURS = 25
#: The similarity is raised to this before it weighs a vote.
SHARPNESS = 8.0
#: Texts whose terms are held at once.
ROWS = 256
#: A word counts as said again if it stood among so many words before.
LAGS = (1, 2, 3, 4, 6, 8)


def _classes() -> tuple[np.ndarray, int]:
    out = np.zeros(256, np.int64)
    names: dict[str, int] = {}
    for b in range(256):
        c = chr(b)
        if b >= 0xC0:
            kind = "lead"
        elif b >= 0x80:
            kind = "rest"
        elif c.isdigit():
            kind = "digit"
        elif c.isalpha():
            kind = "upper" if c.isupper() else "lower"
        elif b < 0x20 and c not in "\t\n":
            kind = "control"
        else:
            kind = c
        out[b] = names.setdefault(kind, len(names))
    return out, len(names)


_CLASS, _KINDS = _classes()
SHAPES = _KINDS * _KINDS + 2 * len(LAGS) + 4
TERMS = SHAPES + 2 * BUCKETS


def shapes(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """The relative frequencies of the SHAPES terms of shape of each row, into `out`."""
    n, size = len(offsets) - 1, np.diff(offsets)
    kind = _CLASS[data]
    row = np.repeat(np.arange(n), size)
    pair = kind[:-1] * _KINDS + kind[1:]
    same = row[:-1] == row[1:]
    square = _KINDS * _KINDS
    counts = np.bincount(row[:-1][same] * square + pair[same], minlength=n * square).reshape(n, square)
    out[:, :square] = counts / np.maximum(size - 1, 1)[:, None]
    _, start, end, own, h = words(data, offsets, NOT_SPACE)
    many = np.maximum(np.bincount(own, minlength=n), 1)
    at = square
    long = end - start
    for lag in LAGS:
        again = np.zeros(len(h), bool)
        if len(h) > lag:
            again[lag:] = (h[lag:] == h[:-lag]) & (own[lag:] == own[:-lag])
        for some in (again, again & (long > 4)):
            out[:, at] = np.bincount(own[some], minlength=n) / many
            at += 1
    for some in (long > 15, long <= 2, long > 30):
        out[:, at] = np.bincount(own[some], minlength=n) / many
        at += 1
    out[:, at] = np.bincount(row[data == 10], minlength=n) / many


def said(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """The relative frequencies of words, then of pieces of words, of each row, by hashed column, into `out`."""
    n = len(offsets) - 1
    lowered, start, end, own, h = words(data, offsets, ALNUM)
    many = np.maximum(end - start - PIECE + 1, 0)
    at = np.arange(int(many.sum())) + np.repeat(start - (np.cumsum(many) - many), many)
    pieces_of = mix(span_hashes(running(lowered), at, at + PIECE))
    for k, (some, rows) in enumerate(((h, own), (pieces_of, np.repeat(own, many)))):
        counts = np.bincount(rows * BUCKETS + (some % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, k * BUCKETS : (k + 1) * BUCKETS] = counts / np.maximum(np.bincount(rows, minlength=n), 1)[:, None]


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped frequencies of TERMS terms for each row."""
    out = np.zeros((len(offsets) - 1, TERMS), np.float32)
    if len(data):
        shapes(data, offsets, out[:, :SHAPES])
        said(data, offsets, out[:, SHAPES:])
    return np.sqrt(out)


def leading(matrix: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors as columns, by subspace iteration from a fixed start."""
    most = min(most, *matrix.shape)
    wide = min(most + 16, *matrix.shape)
    basis = np.random.default_rng(1).standard_normal((matrix.shape[1], wide)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    _, _, turn = np.linalg.svd(matrix @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :most], np.float32)


class Voters:
    """The projection and the labelled vectors."""

    def __init__(self, frequencies: np.ndarray, labels: np.ndarray):
        self.empty = not len(labels)
        self.share = float(labels.mean()) if len(labels) else 0.5
        if self.empty:
            return
        seen = (frequencies > 0).sum(axis=0)
        self.weight = np.where(seen > 0, np.log((1 + len(labels)) / (1 + seen)) + 0.3, 0).astype(np.float32)
        self.weight[SHAPES:] *= SAID
        self.basis = leading(frequencies * self.weight, DIMENSIONS)
        self.vectors = self.project(frequencies)
        self.labels = labels.astype(np.float32)

    def project(self, frequencies: np.ndarray) -> np.ndarray:
        latent = (frequencies * self.weight) @ self.basis
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, frequencies: np.ndarray, block: int = 512) -> np.ndarray:
        if self.empty:
            return np.full(len(frequencies), self.share)
        latent = self.project(frequencies)
        k = min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(latent))
        for a in range(0, len(latent), block):
            cosine = np.round(latent[a : a + block] @ self.vectors.T, DIGITS)
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            near, tied = cosine > least, cosine == least
            near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(axis=1, keepdims=True))
            rows, who = np.nonzero(near)
            weight = np.maximum(cosine[rows, who], 0).astype(np.float64).reshape(-1, k) ** SHARPNESS
            total = weight.sum(axis=1)
            out[a : a + block] = np.where(total > 0, (weight * self.labels[who].reshape(-1, k)).sum(axis=1) / np.maximum(total, 1e-300), self.share)
        out[~frequencies.any(axis=1)] = self.share
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Voters:
    """Learn from a bounded sample of the labelled documents; terms are counted where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in pieces(offsets):
                for c in range(a, b, ROWS):
                    e = min(c + ROWS, b)
                    found = terms(data[offsets[c] : offsets[e]], offsets[c : e + 1] - offsets[c])
                    row, col = np.nonzero(found)
                    many = np.bincount(row, minlength=e - c)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c, e - c), lists(pa.array(col.astype(np.int32)), many), lists(pa.array(found[row, col]), many)], names=["label", "term", "weight"])

    got = labelled_sample(docs, labels, label_col, sample).mapInArrow(run, "label int, term array<int>, weight array<float>").toArrow().combine_chunks()
    label = got["label"].to_numpy()
    frequencies = np.zeros((len(label), TERMS), np.float32)
    if len(label):
        many = np.array(pa.compute.list_value_length(got["term"]).to_pylist())
        frequencies[np.repeat(np.arange(len(label)), many), pa.compute.list_flatten(got["term"]).to_numpy()] = pa.compute.list_flatten(got["weight"]).to_numpy()
        order = sorted(range(len(label)), key=lambda i: (label[i], hashlib.md5(frequencies[i].tobytes()).digest()))
        frequencies, label = frequencies[order], label[order]
    return Voters(frequencies, (label > 0).astype(int))


def score(docs: DataFrame, voters: Voters, text_col: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column: `score`, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def make():
        held = sent.value

        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            ends = [*range(0, len(offsets) - 1, ROWS), len(offsets) - 1]
            parts = [held.score(terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in zip(ends, ends[1:])]
            return struct(score=pa.array(np.concatenate([np.zeros(0), *parts])))

        return work

    return annotate(docs, text_col, "struct<score:double>", fresh(docs, name), make)
