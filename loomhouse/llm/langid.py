"""Language identification by character language models with interpolated Kneser-Ney smoothing.

A text is lower-cased; runs of anything but letters become one blank.  For each language
the model of order N counts n-grams of a bounded sample of labelled texts, and the lower orders
count distinct left neighbours.  The n-grams of all languages share one table for each
order: a sorted array of 64-bit hashes, and beside it one row of log probabilities (one
column for each language, already interpolated down to the uniform distribution) and one of log
back-off weights.  Texts get the language of lowest cross-entropy per character.

A part of the sample is kept out of the counts to calibrate: the mean and spread of each language's
cross-entropy set the limit beyond which a text is rejected, which is stretched until at most
FALSE_REJECTS of the texts kept out lie beyond it, and a temperature turns the differences into the probability that `score` is.

Defined results: null texts and texts without a letter are UNKNOWN with score 0, and
rejected; without any labelled text all texts are.  Ties go to the language that sorts first.
Repeated rows are each judged alone; other columns pass through.  Rows without a label or
an id are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, fresh, pieces, strings, struct
from .words import mix

UNKNOWN = "und"
ORDER = 4
#: Labelled texts that a language learns from, about (an expected number: a share of all, chosen by hash).
SAMPLE = 1500
#: One in so many of them calibrates and is not counted.
KEPT_OUT = 8
#: Nats per character, and standard errors, above a language's mean from which texts are rejected; both are
#: stretched alike until no larger share than FALSE_REJECTS of the texts kept out is.
MARGIN, ERRORS = 1.25, 8.0
FALSE_REJECTS = 0.001
_PAD = 1
RESULT = "struct<lang:string,score:double,rejected:boolean,cross_entropy:double,n_letters:bigint>"


def _alphabet() -> np.ndarray:
    """Code of each code point of the basic plane: its lower case if it is a letter, else 0, the blank."""
    out = np.zeros(0x10000, np.uint16)
    for c in range(2, 0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return out


_CODES: list[np.ndarray] = []


def _codes() -> np.ndarray:
    if not _CODES:
        _CODES.append(_alphabet())
    return _CODES[0]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all rows, each after ORDER - 1 pads and closed by a blank; row of each symbol; letters of each row)."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = points & 0xFFFF
    code = _codes()[low]
    for i in np.flatnonzero(points > 0xFFFF).tolist():  # letters beyond the basic plane share its private part
        code[i] = 0xE000 + int(points[i]) % 0x1900 if chr(int(points[i])).isalpha() else 0
    row = np.repeat(np.arange(n), np.diff(begins))
    letters = np.bincount(row[code != 0], minlength=n)
    fresh_row = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    keep = (code != 0) | fresh_row
    keep[1:] |= code[:-1] != 0
    code, row = code[keep], row[keep]
    count = np.bincount(row, minlength=n)
    pad = ORDER - 1
    width = np.where(count > 0, count + pad + 1, 0)
    first = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint16)
    whose = np.repeat(np.arange(n), width)
    has = first[count > 0]
    for k in range(pad):
        out[has + k] = _PAD
    out[first[row] + pad + (np.arange(len(row)) - (np.cumsum(count) - count)[row])] = code
    return out, whose, letters


def _grams(sym: np.ndarray, order: int) -> np.ndarray:
    """Packed n-gram that ends at each symbol from the ORDER-th on."""
    out = sym[ORDER - 1 :].astype(np.uint64)
    for k in range(1, order):
        out |= sym[ORDER - 1 - k : len(sym) - k].astype(np.uint64) << np.uint64(16 * k)
    return out


def _ends(sym: np.ndarray) -> np.ndarray:
    """Where an n-gram may end: at a symbol that is not a pad."""
    return np.flatnonzero(sym[ORDER - 1 :] != _PAD)


class Model:
    """Tables of all languages; `grams` and `counts` are one language's distinct n-grams of the full order."""

    def __init__(self, languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        alphabet = np.unique(np.concatenate([g & np.uint64(0xFFFF) for g, _ in counted]))
        self.floor = -np.log(len(alphabet) + 1.0)
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for grams, counts in counted:
            levels[ORDER].append((grams, counts.astype(np.float64)))
            for order in range(ORDER - 1, 0, -1):  # distinct left neighbours of each shorter n-gram
                above = levels[order + 1][-1][0]
                levels[order].append((lambda x: (x[0], x[1].astype(np.float64)))(np.unique(above & np.uint64((1 << 16 * order) - 1), return_counts=True)))
        width = len(languages)
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.logs: list[np.ndarray] = [np.zeros((0, width), np.float32)]
        self.heads: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.backs: list[np.ndarray] = [np.zeros((0, width), np.float32)]
        for order in range(1, ORDER + 1):
            union = np.unique(np.concatenate([g for g, _ in levels[order]]))
            heads = np.unique(union >> np.uint64(16))
            own = np.zeros((len(union), width))
            back = np.zeros((len(heads), width))
            for k, (g, c) in enumerate(levels[order]):
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2.0 * twice) if once and twice else 0.5
                at = np.searchsorted(heads, g >> np.uint64(16))
                total = np.bincount(at, c, len(heads))
                kinds = np.bincount(at, minlength=len(heads))
                seen = total > 0
                back[seen, k] = np.log(discount * kinds[seen] / total[seen])
                own[np.searchsorted(union, g), k] = np.maximum(c - discount, 0) / total[at]
            lower = self._below(union, order - 1)
            at = np.searchsorted(heads, union >> np.uint64(16))
            logs = np.log(own + np.exp(back[at] + lower))
            self._store(union, logs, heads, back)

    def _store(self, union: np.ndarray, logs: np.ndarray, heads: np.ndarray, back: np.ndarray) -> None:
        for keys, values, to_keys, to_values in ((union, logs, self.keys, self.logs), (heads, back, self.heads, self.backs)):
            hashed = mix(keys + np.uint64(0x51ED270B))
            order = np.argsort(hashed)
            to_keys.append(hashed[order])
            to_values.append(np.ascontiguousarray(values[order], np.float32))

    def _below(self, grams: np.ndarray, order: int) -> np.ndarray:
        """log p of each n-gram's last symbol in all languages, by the model of `order`."""
        if order == 0:
            return np.full((len(grams), len(self.languages)), self.floor)
        short = grams & np.uint64((1 << 16 * order) - 1) if order < 4 else grams
        return self.score(short, order)

    def score(self, grams: np.ndarray, order: int) -> np.ndarray:
        keys, logs = self.keys[order], self.logs[order]
        if not len(grams):
            return np.zeros((0, len(self.languages)), np.float32)
        hashed = mix(grams + np.uint64(0x51ED270B))
        at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        out = logs[at]
        miss = np.flatnonzero(keys[at] != hashed)
        if len(miss):
            heads, backs = self.heads[order], self.backs[order]
            hashed = mix((grams[miss] >> np.uint64(16)) + np.uint64(0x51ED270B))
            at = np.minimum(np.searchsorted(heads, hashed), len(heads) - 1)
            weight = np.where((heads[at] == hashed)[:, None], backs[at], 0)
            out[miss] = weight + self._below(grams[miss], order - 1)
        return out

    def entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy of each row and language, symbols of each row, letters of each row)."""
        n = len(offsets) - 1
        sym, whose, letters = symbols(data, offsets)
        total = np.zeros((n, len(self.languages)))
        many = np.zeros(n, np.int64)
        if len(sym):
            ends = _ends(sym)
            grams = _grams(sym, ORDER)
            step = 1 << 17  # what is looked up at once, so that temporary arrays stay small
            for a in range(0, len(ends), step):
                some = ends[a : a + step]
                own = whose[some + ORDER - 1]
                logs = self.score(grams[some], ORDER)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
            many = np.bincount(whose[ends + ORDER - 1], minlength=n)
        return -total / np.maximum(many, 1)[:, None], many, letters


def _count(sample: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams and counts for each language: counted in each task, summed, and bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            data, offsets = strings(batch.column(1))
            for lo, hi in pieces(offsets):
                sym, whose, _ = symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if not len(sym):
                    continue
                ends = _ends(sym)
                grams, own = _grams(sym, ORDER)[ends], langs[lo:hi][whose[ends + ORDER - 1]]
                for lang in np.unique(own):
                    g, c = np.unique(grams[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "g", "c"])

    summed = sample.mapInArrow(run, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c")).toArrow()
    langs = np.array(summed["lang"].to_pylist(), object)
    grams, counts = summed["g"].to_numpy().view(np.uint64), summed["c"].to_numpy()
    return {lang: (grams[langs == lang], counts[langs == lang]) for lang in sorted(set(langs))}


class Judge:
    """A model with its calibration."""

    def __init__(self, model: Model | None):
        self.model = model
        self.mean = self.spread = np.zeros(0)
        self.heat = self.stretch = 1.0

    def _excess(self, entropy: np.ndarray, many: np.ndarray) -> np.ndarray:
        """How far the lowest cross-entropy lies above its language's mean, in limits."""
        best = entropy.argmin(axis=1)
        limit = np.maximum(MARGIN, ERRORS * self.spread[best] / np.sqrt(np.maximum(many, 1)))
        return (entropy[np.arange(len(best)), best] - self.mean[best]) / limit

    def calibrate(self, langs: list[str], texts: list[str]) -> None:
        model = self.model
        data, offsets = strings(pa.array(texts, pa.large_string()))
        entropy, many, _ = model.entropy(data, offsets)
        known = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs], int)
        width = len(model.languages)
        self.mean, self.spread = np.full(width, -model.floor), np.ones(width)
        for k in range(width):
            own = (known == k) & (many > 0)
            if own.sum() >= 5:
                self.mean[k] = np.average(entropy[own, k], weights=many[own])
                self.spread[k] = np.sqrt(np.mean((entropy[own, k] - self.mean[k]) ** 2 * many[own]))
        ok = (known >= 0) & (many > 0)
        if ok.any():
            excess = np.sort(self._excess(entropy[ok], many[ok]))[::-1]
            self.stretch = max(1.0, float(excess[int(FALSE_REJECTS * len(excess))]))
            best = -np.inf
            for heat in 2.0 ** np.arange(0, 7, 0.5):  # of least log loss on the texts kept out
                logs = -entropy[ok] * heat
                logs -= logs.max(axis=1, keepdims=True)
                fit = (logs[np.arange(ok.sum()), known[ok]] - np.log(np.exp(logs).sum(axis=1))).mean()
                if fit > best + 1e-9:
                    best, self.heat = fit, float(heat)

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
        n = len(offsets) - 1
        if self.model is None:
            return struct(lang=pa.array([UNKNOWN] * n, pa.string()), score=pa.array(np.zeros(n)), rejected=pa.array(np.ones(n, bool)), cross_entropy=pa.nulls(n, pa.float64()), n_letters=pa.array(symbols(data, offsets)[2], pa.int64()))
        entropy, many, letters = self.model.entropy(data, offsets)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        score = 1 / np.exp((least[:, None] - entropy) * self.heat).sum(axis=1)
        none = letters == 0
        names = np.array([*self.model.languages, UNKNOWN], object)[np.where(none, len(self.model.languages), best)]
        return struct(
            lang=pa.array(names, pa.string()),
            score=pa.array(np.where(none, 0.0, np.clip(score, 0, 1))),
            rejected=pa.array(none | (self._excess(entropy, many) > self.stretch)),
            cross_entropy=pa.array(least, mask=none),
            n_letters=pa.array(letters, pa.int64()),
        )


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Judge:
    """Learn from the rows with an id, a text and a language; `sample` bounds the texts of each language."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`"), F.lit("langid")).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return Judge(None)
    grid = 1 << 40
    part = F.pmod(F.col("h"), F.lit(grid))
    limits = spark.createDataFrame([(k, int(v * grid)) for k, v in share.items()], "lang string, most bigint")
    taken = rows.join(F.broadcast(limits), "lang").where(part < F.col("most"))  # one short row for each language
    kept_out: Column = F.pmod(F.col("h").bitwiseXOR(F.shiftright("h", 32)), F.lit(KEPT_OUT)) == 0
    counted = _count(taken.where(~kept_out).select("lang", "text"))
    if not counted:
        return Judge(None)
    judge = Judge(Model(list(counted), list(counted.values())))
    out = taken.where(kept_out).select("lang", "text").toArrow()
    judge.calibrate(out["lang"].to_pylist(), out["text"].to_pylist())
    return judge


def identify(docs: DataFrame, judge: Judge, text_col: str = "text", name: str = "langid") -> DataFrame:
    """docs with a struct column: lang, score, rejected, cross_entropy, n_letters.

    The broadcast holds the tables, whose size the sample bounds.
    """
    sent = docs.sparkSession.sparkContext.broadcast(judge)

    def make():
        return sent.value.judge

    return annotate(docs, text_col, RESULT, fresh(docs, name), make)


def accepted(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected; columns as they were."""
    out = identify(docs, judge, text_col)
    return out.where(~F.col(f"`{out.columns[-1]}`.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
