"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

Texts are split by the tokenizer's pattern and each match is encoded by itself.  Distinct
matches of a batch are put in buckets by length; a bucket is a matrix of token ids with one
row for each match, however long.  In each round every row merges its leftmost pair of least rank, found
in an open-addressed hash table of all pairs whose joined bytes are a token, and is
compacted; rows without a pair leave the matrix.  A round also takes the row's further pairs of that
rank, if one merge after the other would come to the same: if no merge makes a pair of lower rank.  So
a long row needs about as many rounds as it has distinct ranks, not as it has bytes.

Defined results: null and empty texts give no ids and no bytes; repeated rows are each
encoded; other columns pass through.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, fresh, lists, struct

#: Matches whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 250_000
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Coarse cuts that no match of public_tokenizers.PATTERN crosses: the last white character before a run of others goes with it.
_CUT = re.compile(f"[{_WHITE}]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level BPE: base64 of a token, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


class Merger:
    """Encodes single matches; the tables are built once in each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.coarse = pattern == public_tokenizers.PATTERN  # texts split by another pattern are cut by its matches alone
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        most = max(ranks.values()) + 1
        self.bits = np.uint64(max(1, int(most).bit_length()))
        keys, out = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << int(self.bits) | b)
                    out.append(rank)
        self._hash(np.array(keys, np.uint64), np.array(out, np.int64))
        size = np.zeros(most + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        self.token_size = size
        self.token_at = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.uint8)
        for token, rank in ranks.items():
            flat[self.token_at[rank] : self.token_at[rank] + len(token)] = np.frombuffer(token, np.uint8)
        self.token_bytes = flat
        self._forget()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.log = max(8, int(4 * max(1, len(keys))).bit_length())
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.slots = np.full(1 << self.log, none, np.uint64)
        self.values = np.full(1 << self.log, self.NONE, np.int32)
        rest, shift, self.probes = np.arange(len(keys)), 0, 0
        while len(rest):  # linear probing, all keys of one distance at a time
            at = (self._slot(keys[rest]) + shift) & ((1 << self.log) - 1)
            free = self.slots[at] == none
            place, first = np.unique(at[free], return_index=True)
            won = rest[free][first]
            self.slots[place] = keys[won]
            self.values[place] = ranks[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            shift += 1
        self.probes = shift

    NONE = np.int32(2**31 - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's joined token, or NONE."""
        key = (left.astype(np.uint64) << self.bits) | right.astype(np.uint64)
        at = self._slot(key)
        hit = self.slots[at] == key
        out = np.where(hit, self.values[at], self.NONE)
        todo = np.flatnonzero(~hit & (self.slots[at] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for shift in range(1, self.probes):
            if not len(todo):
                break
            at = (self._slot(key[todo]) + shift) & ((1 << self.log) - 1)
            hit = self.slots[at] == key[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (self.slots[at] != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def _matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row numbers in the order they ended, ids of each, all ids) of rows of at most `width` bytes."""
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        ids = np.zeros((n, width), np.int32)
        mask = np.arange(width)[None, :] < length[:, None]
        ids[mask] = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((n, width), self.NONE, np.int32)  # of the pair that begins at each place
        pair = mask[:, 1:]
        rank[:, :-1][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        ended, sizes, flat = [], [], []
        live = np.arange(n)
        while len(live):
            best = rank.min(axis=1)
            done = best == self.NONE
            if done.any():
                ended.append(live[done])
                sizes.append(length[done])
                flat.append(ids[done][np.arange(ids.shape[1])[None, :] < length[done][:, None]])
                keep = ~done
                live, length, best = live[keep], length[keep], best[keep]
                if not len(live):
                    break
                wide = int(length.max())
                ids, rank = ids[keep, :wide], rank[keep, :wide]
            row, at = self._chosen(ids, rank, best, length)
            width = ids.shape[1]
            # merge at `at`, and move what follows to the left
            ids[row, at] = best[row]
            if len(row) == len(live):  # one merge in each row
                column = np.arange(width - 1)[None, :]
                ids[:, :-1] = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
                rank[:, :-1] = np.where(column >= at[:, None], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = self.NONE
                length -= 1
            else:
                keep = np.arange(width)[None, :] < length[:, None]
                keep[row, at + 1] = False
                length = keep.sum(axis=1)
                to = np.cumsum(keep, axis=1) - 1
                at = to[row, at]
                mask = np.arange(width)[None, :] < length[:, None]
                for some in (ids, rank):
                    some[mask] = some[keep]
                rank[~mask] = self.NONE
            for left in (at - 1, at):  # only the pairs beside a merge are new
                ok = (left >= 0) & (left + 1 < length[row])
                r, c = row[ok], left[ok]
                rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
            rank[row, np.minimum(at, length[row] - 1)] = np.where(at + 1 < length[row], rank[row, np.minimum(at, length[row] - 1)], self.NONE)
        return np.concatenate(ended), np.concatenate(sizes), np.concatenate(flat)

    def _chosen(self, ids: np.ndarray, rank: np.ndarray, best: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the merges of a round: each row's leftmost pair of least rank, and the further
        pairs of that rank that would be merged right after it, one by one, as no merge makes a pair of lower rank."""
        row, at = np.nonzero(rank == best[:, None])
        if len(row) == len(best):
            return row, at
        new = np.ones(len(row), bool)  # of pairs that overlap, every other one, from the left
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        place = np.arange(len(row))
        odd = (place - place[new][np.cumsum(new) - 1]) % 2 == 1
        row, at = row[~odd], at[~odd]
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        made, width = best[row], ids.shape[1]
        # what stands before a merge when it is made is merged already, what stands behind it is not
        beside = np.zeros(len(row), bool)
        beside[1:] = ~first[1:] & (at[1:] == at[:-1] + 2)
        before = np.where(beside, made, ids[row, np.maximum(at - 1, 0)])
        lower = (at > 0) & (self.rank(before, made) < made)
        inside = at + 2 < length[row]
        lower |= inside & (self.rank(made, ids[row, np.minimum(at + 2, width - 1)]) < made)
        alone = np.zeros(len(best), bool)
        alone[row[lower]] = True
        keep = first | ~alone[row]
        return row[keep], at[keep]

    def merge(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, first id and number of ids of each match); a match that is a token needs no merging."""
        whole, tokens, parts = [], [], []
        buckets: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            token = self.ranks.get(row)
            if token is not None:
                whole.append(k)
                tokens.append(token)
            else:
                buckets.setdefault(-(-len(row) // 4) * 4 if len(row) <= 32 else 1 << (len(row) - 1).bit_length(), []).append(k)
        parts.append((np.array(whole, np.int64), np.ones(len(whole), np.int64), np.array(tokens, np.int32)))
        for width, own in buckets.items():
            step = max(1, (1 << 17) // width)  # a matrix stays within the processor's cache
            for a in range(0, len(own), step):
                some = own[a : a + step]
                ended, sizes, flat = self._matrix([rows[k] for k in some], width)
                parts.append((np.array(some)[ended], sizes, flat))
        order = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        first, many = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        first[order], many[order] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate([p[2] for p in parts]), first, many

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of pieces of text that are not known yet."""
        matches, many = [], np.ones(len(new), np.int64)
        for k, p in enumerate(new):
            if not self.coarse or (p[1:] if p[0] == " " else p).isalpha():  # letters, with a blank before them or not: one match
                matches.append(p)
            else:
                own = [m[0] for m in self.pattern.finditer(p)]
                matches += own
                many[k] = len(own)
        number = {m: k for k, m in enumerate(dict.fromkeys(matches))}
        flat, first, size = self.merge([m.encode() for m in number])
        which = np.fromiter(map(number.__getitem__, matches), np.int64, len(matches))
        ids = flat[_ranges(first[which], size[which])]
        edge = np.concatenate([[0], np.cumsum(size[which])])
        last = np.cumsum(many)
        at = len(self.ids)
        self.first = np.concatenate([self.first, at + edge[last - many]])
        self.many = np.concatenate([self.many, edge[last] - edge[last - many]])
        self.ids = np.concatenate([self.ids, ids])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        cut = [_CUT.findall(t) if self.coarse else [m[0] for m in self.pattern.finditer(t) if m[0]] for t in texts]
        flat = list(chain.from_iterable(cut))
        if len(self.known) > REMEMBERED:
            self._forget()
        new = list(set(flat).difference(self.known))
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        size = self.many[which]
        edge = np.concatenate([[0], np.cumsum(size)])
        ends = edge[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
        return self.ids[_ranges(self.first[which], size)], np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all rows, number of bytes of each)."""
        size = self.token_size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(lengths)]
        return self.token_bytes[_ranges(self.token_at[ids], size)], np.diff(ends, prepend=0)


_mergers: dict[tuple[str, int], Merger] = {}


def _merger(ranks: dict[bytes, int], pattern: str) -> Merger:
    key = (pattern, hash(frozenset(ranks.items())))
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(ranks, pattern)
    return _mergers[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", name: str = "bpe") -> DataFrame:
    """docs with a struct column: `ids`, the token ids of the whole text, and `decoded`, their bytes again.

    The rank file is read by the driver; a vocabulary is a bounded broadcast (under 2 MB for 50,000 tokens).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        merger = _merger(sent.value, pattern)

        def work(data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
            raw = data.tobytes()
            ids, many = merger.encode([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            flat, size = merger.decode(ids, many)
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            decoded = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(flat)])
            return struct(ids=lists(pa.array(ids, pa.int32()), many), decoded=decoded)

        work.close = merger._forget  # workers live on, and other operators need the memory
        return work

    return annotate(docs, text_col, "struct<ids:array<int>,decoded:binary>", fresh(docs, name), make)


def decode(table: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """table with the bytes of its token ids; null ids give no bytes.  An id outside the vocabulary, and a null within a list, raises."""
    name = fresh(table, name)
    sent = table.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        merger = _merger(sent.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("an id outside the vocabulary")
            ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
            many = np.array([0 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()], np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(merger.token_size) or not merger.token_size[ids].all()):
                raise ValueError("an id outside the vocabulary")
            flat, size = merger.decode(ids, many)
            edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            out = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return table.mapInArrow(run, T.StructType(table.schema.fields + [T.StructField(name, T.BinaryType())]))
