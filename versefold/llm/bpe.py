"""Byte-level BPE over a whole corpus with numpy matrices (problem 7).

Every pretoken becomes a row of byte ids in a padded matrix of its length bucket. In each round every row merges its
leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table in numpy arrays, and rows that
have no pair left are written out and compacted away. A pretoken wider than the widest bucket is a matrix of its own, in
which a round merges all places of the minimum-rank pair at once. There is no Python loop over tokens or texts' bytes.

Defined cases: a null text has null ids, an empty text has an empty list. Blank texts have the ids of their blanks.
Lone surrogates cannot occur in Parquet strings. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary file, where no other one is named.
TOKENIZER = os.environ.get("VERSEFOLD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern published with the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int32(2**31 - 1)
BUCKETS = (4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 512)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """rank of (left id, right id), NONE if the pair does not merge: linear probing, a load of at most a quarter."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        todo, slot = np.arange(len(key)), self._slot(key)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for one slot the last one stays
            won = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MUL) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left, right: int arrays of one shape; a negative id never merges."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slot = self._slot(key)
        out = np.full(key.shape, NONE, np.int32)
        found = self.keys[slot]
        hit = found == key
        out[hit] = self.ranks[slot[hit]]
        todo = np.flatnonzero(~hit & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out.reshape(left.shape)


def _parse(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """The vocabulary of a tiktoken rank file, ready for numpy."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))

    @classmethod
    def load(cls, path: str = TOKENIZER) -> Encoder:
        with open(path, "rb") as f:
            return cls(_parse(f))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        n = len(words)
        count = np.zeros(n, np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, n)
        count[whole >= 0] = 1
        rest = np.flatnonzero(whole < 0)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # row numbers, ids: of each finished set
        if len(rest):
            lens = np.fromiter((len(words[i]) for i in rest), np.int64, len(rest))
            order = np.argsort(lens, kind="stable")
            rest, lens = rest[order], lens[order]
            data = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
            starts = np.concatenate(([0], np.cumsum(lens)))
            lo = 0
            for edge in BUCKETS:
                hi = int(np.searchsorted(lens, edge, "right"))
                step = max(1, (1 << 21) // edge)
                for a in range(lo, hi, step):
                    b = min(hi, a + step)
                    self._bucket(rest[a:b], lens[a:b], data[starts[a] : starts[b]], parts)
                lo = hi
            for i in range(lo, len(lens)):
                parts.append((rest[i : i + 1], self._long(data[starts[i] : starts[i + 1]])[None, :]))
        for rows, ids in parts:
            count[rows] = (ids >= 0).sum(1)
        offset = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(offset[-1], np.int32)
        one = np.flatnonzero(whole >= 0)
        out[offset[one]] = whole[one]
        for rows, ids in parts:
            keep = ids >= 0
            c = keep.sum(1)
            at = np.repeat(offset[rows] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
            out[at] = ids[keep]
        return out, count

    def _bucket(self, rows: np.ndarray, lens: np.ndarray, data: np.ndarray, parts: list) -> None:
        """Merges the words of one length bucket; appends (rows, ids padded with -1)."""
        n, width = len(rows), int(lens.max())
        ids = np.full((n, width + 1), -1, np.int32)  # the last column stays -1: what lies beyond a row
        column = np.arange(width)
        ids[:, :width][column[None, :] < lens[:, None]] = self.byte[data]
        rank = np.full((n, width), NONE, np.int32)
        rank[:, : width - 1] = self.pairs(ids[:, : width - 1], ids[:, 1:width])
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        row = np.arange(n)
        while n:
            j = rank.argmin(1)
            best = rank[row, j]
            live = best != NONE
            gone = n - int(live.sum())
            if gone == n or gone * 4 > n or gone and n < 256:  # compaction
                parts.append((rows[~live], ids[~live]))
                rows, ids, rank, after, before, j, best = (x[live] for x in (rows, ids, rank, after, before, j, best))
                n = len(rows)
                row = np.arange(n)
                if not n:
                    return
                r = row
            elif gone:
                r = row[live]
                j, best = j[live], best[live]
            else:
                r = row
            k = after[r, j]
            m = np.minimum(after[r, k], width)
            ids[r, j] = best
            ids[r, k] = -1
            after[r, j] = m
            before[r, m] = j
            rank[r, k] = NONE
            right = ids[r, m]
            rank[r, j] = self.pairs(best, right)
            p = before[r, j]
            q = np.flatnonzero(p >= 0)
            rq, pq = r[q], p[q]
            rank[rq, pq] = self.pairs(ids[rq, pq], best[q])

    def _long(self, data: np.ndarray) -> np.ndarray:
        """One very long pretoken: each round merges every occurrence of the minimum-rank pair, from the left.

        The same as one leftmost merge a round: a pair that a merge creates holds the new token, so that its rank is higher,
        and until no pair of this rank is left the leftmost one is next. Of overlapping places every other one counts.
        """
        ids = self.byte[data]
        rank = self.pairs(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            begin = np.append(True, np.diff(at) > 1)  # of a run of neighbouring places
            at = at[(at - at[begin][np.cumsum(begin) - 1]) % 2 == 0]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
            now = at - np.arange(len(at))  # places after the merge
            rank = np.append(rank, NONE)[keep][: len(ids) - 1] if len(ids) > 1 else rank[:0]
            touched = np.unique(np.concatenate((now, now - 1)))
            touched = touched[(touched >= 0) & (touched < len(rank))]
            rank[touched] = self.pairs(ids[touched], ids[touched + 1])
        return ids

    def analyse(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray], np.ndarray, np.ndarray]:
        """Of each text its pretokens and their numbers of ids; ids of all texts one after another, and their offsets."""
        index: dict[str, int] = {}
        find, split, which = self.split.findall, [], []
        for t in texts:
            w = find(t) if t else []
            split.append(w)
            which += [index.setdefault(x, len(index)) for x in w]
        ids, count = self.words([w.encode() for w in index])
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))))
        which_a = np.array(which, np.int64)
        c = count[which_a]
        start = np.concatenate(([0], np.cumsum(count)))
        total = np.concatenate(([0], np.cumsum(c)))
        at = np.repeat(start[which_a] - total[:-1], c) + np.arange(total[-1])
        return split, np.split(c, edges[1:-1]) if len(split) else [], ids[at], total[edges]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets (one more than texts). A null text counts as empty."""
        return self.analyse(texts)[2:]


_SHARED: dict[tuple[str, str], object] = {}
_ENCODERS: dict[str, Encoder] = {}


def shared(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast value: of fixed size (under 1 MB), and executors need not have the file."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        with open(path, "rb") as f:
            _SHARED[key] = spark.sparkContext.broadcast(f.read())
    return _SHARED[key]


def encoder(path: str, value=None) -> Encoder:
    """The encoder of this process, made once for each path; value: the file as a broadcast value."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder.load(path) if value is None else Encoder(_parse(value.value.splitlines()))
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes together, so that memory follows bytes, not rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most
    edges = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.zeros(0, np.int64)
    for a, b in zip([0, *edges], [*edges, len(sizes)]):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, ids (ARRAY<INT>): the token ids of each row's text, without special tokens.

    A narrow map over the scan: no shuffle. Null text: null ids; empty text: empty list. Repeated keys stay repeated.
    """
    src = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    value = shared(df.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, value)
        for batch in (x for b in batches for x in slices(b, 1)):
            texts = batch.column(1).to_pylist()
            ids, offsets = enc.texts(texts)
            null = np.fromiter((t is None for t in texts), bool, len(texts))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(null)) if len(texts) else pa.array([], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def may_exceed(text: Column, limit: int) -> Column:
    """False only where a text surely has at most limit tokens: no token is shorter than a byte."""
    return F.octet_length(text) > limit


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """key, n_tokens INT; null text: null."""
    return encode(df, key, text, tokenizer).select(key, F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_tokens"))
