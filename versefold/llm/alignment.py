"""Evaluation texts leaking into training text (problem 8).

Items and documents are compared by letters and digits in lower case. Seeds are n-grams of equal information: runs of 8
ideographs or 19 letters (see minmax.weighted_shingles). Documents look up every one of their n-grams among those of the
items. A document becomes a candidate of an item by one rare seed (one that occurs in at most `rare` items) or by as
many frequent seeds on one diagonal as a run of `run` characters must have, so frequent n-grams cost no candidates and
lose none. Every candidate's windows are then scored by Smith-Waterman local alignment, all candidates of a batch
together, and the longest run that the two have in common is measured.

Any common run of `run` >= 19 characters holds a whole seed at its begin, so no such run is missed; edited and
paraphrased passages are found as long as one seed of theirs is intact. Their recall is measured in the tests against
aligning every document with every item. Whether a pair counts as an exact leak (p8_found) is read off the longest run
that the alignment's windows have in common, not off its score.

Items are broadcast in parts of at most MOST_CHARS characters, sized by an aggregate before they are collected, one part
after another: with more than one part, each part's rows are written before the next part is collected.

Defined cases: null, empty and blank texts match nothing; repeated documents come out each; a pair of document and item
comes out once, with its best window; with equal scores the first window counts; items that are there twice count once, and null keys of items are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key
from ..session import Stage
from .bpe import slices
from .minmax import DENSE, SPARSE, weighted_shingles

#: Characters of the items in one broadcast part.
MOST_CHARS = 2_000_000
SEED = 8 * DENSE
SEED_LETTERS = -(-SEED // SPARSE)
MATCH, MISMATCH, GAP = 2, -1, -1


class Items:
    """The items' characters, and their seeds sorted by hash behind a bitmap."""

    def __init__(self, ids: np.ndarray, texts: list[str], rare: int):
        self.ids = ids
        h, start, _, count, self.code = weighted_shingles(texts, SEED, False)
        self.offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], start[order]
        self.item = np.repeat(np.arange(len(texts)), count)[order]
        kinds, which = np.unique(self.hash, return_inverse=True)
        pairs = np.unique(which * max(1, len(texts)) + self.item)
        spread = np.bincount(pairs // max(1, len(texts)), minlength=len(kinds))
        self.rare = spread[which] <= rare if len(h) else np.zeros(0, bool)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into h, index into the seeds) of equal hashes."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[maybe]), np.searchsorted(self.hash, h[maybe], "right")
        n = hi - lo
        return np.repeat(maybe, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def candidates(table: Items, h: np.ndarray, start: np.ndarray, doc: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, item and diagonal (place in the batch's characters where the item would begin) of the seeds that count."""
    place, s = table.find(h)
    d, i = doc[place], table.item[s]
    begin = start[place] - (table.at[s] - table.offsets[i])
    pair = d * max(1, len(table.ids)) + i
    _, diagonal, n = np.unique(np.stack([pair, begin]), axis=1, return_inverse=True, return_counts=True) if len(pair) else (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    good = np.unique(pair[table.rare[s] | (n[diagonal.ravel()] > run - SEED_LETTERS)])
    keep = np.isin(pair, good)
    order = np.lexsort((begin[keep], pair[keep]))
    return d[keep][order], i[keep][order], begin[keep][order]


def smith_waterman(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair of rows and the longest run of equal characters on a diagonal.

    a, b: matrices of characters (pairs, width). All pairs advance by one character of a at a time. A gap along b within
    a row is a running maximum of score - GAP * column, so a row needs no loop over columns. Padding matches nothing.
    """
    pairs, width = b.shape
    column = np.arange(width, dtype=np.int32) * -GAP
    inside = np.arange(width) < b_len[:, None]
    row, runs = np.zeros((pairs, width), np.int32), np.zeros((pairs, width), np.int32)
    best, longest = np.zeros(pairs, np.int32), np.zeros(pairs, np.int32)
    for k in range(a.shape[1]):
        same = (b == a[:, k : k + 1]) & inside & (k < a_len)[:, None]
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        diagonal += np.where(same, MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum(np.maximum.accumulate(new + column, 1) - column, 0)
        before = np.zeros_like(runs)
        before[:, 1:] = runs[:, :-1]
        runs = np.where(same, before + 1, 0)
        best, longest = np.maximum(best, row.max(1)), np.maximum(longest, runs.max(1))
    return best, longest


def _padded(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, fill: int) -> np.ndarray:
    width = int((hi - lo).max(initial=1))
    at = lo[:, None] + np.arange(width)
    return np.where(at < hi[:, None], code[np.minimum(at, len(code) - 1)], np.uint32(fill))


def score(table: Items, code: np.ndarray, offsets: np.ndarray, d: np.ndarray, i: np.ndarray, begin: np.ndarray, cells: int = 1 << 22) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, item) -> best score, longest run. Seeds on near diagonals share a window of the item's length and a half."""
    if not len(d):
        return {}
    size = np.diff(table.offsets)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (begin[1:] - begin[:-1] > size[i[1:]] // 4 + 8)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    dd, ii = d[first], i[first]
    lo = np.maximum(offsets[dd], begin[first] - size[ii] // 4)
    hi = np.minimum(offsets[dd + 1], begin[last] + size[ii] + size[ii] // 4)
    out: dict[tuple[int, int], tuple[int, int]] = {}
    order = np.argsort(hi - lo, kind="stable")
    x = 0
    while x < len(order):
        y = min(len(order), x + max(1, cells // max(1, int((hi - lo)[order[x : x + 512]].max()) * 8)))
        k = order[x:y]
        best, longest = smith_waterman(_padded(table.code, table.offsets[ii[k]], table.offsets[ii[k] + 1], 0), size[ii[k]], _padded(code, lo[k], hi[k], 1), (hi - lo)[k])
        for a, b, v, r in zip(dd[k].tolist(), ii[k].tolist(), best.tolist(), longest.tolist()):
            v0, r0 = out.get((a, b), (0, 0))
            out[a, b] = (max(v, v0), max(r, r0))
        x = y
    return out


def _parts(items: DataFrame, key: str, text: str) -> tuple[int, Iterator[tuple[np.ndarray, list[str]]]]:
    """The number of parts, and the items in parts of bounded size: hash classes of the key, collected as they are asked for."""
    normal = items.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("bigint").alias("i"), F.coalesce(alnum_key(F.col(f"`{text}`")), F.lit("")).alias("t")).distinct()
    n = 1 + int((normal.agg(F.sum(F.length("t"))).first()[0] or 0) // MOST_CHARS)
    parts = (normal.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).orderBy("i", "t").collect() for k in range(n))
    return n, ((np.array([r.i for r in rows], np.int64), [r.t for r in rows]) for rows in parts)


SCHEMA = "doc_id bigint, item_id bigint, score int, share double, longest_run int"


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, share: float = 0.5, run: int = 30, rare: int = 4) -> DataFrame:
    """doc_id, item_id, score, share (of the item's score with itself), longest_run: see the module's text.

    One row for each pair whose alignment reaches `share`, or that has a common run of `run` characters or more. A map
    over the scan of the documents, without a shuffle.
    """
    if run < SEED_LETTERS:
        raise ValueError(f"a run must be at least as long as the longest seed, {SEED_LETTERS}")
    src = docs.where(F.col(f"`{doc_text}`").isNotNull()).select(F.col(f"`{doc_key}`").cast("bigint").alias("k"), alnum_key(F.col(f"`{doc_text}`")).alias("t"))
    outs = []
    n, parts = _parts(items, item_key, item_text)
    for k, (ids, texts) in enumerate(parts):
        value = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def find(batches: Iterable[pa.RecordBatch], value=value) -> Iterator[pa.RecordBatch]:
            table = Items(*value.value, rare)
            size = np.diff(table.offsets)
            for batch in (x for b in batches for x in slices(b, 1)):
                docs_text = batch.column(1).to_pylist()
                h, start, _, count, code = weighted_shingles(docs_text, SEED, False)
                offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs_text), np.int64, len(docs_text)))))
                found = score(table, code, offsets, *candidates(table, h, start, np.repeat(np.arange(len(count)), count), run))
                best: dict[tuple[int, int], tuple[tuple[float, int], int]] = {}  # an item may have several texts
                for (d, i), (v, r) in found.items():
                    part, at = v / (MATCH * int(size[i])), (d, int(table.ids[i]))
                    if part >= share or r >= run:
                        score_, run_ = best.get(at, ((part, v), r))
                        best[at] = (max(score_, (part, v)), max(run_, r))
                rows = [(d, i, v, part, r) for (d, i), ((part, v), r) in best.items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array([round(x, 4) for x in cols[3]], pa.float64()), pa.array(cols[4], pa.int32())],
                    names=["doc_id", "item_id", "score", "share", "longest_run"],
                )

        out = src.mapInArrow(find, SCHEMA)
        outs.append(out if n == 1 else Stage(docs.sparkSession, "leaks").write(out, f"part{k}"))
        if n > 1:
            value.unpersist()
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    return out
