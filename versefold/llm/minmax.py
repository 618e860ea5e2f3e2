"""Near-duplicate records by min-max hashing (problem 6).

The sets that are compared in the end, all runs of n = 3 adjacent characters, are the sets that are hashed, whatever the
alphabet. Under each of `permutations` permutations both the smallest and the largest value are kept, so that one
evaluation of the permutation gives two signature values; an unbiased estimate of the similarity is the share of equal
values. The 2 * 64 values are used twice:

* banding: bands of `rows` = 3 consecutive values, `bands` = 28 of them. Two records of similarity s share a band with
  1 - (1 - s^3)^28: all but 0.11 % at s = 0.6, all but 0.05 % at 0.62, less than 1e-5 at 0.75.
* a sketch of two bits of each of the 128 values. Pairs that share a band are compared by the number of values of equal
  first bits, whose mean is 128 (1 + s) / 2, and those that stay by the number of values of two equal bits, whose mean is
  128 (1 + 3 s) / 4; only from 3.5 deviations below the threshold's means on (86 and 71 of 128 for 0.6, so that 0.02 % are
  lost by each) does a pair become a candidate. Unrelated texts of one alphabet, which share common shingles, fall out in
  numpy: one bit alone leaves 1.5 % of them, two bits leave 4 in 100,000, and these grow with the square of the rows.

Every candidate is then compared exactly, by whole sets of shingles.

Records of equal text are one class, named by the text's 64-bit hash: repeats within a batch are dropped before anything
is shuffled, so a group of copies that holds a third of all rows leaves a row a batch. Signatures are written once. Bands
are matched in ROUNDS, each by one shuffle of (bucket, class, sketch), so that the disk holds the shuffle of one round.
Buckets are shuffled in parts of some PART rows, packed as columns of bytes, so that the JVM handles a row a part and
batch; a part is sorted in numpy, and nothing is in memory but the part. Bands that are hot are known beforehand from the classes whose hash falls into 1/64 (this only lays out
the work, it decides about no pair): their members are cut into blocks, and each pair of blocks is a bucket of its own, so
that a band of any size is spread over the cluster in buckets of some BLOCK rows. No bucket is capped.

Defined cases: rows with a null or blank body are left out by the caller; a text shorter than a shingle has no shingles
and pairs only with equal texts if it is not empty. Ties do not occur: the result is all pairs from the threshold on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .related import components

_SEED = 20240229
#: Weights of a character of a large and of a small alphabet in a weighted shingle (seeds of alignment).
DENSE, SPARSE = 7, 3
#: Members of a block of a hot band; bands with more than twice as many are cut. SAMPLE: one class in so many tells which.
BLOCK, SAMPLE = 2048, 64
#: Hot bands that are known to every task at most, the largest first; 12 bytes each.
MOST_HOT = 200_000
#: Pairs of one numpy step.
STEP = 1 << 20
#: Buckets from so many members on are compared as matrices, ROWS members with all behind them at a time.
WIDE, ROWS = 48, 64
#: Shuffles over which the bands are spread.
ROUNDS = 7
#: Rows of buckets that are in memory at once, some 49 bytes each: of a part of a shuffle, and before they are packed.
PART, PACK = 1 << 18, 1 << 19


def weighted_shingles(texts: list[str], need: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and lengths of all shingles, each text's number of them, and all texts' characters as uint32.

    The shingle at a place is the shortest run of characters from there that weighs `need`: an ideograph or syllable
    weighs DENSE, a letter or digit of an alphabet SPARSE. It depends on nothing before or behind it. short: a text that
    has no whole shingle has one, itself; an empty text has none.
    """
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64), code
    dense = (code >= 0x3040) & (code < 0xA000) | (code >= 0xAC00) & (code < 0xD7B0) | (code >= 0xF900) & (code < 0xFB00) | (code >= 0x20000)
    weight = np.cumsum(np.where(dense, DENSE, SPARSE))
    before = np.concatenate(([0], weight[:-1]))
    end = np.searchsorted(weight, before + need) + 1
    bound = np.repeat(np.cumsum(lens), lens)
    whole = end <= bound
    count = np.bincount(np.repeat(np.arange(len(texts)), lens)[whole], minlength=len(texts))
    bare = np.flatnonzero((count == 0) & (lens > 0)) if short else ()
    if len(bare):
        at = (np.cumsum(lens) - lens)[bare]
        whole[at], end[at], count[bare] = True, bound[at], 1
    start = np.flatnonzero(whole)
    length = end[start] - start
    code64 = code.astype(np.uint64)
    h = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        live = slice(None) if k < int(length.min()) else np.flatnonzero(length > k)
        x = (h[live] ^ code64[start[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
        h[live] = x ^ (x >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), start, length, count, code


def shingle_hashes(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's runs of n adjacent characters, and their numbers."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.maximum(lens - n + 1, 0)
    if not count.any():
        return np.zeros(0, np.uint32), count
    h = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):
        h ^= code[k : len(code) - n + 1 + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(code))  # characters from here to the text's end
    return (h[left[: len(h)] >= n] >> np.uint64(32)).astype(np.uint32), count


def multipliers(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of h -> (a h + b) mod 2^32."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, permutations, dtype=np.uint32)


def signature(texts: list[str], n: int = 3, permutations: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For texts with shingles: their numbers, and a matrix (2 permutations, texts): minimum and maximum of each permutation in turn."""
    h, count = shingle_hashes(texts, n)
    rows = np.flatnonzero(count)
    out = np.empty((2 * permutations, len(rows)), np.uint32)
    if len(rows):
        start = np.concatenate(([0], np.cumsum(count[rows])[:-1]))
        x = np.empty_like(h)
        for i, (a, b) in enumerate(zip(*multipliers(permutations))):
            np.multiply(h, a, out=x)
            x += b
            np.minimum.reduceat(x, start, out=out[2 * i])
            np.maximum.reduceat(x, start, out=out[2 * i + 1])
    return rows, out


def band_hashes(values: np.ndarray, bands: int, rows: int = 3) -> np.ndarray:
    """(bands, texts) of int64: each band's `rows` consecutive signature values, hashed together with its number."""
    if bands * rows > len(values):
        raise ValueError(f"{bands} bands of {rows} need {bands * rows} values, there are {len(values)}")
    out = np.empty((bands, values.shape[1]), np.int64)
    for i in range(bands):
        x = np.full(values.shape[1], i + 1, np.uint64)
        for v in values[i * rows : (i + 1) * rows]:
            x = (x ^ v) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
        out[i] = (x * np.uint64(0x94D049BB133111EB)).view(np.int64)
    return out


def sketches(values: np.ndarray, bit: int = 0) -> np.ndarray:
    """(texts, 2) of uint64: one bit (the first, 0, or the second, 1) of each of 128 signature values; fewer leave zeros."""
    bits = np.zeros((values.shape[1], 128), np.uint8)
    mixed = values * np.uint32(0x9E3779B1)
    bits[:, : len(values)] = (mixed >> np.uint32(31 - bit) & np.uint32(1)).T[:, :128]
    return np.packbits(bits, axis=1).view(np.uint64)


def least_agreement(threshold: float, permutations: int, bits: int = 1) -> int:
    """Values of equal bits that a candidate's sketches must have: 3.5 deviations below the mean of pairs right at the threshold."""
    values, p = min(128, 2 * permutations), threshold + (1 - threshold) / 2**bits
    return 128 - values + int(values * p - 3.5 * (values * p * (1 - p)) ** 0.5)


def _distinct(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    c, first = np.unique(np.asarray(batch.column(0)), return_index=True)
    return c, batch.column(1).take(pa.array(first)).to_pylist()


def hot_bands(texts: DataFrame, n: int, permutations: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes with more than some 2 * BLOCK members, sorted, and the number of blocks of each; see the module's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, t = _distinct(batch)
            some, values = signature(t, n, permutations)
            yield pa.RecordBatch.from_arrays([pa.array(band_hashes(values, bands, rows).T.ravel()), pa.array(np.repeat(c[some], bands))], names=["band", "c"])

    part = texts.select("c", "text").where(F.pmod(F.xxhash64("c"), F.lit(SAMPLE)) == 0).mapInArrow(run, "band bigint, c bigint")
    counts = part.groupBy("band").agg(F.approx_count_distinct("c", 0.1).alias("n")).where(F.col("n") * SAMPLE > 2 * BLOCK)
    found = sorted((r.band, -(-r.n * SAMPLE // BLOCK)) for r in counts.orderBy(F.desc("n"), "band").limit(MOST_HOT).collect())
    return np.array([b for b, _ in found], np.int64), np.array([k for _, k in found], np.int64)


def signatures(texts: DataFrame, n: int, permutations: int, bands: int, rows: int) -> DataFrame:
    """c, s1 to s4 (the sketch), b0, b1, .. (the bands), all BIGINT: of each different text of a batch that has a shingle."""
    names = ["c", "s1", "s2", "s3", "s4", *(f"b{i}" for i in range(bands))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, t = _distinct(batch)
            some, values = signature(t, n, permutations)
            if len(some):
                s = np.hstack((sketches(values), sketches(values, 1))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[some], *s.T, *band_hashes(values, bands, rows))], names=names)

    return texts.select("c", "text").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def packed(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """part INT, v0, v1, .. BINARY: the values of each part's rows, one behind the other, a row for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(edge, len(part))
    out = [pa.array(part[edge].astype(np.int32))]
    for x in columns:
        x = np.ascontiguousarray(x[order])
        out.append(pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer((ends * (x.nbytes // len(x))).astype(np.int32)), pa.py_buffer(x)]))
    return pa.RecordBatch.from_arrays(out, names=["part", *(f"v{i}" for i in range(len(columns)))])


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """All values of a binary column's rows, one row behind the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind)


def buckets(signed: DataFrame, names: list[str], hot: np.ndarray, blocks: np.ndarray, parts: int) -> DataFrame:
    """part INT and packed rows of bucket, c, s1 to s4 BIGINT, side TINYINT: of each signature, for the bands of these names.

    Members of sides 1 and 2 are paired with each other, members of side 0 among themselves. A hot band's member of block
    i is in the buckets (i, j) of all other blocks j, on the side of its block, and in (i, i). All of a bucket is in one part.
    """

    def members(batch: pa.RecordBatch) -> list[np.ndarray]:
        c, *rest = (np.asarray(x) for x in batch.columns)
        s, band = np.stack(rest[:4], 1), np.stack(rest[4:], 1).ravel()
        who = np.repeat(np.arange(len(c)), len(names))
        side = np.zeros(len(band), np.int8)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, band), len(hot) - 1)
            is_hot = hot[at] == band
            h, w, k = band[is_hot], who[is_hot], blocks[at[is_hot]]
            own = np.repeat(((c[w].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)).astype(np.int64) % k, k)
            other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            low, high = np.minimum(own, other).view(np.uint64), np.maximum(own, other).view(np.uint64)
            cut = ((np.repeat(h, k).view(np.uint64) ^ (low << np.uint64(32) | high) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
            band, who = np.concatenate((band[~is_hot], cut)), np.concatenate((who[~is_hot], np.repeat(w, k)))
            side = np.concatenate((side[~is_hot], np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)))
        return [band, c[who], s[who], side]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(x) for x in zip(*found)]
            return packed((cols[0].view(np.uint64) >> np.uint64(32)).astype(np.int64) % parts, cols)

        for batch in batches:
            if batch.num_rows:
                found.append(members(batch))
                n += len(found[-1][0])
            if n >= PACK:
                yield out()
                found, n = [], 0
        if n:
            yield out()

    return signed.select("c", "s1", "s2", "s3", "s4", *names).mapInArrow(run, "part int, v0 binary, v1 binary, v2 binary, v3 binary")


def _listed(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places (i < j) of buckets from start on with size members, one behind the other; in steps."""
    after = np.repeat(start + size, size) - np.arange(size.sum()) - 1  # members behind each one in its bucket
    total = np.cumsum(after)
    lo = 0
    while lo < len(after):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + STEP, "right")))
        k = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi


def _wide(s: np.ndarray, side: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) of one bucket with sketches of at most `most` different first bits; of two sides only across."""
    one, two = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.all() else (np.arange(len(s)), None)
    x, y = (np.ascontiguousarray(s[one, k]) for k in (0, 1))
    p, q = (x, y) if two is None else (np.ascontiguousarray(s[two, k]) for k in (0, 1))
    step = max(1, min(ROWS, STEP // max(1, len(p))))
    for lo in range(0, len(x), step):
        first = lo if two is None else 0
        off = np.bitwise_count(x[lo : lo + step, None] ^ p[None, first:])
        off += np.bitwise_count(y[lo : lo + step, None] ^ q[None, first:])
        at = np.flatnonzero(off <= most)
        if len(at):
            i, j = np.divmod(at, off.shape[1])
            i, j = i + lo, j + first
            if two is None:
                yield i[i < j], j[i < j]
            else:
                yield np.minimum(one[i], two[j]), np.maximum(one[i], two[j])


def _near(start: np.ndarray, size: np.ndarray, c: np.ndarray, s: np.ndarray, side: np.ndarray, agree: int, agree_two: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of members of one bucket that agree in enough values; buckets: from start on, size members."""

    def apart(i: np.ndarray, j: np.ndarray, two: bool) -> np.ndarray:
        x, y = s[i, 0] ^ s[j, 0], s[i, 1] ^ s[j, 1]
        if two:
            x, y = x | s[i, 2] ^ s[j, 2], y | s[i, 3] ^ s[j, 3]
        return np.bitwise_count(x) + np.bitwise_count(y)

    def those(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (c[i] != c[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        ok = apart(i, j, True) <= 128 - agree_two
        i, j = i[ok], j[ok]
        return np.minimum(c[i], c[j]), np.maximum(c[i], c[j])

    few = size < WIDE
    place = np.flatnonzero(np.repeat(few, size))
    for i, j in _listed(np.cumsum(size[few]) - size[few], size[few]):
        i, j = place[i], place[j]
        ok = apart(i, j, False) <= 128 - agree
        yield those(i[ok], j[ok])
    for lo, k in zip(start[~few].tolist(), size[~few].tolist()):
        for i, j in _wide(s[lo : lo + k], side[lo : lo + k], 128 - agree):
            yield those(i + lo, j + lo)


def bucket_candidates(members: DataFrame, agree: int, agree_two: int, partitions: int = 0) -> DataFrame:
    """a < b: pairs that share a bucket and agree in at least `agree` first bits and `agree_two` values of two bits; a pair may come out more than once."""
    spread = (members.repartition(partitions, "part") if partitions else members.repartition("part")).sortWithinPartitions("part")

    def pairs(pieces: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bucket, c, s, side = (np.concatenate(x) for x in zip(*pieces))
        s = s.reshape(-1, 4)
        order = np.argsort(bucket)
        b = bucket[order]
        same = b[1:] == b[:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # those that are not alone
        order = order[np.lexsort((c[order], bucket[order]))]
        bucket, c = bucket[order], c[order]
        fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (c[1:] != c[:-1]))[: len(c)]  # the same class from another batch
        order, bucket, c = order[fresh], bucket[fresh], c[fresh]
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(c)])
        found, n = [], 0
        for a, b in _near(start, np.diff(np.append(start, len(c))), c, s[order], side[order], agree, agree_two):
            if len(a):
                found.append((a, b))
                n += len(a)
            if n > STEP:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                found, n = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, now = [], None
        for batch in batches:
            part = np.asarray(batch.column(0))
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            for lo, hi in zip(edge.tolist(), np.append(edge[1:], len(part)).tolist()):
                if kept and part[lo] != now:
                    yield from pairs(kept)
                    kept = []
                now = part[lo]
                kept.append([unpacked(batch.column(1 + k).slice(lo, hi - lo), kind) for k, kind in enumerate((np.int64, np.int64, np.uint64, np.int8))])
        if kept:
            yield from pairs(kept)

    return spread.mapInArrow(run, "a bigint, b bigint")


def common_keys(rows: DataFrame, bucket: str) -> DataFrame:
    """The same as shared_buckets, for buckets that may hold a third of all rows: sizes by partial sums, joined back."""
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return rows.join(sizes, bucket)


def without_repeats(texts: DataFrame) -> DataFrame:
    """c, text without the repeats within a batch: a text that a third of all rows have leaves a row a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(np.unique(np.asarray(batch.column(0)), return_index=True)[1]))

    return texts.select("c", "text").mapInArrow(run, "c bigint, text string")


def bucket_pairs(members: DataFrame, bucket: str, key: str, block: int = 512) -> DataFrame:
    """a < b: all pairs of different keys that share a bucket (columns: bucket, key, size); a pair may come out more than once.

    Keys of a bucket are numbered by blocks (hash of the key), and each pair of blocks is compared under a join key of its
    own, so a large bucket is spread over the cluster. Nothing is capped.
    """
    m = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    left = m.select(bucket, F.col(key).alias("x"), "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    right = m.select(bucket, F.col(key).alias("y"), F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), "block")).alias("block"))
    pairs = left.join(right, [bucket, "block", "other"]).where((F.col("block") < F.col("other")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of all different shingles, sorted by text, then shingle: exact for n <= 3, as 21 bits hold a character."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(code) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(code) - n + 1, np.int64)
    for k in range(n):
        h = h << 21 | code[k : len(code) - n + 1 + k]
    whole = (np.repeat(np.cumsum(lens), lens) - np.arange(len(code)))[: len(h)] >= n
    text, h = np.repeat(np.arange(len(texts)), lens)[: len(h)][whole], h[whole]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def similar(a: list[str], b: list[str], n: int, threshold: float) -> np.ndarray:
    """Whether the sets of shingles of a[i] and b[i] share at least the threshold of their union; n <= 3."""
    if n > 3:
        raise ValueError("shingles of at most three characters are compared exactly")
    index: dict[str, int] = {}
    x, y = (np.fromiter((index.setdefault(t, len(index)) for t in side), np.int64, len(side)) for side in (a, b))
    text, h = shingle_sets(list(index), n)
    _, rank = np.unique(h, return_inverse=True)
    size = np.bincount(text, minlength=len(index))
    start = np.cumsum(size) - size
    place = text * (int(rank.max(initial=0)) + 1) + rank  # sorted
    out = np.zeros(len(a), bool)
    load = np.cumsum(size[x])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + STEP, "right")))
        k = size[x[lo:hi]]
        mine = np.repeat(start[x[lo:hi]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        want = np.repeat(y[lo:hi], k) * (int(rank.max(initial=0)) + 1) + rank[mine]
        at = np.minimum(np.searchsorted(place, want), max(0, len(place) - 1))
        both = np.bincount(np.repeat(np.arange(hi - lo), k)[place[at] == want], minlength=hi - lo) if len(place) else np.zeros(hi - lo, np.int64)
        union = size[x[lo:hi]] + size[y[lo:hi]] - both
        out[lo:hi] = (union > 0) & (both >= threshold * union - 1e-12)
        lo = hi
    return out


def near_classes(texts: DataFrame, n: int = 3, threshold: float = 0.6, permutations: int = 64, bands: int = 28, rows: int = 3) -> DataFrame:
    """a < b: all pairs of different texts (by c, their hash) whose similarity reaches the threshold.

    texts: c BIGINT, text STRING; a text may be there many times. 28 bands of 3 suit a threshold of 0.6 and above.
    """
    stage = Stage(texts.sparkSession, "minmax")
    hot, blocks = hot_bands(texts, n, permutations, bands, rows)
    signed = stage.write(signatures(texts, n, permutations, bands, rows), "signatures")
    least = [least_agreement(threshold, permutations, k) for k in (1, 2)]
    usual = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * usual, int((signed.count() * bands + (blocks**2).sum() * BLOCK) / min(ROUNDS, bands) / PART))
    found = []
    for i in range(min(ROUNDS, bands)):
        members = buckets(signed, [f"b{k}" for k in range(i, bands, ROUNDS)], hot, blocks, parts)
        found.append(stage.write(bucket_candidates(members, *least, parts // 8 if parts > 8 * usual else 0).distinct(), f"candidates{i}", release=True))
    stage.drop("signatures")
    candidates = stage.write(reduce(DataFrame.unionByName, found).distinct(), "candidates", release=True)
    ids = candidates.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    known = stage.write(without_repeats(texts.join(ids, "c", "left_semi")).groupBy("c").agg(F.first("text").alias("text")), "texts", release=True)
    both = candidates.join(known.withColumnsRenamed({"c": "a", "text": "x"}), "a").join(known.withColumnsRenamed({"c": "b", "text": "y"}), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist(), n, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, c, text of the rows with a text, written: they are normalized and hashed once for all uses."""
    rows = df.where(F.length(f"`{text}`") > 0).select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("c"), F.col(f"`{text}`").alias("text"))
    return Stage(df.sparkSession, "rows").write(rows, "rows")


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 3, threshold: float = 0.6, **how: int) -> DataFrame:
    """id_a < id_b: all pairs of keys whose texts' shingle sets share at least the threshold of their union; equal texts too."""
    rows = _rows(df, key, text)
    classes = near_classes(rows, n, threshold, **how)
    keys = rows.select("c", "key")
    across = classes.join(keys.withColumnsRenamed({"c": "a", "key": "x"}), "a").join(keys.withColumnsRenamed({"c": "b", "key": "y"}), "b")
    within = bucket_pairs(common_keys(keys, "c"), "c", "key")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))


def class_links(df: DataFrame, key: str, text: str, n: int = 3, threshold: float = 0.6, **how: int) -> tuple[DataFrame, DataFrame]:
    """(representative_a < representative_b of near classes; key, representative): a class is named by its smallest key."""
    rows = _rows(df, key, text)
    stage = Stage(df.sparkSession, "classes")
    names = stage.write(rows.groupBy("c").agg(F.min("key").alias("representative")), "names")
    pairs = stage.write(near_classes(rows, n, threshold, **how), "pairs")
    named = pairs.join(names.withColumnsRenamed({"c": "a", "representative": "x"}), "a").join(names.withColumnsRenamed({"c": "b", "representative": "y"}), "b")
    links = named.select(F.least("x", "y").alias("representative_a"), F.greatest("x", "y").alias("representative_b"))
    return links, rows.select("key", "c").join(names, "c").select("key", "representative")


def grouped(df: DataFrame, key: str, text: str, n: int = 3, threshold: float = 0.6, **how: int) -> DataFrame:
    """key, representative, n_links BIGINT, group_id: one row for each row with a text.

    representative: the smallest key of the row's class (equal texts); n_links: different texts near it; group_id: the
    smallest key of all rows that links tie together, over any number of links.
    """
    links, members = class_links(df, key, text, n, threshold, **how)
    stage = Stage(df.sparkSession, "groups")
    links, members = stage.write(links, "links"), stage.write(members, "members")
    ends = links.select(F.explode(F.array("representative_a", "representative_b")).alias("representative"))
    n_links = ends.groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"), F.first(F.xxhash64("representative")).alias("entity"))
    tied = components(links.select(F.array_sort(F.array(F.xxhash64("representative_a"), F.xxhash64("representative_b"))).alias("entities")), stage)
    linked = stage.write(n_links.join(tied, "entity").select("representative", "n_links", "label"), "linked")
    first = linked.groupBy("label").agg(F.min("representative").alias("group_id"))
    named = linked.join(first, "label").select("representative", "n_links", "group_id")
    out = members.join(named, "representative", "left")
    return out.select("key", "representative", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("group_id", "representative").alias("group_id"))
