"""Vectors, rankings and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stage, cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector of length 1; a zero vector stays zero."""
    # The length is bound to a lambda variable, so that it is not computed again for every element.
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > least, dot(a, b) / n).otherwise(F.lit(0.0))


def softmax(a: Column) -> Column:
    """exp(x - max) over their sum."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda t, y: t + y))


def padded(a: Column, n: int) -> Column:
    return F.when(F.size(a) < n, F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.lit(n) - F.size(a)))).otherwise(F.transform(a, lambda x: x.cast("double")))


def arg_max(values: Sequence[tuple[str, Column]]) -> Column:
    """The first name with the greatest value."""
    best = F.greatest(*[c for _, c in values])
    return F.coalesce(*[F.when(c == best, F.lit(n)) for n, c in values])


def _best(key: str, k: int):
    """A function of one block of queries and vectors (columns is_q, k, v): the k nearest vectors of each query."""

    def best(table: pa.Table) -> pa.Table:
        q = table.filter(table["is_q"])
        d = table.filter(pa.compute.invert(table["is_q"]))
        out = {"q": [], key: [], "similarity": []}
        if q.num_rows and d.num_rows:
            as_matrix = lambda t: np.array(t["v"].to_pylist(), np.float64)
            a, b = as_matrix(q), as_matrix(d)
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            s = a @ b.T / np.maximum(na[:, None] * nb[None, :], 1e-300)
            kq, kd = np.array(q["k"].to_pylist()), np.array(d["k"].to_pylist())
            order = np.argsort(kd, kind="stable")
            s, kd = np.round(s[:, order], 12), kd[order]
            s[kq[:, None] == kd[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for i, row in enumerate(top):
                row = row[np.isfinite(s[i, row])]
                out["q"] += [kq[i].item()] * len(row)
                out[key] += kd[row].tolist()
                out["similarity"] += s[i, row].tolist()
        return pa.table(out, schema=pa.schema([("q", table.schema.field("k").type), (key, table.schema.field("k").type), ("similarity", pa.float64())]))

    return best


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """q, key, similarity, rank: the k nearest by cosine of every query, against all vectors, the query itself left out.

    Vectors and queries are cut into blocks of at most about `block` rows; every pair of blocks is one matrix product in
    its own task, and each keeps k candidates a query, so what is shuffled is blocks and k rows a query and block, never
    pairs. Ties go to the smaller key.
    """
    kind = vectors.schema[key].dataType.simpleString()
    n_v, n_q = vectors.count(), queries.count()
    bv, bq = max(1, -(-n_v // block)), max(1, -(-n_q // block))

    def packed(df: DataFrame, blocks: int, name: str) -> DataFrame:
        return df.where(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias(name), F.col(key).alias("k"), F.col(vector).alias("v"))

    left = packed(queries, bq, "i").select("i", F.explode(F.sequence(F.lit(0), F.lit(bv - 1))).alias("j"), F.lit(True).alias("is_q"), "k", "v")
    right = packed(vectors, bv, "j").select(F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("i"), "j", F.lit(False).alias("is_q"), "k", "v")

    found = left.unionByName(right).groupBy("i", "j").applyInArrow(_best(key, k), f"q {kind}, {key} {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def bm25(df: DataFrame, key: str, toks: Column, query: Sequence[str], k1: float = 1.5, b: float = 0.75, hits_only: bool = True) -> DataFrame:
    """key, score: query tokens count with multiplicity; idf = ln((N - df + 0.5) / (df + 0.5) + 1).

    Lengths and the query's few term frequencies are expressions on each row's tokens; the corpus statistics are one row of
    partial aggregates, so nothing is exploded or shuffled. N counts documents with a token. Documents without any query
    term are left out (hits_only) or have a score of 0.
    """
    each = df.select(key, toks.alias("t")).select(key, *query_counts(F.col("t"), query))
    each = each.where("dl > 0") if hits_only else each
    scored = bm25_score(each, query, "score", k1, b)
    return (scored.where(F.exists("tf", lambda x: x > 0)) if hits_only else scored).select(key, "score")


def query_counts(toks: Column, query: Sequence[str]) -> list[Column]:
    """dl and tf ARRAY<INT>: a row's number of tokens, and how often it has each of the query's terms, in their order."""
    times = lambda word: F.size(F.filter(toks, lambda x: x == word))
    return [F.size(toks).alias("dl"), F.array(*map(times, sorted(set(query)))).cast("array<int>").alias("tf")]


def bm25_score(counted: DataFrame, query: Sequence[str], out: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The rows (with dl and tf of query_counts) and their score; the corpus statistics are one row."""
    terms = sorted(set(query))
    has = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    stats = counted.where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *has)

    def part(i: int, word: str) -> Column:
        tf, n_docs = F.col("tf")[i], F.col(f"df{i}")
        idf = F.log((F.col("n") - n_docs + 0.5) / (n_docs + 0.5) + 1)
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * query.count(word)).otherwise(0.0)

    score = sum((part(i, w) for i, w in enumerate(terms)), F.lit(0.0))
    return counted.crossJoin(F.broadcast(stats)).select(*counted.columns, score.alias(out))


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Places 1, 2, ... in a total order, without one task that sorts all rows: range partitions are numbered by themselves and shifted by the sizes before them."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = cut(df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    sizes = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    local = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
    return spread.withColumn(rank, local).join(F.broadcast(before), "__p").withColumn(rank, F.col(rank) + F.coalesce("before", F.lit(0))).drop("__p", "__m", "n", "before")


def fuse(channels: Sequence[tuple[DataFrame | Callable[[], DataFrame], float]], key: str, k: int = 60) -> DataFrame:
    """key, score = sum of weight / (k + rank). A channel has columns key and rank, or is a function that makes them; of weight 0 it is not made."""
    made = [(c() if callable(c) else c, w) for c, w in channels if w]
    parts = [c.select(key, (F.lit(float(w)) / (F.lit(float(k)) + F.col("rank"))).alias("s")) for c, w in made]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def places(scores: DataFrame, key: str, channels: Sequence[str], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(channels, candidates): place of each candidate among all rows, by falling score, then key; null scores come last.

    Counting instead of sorting: a map over the rows merges each batch with the candidates, and the counts of rows in front
    of each are summed. values: the candidates' scores (channels, candidates), -inf for null.
    """
    value = scores.sparkSession.sparkContext.broadcast((keys, values))
    m, n = values.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        keys, values = value.value
        ahead = np.zeros((m, n), np.int64)
        for batch in batches:
            own = np.asarray(batch.column(0))
            for i in range(m):
                s = np.asarray(batch.column(i + 1).fill_null(-np.inf))
                order = np.lexsort((np.concatenate((keys, own)), -np.concatenate((values[i], s))))
                is_row = order >= n
                ahead[i][order[~is_row]] += np.cumsum(is_row)[~is_row]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * n)), pa.array(ahead.ravel())], names=["i", "ahead"])

    rows = scores.select(key, *channels).mapInArrow(run, "i bigint, ahead bigint").groupBy("i").agg(F.sum("ahead").alias("ahead")).collect()
    out = np.zeros(m * n, np.int64)
    for r in rows:
        out[r.i] = r.ahead
    return out.reshape(m, n) + 1


def fused_top(scores: DataFrame, key: str, weights: dict[str, float], needed: int, k: int = 60, first: int = 512, most: int = 32_768, digits: int = 7) -> list[tuple[int, float]]:
    """The `needed` best (key, score) by reciprocal rank fusion over all rows, score rounded, equal ones by key; exact.

    scores: an integer key and one column for each channel. Only the first `first` rows of every channel are candidates:
    a row outside of all of them has a score of at most sum of weight / (k + first + 1). If the last one needed is not
    above that, four times as many are taken; beyond `most` all rows are ranked by range partitions instead.
    """
    on = {c: w for c, w in weights.items() if w}
    scores = Stage(scores.sparkSession, "channels").write(scores.select(key, *on), "scores")
    n = scores.count()
    while first <= most or n <= first:
        heads = [scores.orderBy(F.desc_nulls_last(c), key).limit(first) for c in on]
        found = {r[0]: [-np.inf if x is None else x for x in r[1:]] for h in heads for r in h.collect()}
        keys = np.array(sorted(found), np.int64)
        if not len(keys):
            return []
        values = np.array([found[x] for x in keys.tolist()], np.float64).T
        rank = places(scores, key, list(on), keys, values)
        score = sum(w / (k + rank[i]) for i, w in enumerate(on.values()))
        best = sorted((-round(float(v), digits), int(x)) for v, x in zip(score, keys))[:needed]
        if n <= first or len(best) == needed and -best[-1][0] > sum(on.values()) / (k + first + 1) + 10.0**-digits:
            return [(x, -v) for v, x in best]
        first *= 4
    ranks = [(ranked(scores.select(key, c), [F.desc_nulls_last(c), F.asc(key)]), w) for c, w in on.items()]
    fused = fuse(ranks, key, k).select(key, F.round("score", digits).alias("score"))
    return [tuple(r) for r in fused.orderBy(F.desc("score"), key).limit(needed).collect()]


def channel_weights(base: dict[str, float], active: Iterable[str]) -> dict[str, float]:
    """Weights of inactive channels become 0, the others sum to 1."""
    on = set(active)
    total = sum(w for n, w in base.items() if n in on)
    return {n: (w / total if n in on and total else 0.0) for n, w in base.items()}


def profile_score(row: dict[str, Column], wanted: dict[str, tuple[list[str], list[str]]], weights: dict[str, float], text: Column | None = None, pool: Sequence[str] = ()) -> Column:
    """Per dimension: hard hits times the weight and soft hits times 0.6 of it; row: dimension -> ARRAY<STRING>. Each word of the pool that the text contains adds 0.5."""
    parts = [F.when(F.contains(text, F.lit(w)), 0.5).otherwise(0.0) for w in pool] if text is not None else []
    for dim, (hard, soft) in wanted.items():
        arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        parts.append(weights[dim] * F.size(F.array_intersect(row[dim], arr(hard))) + 0.6 * weights[dim] * F.size(F.array_intersect(row[dim], arr(soft))))
    return sum(parts[1:], parts[0])


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int, sample: int = 20_000, seed: int = 42) -> np.ndarray:
    """Centroids of k-means on a bounded sample (at most `sample` rows, the first by a seeded hash); every row is indexed by them."""
    from .models import KMeans, vectors as as_vectors

    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    unit_rows = rows.select(unit(F.col("v")).alias("v"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(as_vectors(unit_rows, "v")).clusterCenters())


def in_cells(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, vector, cell: every row once for each of its `probes` nearest centroids (a broadcast matrix of cells rows)."""
    value = df.sparkSession.sparkContext.broadcast(centroids)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        c = value.value
        half = (c * c).sum(1) / 2
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(len(b), c.shape[1])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            cell = np.argsort(half - v @ c.T, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(b)), cell.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cell.ravel().astype(np.int32))], names=["k", "v", "cell"])

    src = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return src.mapInArrow(run, f"k {kind}, v array<double>, cell int")


def nearest_by_index(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, centroids: np.ndarray, probes: int, block: int = 4096) -> DataFrame:
    """q, key, similarity, rank: approximate `nearest`, which looks only into the `probes` cells nearest to a query.

    Cells larger than `block` are cut by a hash of the key, and queries go to every part, so a cell of a third of all rows
    is spread; recall grows with probes and is 1 when all cells are probed.
    """
    kind = vectors.schema[key].dataType.simpleString()
    stored = in_cells(vectors, key, vector, centroids, 1)
    sizes = stored.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # at most one row a cell
    right = stored.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_q"), "k", "v")
    asked = in_cells(queries, key, vector, centroids, probes).join(F.broadcast(sizes), "cell")
    left = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_q"), "k", "v")
    found = left.unionByName(right).groupBy("cell", "part").applyInArrow(_best(key, k), f"q {kind}, {key} {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
