"""Thin wrappers of Spark ML, and the splits and reports around models."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import Stage, spread
from .relational import numbered

#: Texts of a block of topic counts.
DOCUMENTS = 512
#: Models whose losses one pass over the rows sums up.
MODELS = 1024
#: Steps that a line search tries, all in one pass.
STEPS = 2.0 ** np.arange(3, -13, -1)


def vectors(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def together(f: Callable, items: Sequence, threads: int = 8) -> list:
    """f of each item, in their order; the jobs of up to `threads` items run at the same time."""
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(f, items, chunksize=1)


def elbow(values: Sequence[float]) -> int:
    """Place of the value after the largest fall, from 0; 0 where there is one value only."""
    falls = [x - y for x, y in zip(values, values[1:])]
    return falls.index(max(falls)) + 1 if falls else 0


def _blocks(x: DataFrame, key: str, width: int) -> DataFrame:
    """keys, data, state, sums: DOCUMENTS texts a row, from key, terms ARRAY<INT>, counts ARRAY<DOUBLE>; a state of zeros."""
    kind = x.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), DOCUMENTS):
                b = whole.slice(lo, DOCUMENTS)
                size, terms, counts = np.asarray(pc.list_value_length(b.column(1))), np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten())
                data = np.concatenate(([len(size)], size, terms)).astype(np.int32).tobytes() + counts.astype(np.float32).tobytes()
                keys = pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([data], pa.binary()), pa.array([np.zeros((len(b), width), np.float32).tobytes()], pa.binary()), pa.array([None], pa.binary())], names=["keys", "data", "state", "sums"])

    return x.select(key, "terms", "counts").mapInArrow(run, f"keys array<{kind}>, data binary, state binary, sums binary")


def _counted(t: DataFrame, key: str, terms: dict[str, int]) -> DataFrame:
    """key, terms ARRAY<INT>, counts ARRAY<DOUBLE>: how often each word of the vocabulary stands in a text, from key and t."""
    value = t.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(value.value[x] for x in row if x in value.value) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(map(float, c.values())) for c in found], pa.list_(pa.float64()))], names=[key, "terms", "counts"])

    return spread(t).mapInArrow(run, f"`{key}` {t.schema[key].dataType.simpleString()}, terms array<int>, counts array<double>")


def _narrowed(blocks: DataFrame, kept: np.ndarray) -> DataFrame:
    """Blocks with these columns of their states."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states = [np.frombuffer(x.as_py(), np.float32).reshape(-1, len(kept))[:, kept].tobytes() for x in b.column(2)]
            yield b.set_column(2, "state", pa.array(states, pa.binary()))

    return blocks.where("data is not null").mapInArrow(run, blocks.schema)


class Topics:
    """Expectation maximization of models of several numbers of topics side by side: a column for each topic of each model.

    The priors are Spark's (50 / k + 1 and 1.1). words: (terms, columns), the expected counts of the round before.
    """

    def __init__(self, topics: Sequence[int], words: np.ndarray):
        self.topics, self.words = list(topics), words
        self.of = np.repeat(np.arange(len(self.topics)), self.topics)
        self.alpha = np.repeat([50 / k for k in self.topics], self.topics).astype(np.float32)
        self.one = (self.of[:, None] == np.arange(len(self.topics))).astype(np.float32)
        smooth = words + 0.1
        self.share = (smooth / smooth.sum(0)).astype(np.float32)

    def step(self, data: bytes, state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's new state, its terms' expected counts, and each model's log-likelihood before the round."""
        head = np.frombuffer(data, np.int32)
        docs = int(head[0])
        size = head[1 : 1 + docs]
        total = int(size.sum())
        terms, counts = head[1 + docs : 1 + docs + total], np.frombuffer(data, np.float32)[1 + docs + total :]
        old = np.frombuffer(state, np.float32).reshape(docs, -1)
        new, words = np.zeros((docs, len(self.of)), np.float32), np.zeros(self.words.shape)
        if not total:
            return new, words, np.zeros(len(self.topics))
        p = self.share[terms]
        p *= np.repeat(old + self.alpha, size, 0)
        each = p @ self.one
        some = np.flatnonzero(size)
        start = (np.cumsum(size) - size)[some]
        length = np.add.reduceat(counts, start)[:, None]
        scale = np.log(np.where(old.any(1)[some, None], length, 0) + np.array([50.0] * len(self.topics)))
        likely = counts.astype(float) @ np.log(each) - (length * scale).sum(0)
        p *= (counts[:, None] / each) @ self.one.T
        new[some] = np.add.reduceat(p, start, 0)
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(terms[order]) != 0))
        words[terms[order][first]] = np.add.reduceat(p[order], first, 0)
        return new, words, likely

    def round(self, blocks: DataFrame, stage: Stage, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """The blocks after a round, written; the terms' counts; the log-likelihoods."""
        me, shape = self, (len(self.words) + 1, len(self.of))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for b in batches:
                for i in range(len(b)):
                    row = b.slice(i, 1)
                    new, words, likely = me.step(row.column(1)[0].as_py(), row.column(2)[0].as_py())
                    sums[:-1] += words
                    sums[-1, : len(likely)] += likely
                    yield pa.RecordBatch.from_arrays([row.column(0).cast(keys), row.column(1), pa.array([new.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=["keys", "data", "state", "sums"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, keys), *(pa.nulls(1, pa.binary()),) * 2, pa.array([sums.tobytes()], pa.binary())], names=["keys", "data", "state", "sums"])

        keys = to_arrow_type(blocks.schema["keys"].dataType)
        out = stage.write(blocks.where("data is not null").mapInArrow(run, blocks.schema), name)
        sums = summed(out.where("sums is not null").select("sums"), lambda b: sum(np.frombuffer(x.as_py()).reshape(shape) for x in b.column(0)), shape)
        return out, sums[:-1], sums[-1, : len(self.topics)]

    def only(self, i: int) -> np.ndarray:
        return self.of == i


def lda(df: DataFrame, key: str, toks: Column, topics: Sequence[int], vocabulary: int = 2000, rounds: int = 30, final: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(key, topic_i.., dominant_topic, dominant_topic_score) and (topic_id, top_words) of an LDA by expectation maximization, which uses all documents in every round.

    topics: the numbers of topics to try with `rounds` rounds each, all side by side in one pass over the texts for a
    round; the one after the largest fall of perplexity goes on to `final` rounds. A round's state is a written table.
    """
    t = df.select(key, toks.alias("t")).where(F.size("t") > 0)
    each = t.select(F.explode("t").alias("w"), F.lit(0).alias("first")).unionByName(t.select(F.explode(F.array_distinct("t")).alias("w"), F.lit(1).alias("first")))
    often = each.groupBy("w").agg(F.sum(1 - F.col("first")).alias("n"), F.sum("first").alias("docs")).where("docs >= 2")
    names = [r.w for r in often.orderBy(F.desc("n"), "w").limit(vocabulary).collect()]  # equal counts: by the word
    stage, topics = Stage(df.sparkSession, "topics"), list(topics)
    terms = {w: i for i, w in enumerate(names)}
    blocks = stage.write(_blocks(_counted(t, key, terms), key, sum(topics)), "round0")
    rng = np.random.default_rng(seed)
    model = Topics(topics, rng.uniform(0.5, 1.5, (len(terms), sum(topics))))
    n = 0

    def go(model: Topics, blocks: DataFrame, n: int, to: int) -> tuple[Topics, DataFrame, np.ndarray]:
        likely = np.zeros(len(model.topics))
        for i in range(n + 1, to + 1):
            blocks, words, likely = model.round(blocks, stage, f"round{i}")
            stage.drop(f"round{i - 1}")
            model = Topics(model.topics, words)
        return model, blocks, likely

    if len(topics) > 1:
        model, blocks, likely = go(model, blocks, 0, rounds)
        n = rounds
        tokens = max(model.words.sum() / len(topics), 1)
        best = elbow(np.exp(-likely / tokens).tolist())
        kept = model.only(best)
        blocks = stage.write(_narrowed(blocks, kept), f"round{n}best")
        model = Topics([topics[best]], model.words[:, kept])
    k = model.topics[0]
    model, blocks, _ = go(model, blocks, n, max(final, n))
    kind = df.schema[key].dataType.simpleString()

    def shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, state in zip(b.column(0), b.column(1)):
                p = np.frombuffer(state.as_py(), np.float32).reshape(-1, k).astype(float) + 50 / k
                yield pa.RecordBatch.from_arrays([keys.values, pa.array((p / p.sum(1, keepdims=True)).tolist(), pa.list_(pa.float64()))], names=[key, "p"])

    d = blocks.where("data is not null").select("keys", "state").mapInArrow(shares, f"`{key}` {kind}, p array<double>")
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    docs = d.select(key, *[F.col("p")[i].alias(f"topic_{i}") for i in range(k)], best.alias("dominant_topic"), F.array_max("p").alias("dominant_topic_score"))
    words = [(i, [names[j] for j in np.argsort(-model.share[:, i], kind="stable")[:15]]) for i in range(k)]
    return docs, df.sparkSession.createDataFrame(words, "topic_id int, top_words array<string>")


def kmeans_search(df: DataFrame, key: str, column: str, low: int, high: int, seed: int = 42, starts: int = 10) -> tuple[DataFrame, int, float]:
    """(key, cluster), best k and its silhouette: k from low to high, for each k the start of least cost; the data are read from memory after the first."""
    x = vectors(df.select(key, column), column).select(key, "features").persist()
    ev = ClusteringEvaluator()
    best = None
    try:
        x.count()  # in memory before the jobs that share it
        ks = range(low, high + 1)
        tried = together(lambda a: (m := KMeans(k=a[0], seed=seed + a[1], maxIter=20).fit(x), m.summary.trainingCost), [(k, i) for k in ks for i in range(starts)])
        outs = [min(tried[i : i + starts], key=lambda a: a[1])[0].transform(x) for i in range(0, len(tried), starts)]
        for k, out, score in zip(ks, outs, together(ev.evaluate, outs)):
            if best is None or score > best[2] + 1e-12:
                best = (out.select(key, F.col("prediction").alias("cluster")), k, score)
    finally:
        x.unpersist()
    return best


def hierarchical(df: DataFrame, key: str, column: str, k: int, seed: int = 42) -> DataFrame:
    """key, cluster by bisecting k-means, the divisive hierarchy that scales; an agglomerative one needs all pairs."""
    x = vectors(df.select(key, column), column)
    return BisectingKMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight = n / (K n_label)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return c.crossJoin(F.broadcast(t)).select(label, (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """The rows with a stratified fold: places in the order of a seeded hash within each label, modulo k."""
    return numbered(df, label, key, seed, "__place", "__total").withColumn("fold", F.pmod("__place", F.lit(k)).cast("int")).drop("__place", "__total")


def stratified_split(df: DataFrame, key: str, label: str, test: float, rare: int, seed: int = 42) -> DataFrame:
    """key, label, split: of each label the share `test` by hash order is test; labels of at most `rare` rows are all train."""
    x = numbered(df.select(key, label), label, key, seed, "__place", "__total")
    return x.select(key, label, F.when((F.col("__total") > rare) & (F.col("__place") / F.col("__total") < test), "test").otherwise("train").alias("split"))


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of an array of this shape over all batches; partitions are added up before they come to the driver."""

    def run(batches: Iterable[pa.RecordBatch], of: Callable = part) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if len(b):
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    sums = df.mapInArrow(run, "sum binary")
    if (n := df.rdd.getNumPartitions()) > 32:
        sums = sums.repartition(math.isqrt(n)).mapInArrow(lambda batches: run(batches, lambda b: sum(np.frombuffer(x.as_py()).reshape(shape) for x in b.column(0))), "sum binary")
    return sum((np.frombuffer(r["sum"]).reshape(shape) for r in sums.collect()), np.zeros(shape))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays, and a last column of ones."""
    x = np.asarray(column.flatten()).reshape(len(column), -1)
    return np.hstack((x, np.ones((len(x), 1))))


class Directions:
    """Limited-memory BFGS of many independent models at once, a row each."""

    def __init__(self, memory: int = 10):
        self.memory, self.past = memory, []

    def seen(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = (s * y).sum(1)
        self.past = [*self.past[1 - self.memory :], (s, y, np.where(sy > 1e-12, 1 / np.where(sy > 1e-12, sy, 1), 0), (y * y).sum(1))]

    def of(self, g: np.ndarray) -> np.ndarray:
        q, done = g.copy(), []
        for s, y, r, _ in reversed(self.past):
            done.append(a := r * (s * q).sum(1))
            q -= a[:, None] * y
        scale = np.full(len(g), np.nan)
        for _, _, r, yy in self.past:  # the last valid pair of each model
            scale = np.where(r > 0, 1 / (np.where(r > 0, r, 1) * np.maximum(yy, 1e-300)), scale)
        first = 0.5 / np.maximum(np.sqrt((g * g).sum(1)), 1e-300)
        q *= np.where(np.isnan(scale), first, scale)[:, None]
        for (s, y, r, _), a in zip(self.past, reversed(done)):
            q += (a - r * (y * q).sum(1))[:, None] * s
        return -q


def svc_weights(x: DataFrame, k: int, classes: Sequence[float], rounds: int = 20) -> np.ndarray:
    """(k, classes, dimensions + 1): one-vs-rest linear support vectors, on scaled features and weighted by `weight`, for the rows outside each of k folds.

    x: embedding ARRAY<DOUBLE>, weight, y, fold. All folds and classes (MODELS of them at a time) are fitted together: two
    passes over the rows for a round, one for the losses of all steps and one for the slopes.
    """
    x = x.select("embedding", "weight", "y", "fold")
    head = x.select(F.size("embedding").alias("n")).first()
    if head is None:
        return np.zeros((k, 0, 1))
    d = head.n + 1

    def moments(b: pa.RecordBatch) -> np.ndarray:
        m, w, f = _matrix(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(3))
        return np.stack([np.stack((m[f == i].sum(0), (m[f == i] ** 2).sum(0), np.full(d, w[f == i].sum()))) for i in range(k)])

    of = summed(x, moments, (k, 3, d))
    total, square, weight = np.moveaxis(of.sum(0) - of, 1, 0)  # of the rows outside each fold
    n = total[:, -1:]
    deviation = np.sqrt(np.maximum(square - total**2 / np.maximum(n, 1), 0) / np.maximum(n - 1, 1))
    scale = np.where(deviation > 1e-9 * np.sqrt(square / np.maximum(n, 1)), 1 / np.where(deviation > 0, deviation, 1), 0.0)
    scale[:, -1] = 1
    share = 1 / np.maximum(weight[:, 0], 1e-300)

    def fit(some: np.ndarray) -> np.ndarray:
        size, by_row = k * len(some), np.repeat(scale, len(some), 0)

        def rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Rows, the sign of each model for them, and their weight in it: 0 in the models of their own fold."""
            m, w, y, f = _matrix(b.column(0)), *(np.asarray(b.column(i)) for i in (1, 2, 3))
            for lo in range(0, len(m), 1024):
                at = slice(lo, lo + 1024)
                sign = np.tile(np.where(y[at, None] == some, 1.0, -1.0), (1, k))
                yield m[at], sign, np.repeat(w[at, None] * (f[at, None] != np.arange(k)) * share, len(some), 1)

        def slopes(v: np.ndarray) -> np.ndarray:
            """Of each model the loss, then its slope."""
            use = (v * by_row).T

            def part(b: pa.RecordBatch) -> np.ndarray:
                out = np.zeros((size, d + 1))
                for m, sign, w in rows(b):
                    loss = 1 - sign * (m @ use)
                    out[:, 0] += (w * np.maximum(loss, 0)).sum(0)
                    out[:, 1:] -= (w * sign * (loss > 0)).T @ m
                return out

            out = summed(x, part, (size, d + 1))
            out[:, 1:] *= by_row
            return out

        def losses(v: np.ndarray, step: np.ndarray) -> np.ndarray:
            use, go = (v * by_row).T, (step * by_row).T

            def part(b: pa.RecordBatch) -> np.ndarray:
                out = np.zeros((len(STEPS), size))
                for m, sign, w in rows(b):
                    here, there = 1 - sign * (m @ use), sign * (m @ go)
                    for i, a in enumerate(STEPS):
                        out[i] += (w * np.maximum(here - a * there, 0)).sum(0)
                return out

            return summed(x, part, (len(STEPS), size))

        v, way = np.zeros((size, d)), Directions()
        now = slopes(v)
        for _ in range(rounds):
            step = way.of(now[:, 1:])
            slope = (step * now[:, 1:]).sum(1)
            tried = losses(v, step)
            tried = np.where(tried <= now[:, 0] + 1e-4 * STEPS[:, None] * slope, tried, np.inf)
            best = tried.argmin(0)
            found = np.isfinite(tried.min(0)) & (slope < 0)
            if not found.any():
                break
            moved = np.where(found, STEPS[best], 0.0)[:, None] * step
            after = slopes(v + moved)
            way.seen(moved, after[:, 1:] - now[:, 1:])
            v, now = v + moved, after
        return (v * by_row).reshape(k, len(some), d)

    each = max(1, MODELS // k)
    return np.concatenate([fit(np.array(classes[i : i + each])) for i in range(0, len(classes), each)], 1)


def logistic(rounds: int = 30) -> Pipeline:
    """Multinomial logistic regression with probabilities."""
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="x", withMean=False), LogisticRegression(maxIter=rounds, featuresCol="x", labelCol="y", weightCol="weight", predictionCol="p")])


def _folded(df: DataFrame, key: str, column: str, label: str, k: int, seed: int) -> DataFrame:
    """key, the column, weight, y and fold of the rows with a label, in memory before the jobs that share them."""
    x = df.select(key, column, label).join(F.broadcast(class_weights(df, label)), label)
    x = folds(x.withColumn("y", F.col(label).cast("double")), key, label, k, seed).select(key, F.transform(column, lambda v: v.cast("double")).alias("embedding"), "weight", "y", "fold").persist()
    x.count()
    return x


def out_of_fold(df: DataFrame, key: str, column: str, label: str, k: int, make: Callable[[], Pipeline] = logistic, seed: int = 42) -> DataFrame:
    """key, y, p: predictions of each row by the model that did not see its fold."""
    own = _folded(df, key, column, label, k, seed)
    x = vectors(own, "embedding")
    models = together(lambda i: make().fit(x.where(F.col("fold") != i)), range(k))
    out = None
    for i, m in enumerate(models):
        part = m.transform(x.where(F.col("fold") == i)).select(key, "y", "p")
        out = part if out is None else out.unionByName(part)
    written = Stage(df.sparkSession, "folds").write(out, "predictions")
    own.unpersist()
    return written


def svc_out_of_fold(df: DataFrame, key: str, column: str, label: str, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """The same by one-vs-rest linear support vectors; see svc_weights."""
    x = _folded(df, key, column, label, k, seed)
    classes = np.array(sorted(r.y for r in x.select("y").distinct().collect()))
    value = df.sparkSession.sparkContext.broadcast((svc_weights(x, k, classes, rounds), classes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, names = value.value
        for b in batches:
            m, f, p = _matrix(b.column(1)) if len(b) else np.zeros((0, weights.shape[2])), np.asarray(b.column(3)), np.zeros(len(b))
            for i in range(k):
                at = np.flatnonzero(f == i)
                if len(at):
                    p[at] = names[(m[at] @ weights[i].T).argmax(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p)], names=[key, "y", "p"])

    src = x.select(key, "embedding", "y", "fold")
    out = Stage(df.sparkSession, "folds").write(src.mapInArrow(run, f"`{key}` {src.schema[key].dataType.simpleString()}, y double, p double"), "predictions")
    x.unpersist()
    return out


def pca(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """key, pc0, pc1, ..."""
    x = vectors(df.select(key, column), column)
    out = PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select(key, vector_to_array("pc").alias("pc"))
    return out.select(key, *[F.col("pc")[i].alias(f"pc{i}") for i in range(k)])


def cascade(first: Column, allowed_second: Mapping[str, Sequence[str]], second: Mapping[str, Column], allowed_third: Mapping[str, Sequence[str]], third: Mapping[str, Column], neutral: str) -> tuple[Column, Column]:
    """(second, third) labels under the first: each level's best label among those that the level above allows; n/a under a neutral first."""
    from .columns import constrained_arg_max

    l2 = F.when(first == neutral, "n/a").otherwise(constrained_arg_max(first, allowed_second, second))
    l3 = F.when(first == neutral, "n/a").otherwise(constrained_arg_max(l2, allowed_third, third))
    return l2, l3
