"""Corpus statistics in long form: one row for each document and term, never a matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of two letters or more, and pairs of ideographs. Both engines of the SQL check read it alike.
TOKEN = "([a-z]{2,}|[一-鿿]{2})"


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """ARRAY<STRING> in order of the text; null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))


def term_counts(df: DataFrame, key: str, toks: Column) -> DataFrame:
    """key, term, tf."""
    return df.select(key, F.explode(toks).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(counts: DataFrame, key: str) -> DataFrame:
    """term, df (documents that have it), total."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def tfidf(counts: DataFrame, key: str, n_docs: DataFrame, min_df: int = 2, max_df: float = 0.85, features: int = 300) -> DataFrame:
    """key, term, score: raw tf, idf = ln((1 + n) / (1 + df)) + 1, rows of length 1, over the most frequent terms.

    n_docs: one row with column n. The feature list is at most `features` rows, so it is broadcast.
    """
    vocabulary = frequencies(counts, key).crossJoin(F.broadcast(n_docs)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("total"), "term").limit(features)
    idf = vocabulary.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = counts.join(F.broadcast(idf), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("score"))


def pmi(df: DataFrame, group: str, key: str, toks: Column, min_df: int = 2) -> DataFrame:
    """group, term, n, pmi = log2(P(group, term) / (P(group) P(term))), over documents."""
    docs = df.where(F.col(group).isNotNull()).select(group, key, F.array_distinct(toks).alias("t"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    of_group = docs.groupBy(group).agg(F.count(F.lit(1)).alias("n_group"))
    both = docs.select(group, F.explode("t").alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))
    of_term = both.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)
    j = both.join(of_term, "term").join(of_group, group).crossJoin(F.broadcast(n))
    return j.select(group, "term", "n", F.log2(F.col("n") * F.col("n_docs") / (F.col("n_group") * F.col("df"))).alias("pmi"))


def cooccurrence(df: DataFrame, key: str, toks: Column, window: int = 4) -> DataFrame:
    """key, a, b, w: how often b stands within `window` places of a, a and b different; built from shifted arrays, without a self-join."""
    t = df.select(key, toks.alias("t"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.when(F.size("t") > d, F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - d).alias("a"), F.slice("t", d + 1, F.size("t") - d).alias("b"))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))))
    one = t.select(key, F.explode(pairs).alias("p")).select(key, F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).where("a <> b")
    half = one.groupBy(key, "a", "b").agg(F.count(F.lit(1)).alias("w"))  # each pair in one direction; the other one is the same
    return half.select(key, "w", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(key, "p.a", "p.b", "w")


def token_importance(df: DataFrame, key: str, toks: str, heads: str) -> DataFrame:
    """key, term, weight: of matrices (heads, rows, tokens) the mean over heads and rows for each token, and of equal tokens the greatest."""
    rows = df.select(key, F.col(toks).alias("t"), F.flatten(heads).alias("r"))
    mean = F.transform("t", lambda _, j: F.aggregate("r", F.lit(0.0), lambda a, row: a + F.get(row, j)) / F.size("r"))
    each = rows.select(key, F.explode(F.arrays_zip(F.col("t").alias("term"), mean.alias("weight"))).alias("x"))
    return each.select(key, "x.term", "x.weight").groupBy(key, "term").agg(F.max("weight").alias("weight"))


def textrank(df: DataFrame, key: str, toks: Column, window: int = 4, rounds: int = 30, damping: float = 0.85, k: int = 10, digits: int = 6) -> DataFrame:
    """key, term, score, rank: the k best terms by unnormalised PageRank on each document's co-occurrence graph; under three tokens every score is 1.

    The graph is one document's, so a document's rounds and its ranking run inside one Arrow batch, without any shuffle.
    Scores are rounded to `digits`; equal ones by term.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(toks: list[str]) -> dict[str, float]:
        names = list(dict.fromkeys(toks))
        if len(toks) < 3:
            return dict.fromkeys(names, 1.0)
        at = {t: i for i, t in enumerate(names)}
        ids = np.array([at[t] for t in toks])
        a = np.concatenate([ids[:-d] for d in range(1, min(window, len(ids) - 1) + 1)])
        b = np.concatenate([ids[d:] for d in range(1, min(window, len(ids) - 1) + 1)])
        a, b = a[a != b], b[a != b]
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        out = np.bincount(a, minlength=len(names)).astype(float)
        score = np.ones(len(names))
        for _ in range(rounds):
            score = (1 - damping) + damping * np.bincount(b, weights=(score / np.maximum(out, 1e-300))[a], minlength=len(names))
        return dict(zip(names, score.tolist()))

    def run(batches):
        for pdf in batches:
            rows = []
            for name, toks in zip(pdf["k"], pdf["t"]):
                best = sorted(((-round(v, digits), t) for t, v in one(list(toks)).items()))[:k]
                rows += [(name, t, -v, i) for i, (v, t) in enumerate(best, 1)]
            yield pd.DataFrame(rows, columns=[key, "term", "score", "rank"])

    return df.select(F.col(key).alias("k"), toks.alias("t")).where(F.size("t") > 0).mapInPandas(run, f"{key} {kind}, term string, score double, rank bigint")
