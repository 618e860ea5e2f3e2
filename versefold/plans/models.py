"""Model operators: rows-only checks, except where they are arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import relational as R
from ..operators import text_stats as T
from ..session import table
from .registry import query


@query()
def ml_01_lda_topics(s, d):
    return M.lda(table(s, d, "documents").where("text is not null"), "doc_id", T.tokens(F.col("text")), range(4, 13))[0]


@query()
def ml_01_lda_keywords(s, d):
    return M.lda(table(s, d, "documents").where("text is not null"), "doc_id", T.tokens(F.col("text")), range(4, 13))[1]


@query()
def ml_02_kmeans(s, d):
    out, k, score = M.kmeans_search(table(s, d, "embeddings"), "vec_id", "embedding", 3, 12)
    return out.select("vec_id", "cluster", F.lit(k).alias("k"), F.lit(round(score, 4)).alias("silhouette"))


@query()
def ml_03_hierarchical(s, d):
    return M.hierarchical(table(s, d, "embeddings"), "vec_id", "embedding", 8)


def _labelled(s, d):
    return table(s, d, "embeddings").where("label is not null").select("vec_id", "embedding", "label")


def _two(s, d):
    return table(s, d, "embeddings").where("label is not null").select("vec_id", "embedding", (F.col("label") % 3).alias("label"))


@query()
def ml_04_linear_svc(s, d):
    return M.svc_out_of_fold(_labelled(s, d), "vec_id", "embedding", "label", 5)


@query()
def ml_05_scaled_pipeline(s, d):
    return M.out_of_fold(_labelled(s, d), "vec_id", "embedding", "label", 5, M.logistic)


@query("SELECT label, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM (SELECT label % 3 AS label, (row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1) % 5 AS fold FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2")
def ml_06_folds(s, d):
    t = _two(s, d)
    return M.folds(t, "vec_id", "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def ml_07_stratified_split(s, d):
    return M.stratified_split(table(s, d, "embeddings"), "vec_id", "label", 0.2, 3)


@query("SELECT round(avg(CAST(f = t AS INTEGER)), 4) AS folded, round(avg(CAST(g = t AS INTEGER)), 4) AS direct, CASE WHEN abs(avg(CAST(f = t AS INTEGER)) - avg(CAST(g = t AS INTEGER))) < 0.03 THEN 'coherent' WHEN abs(avg(CAST(f = t AS INTEGER)) - avg(CAST(g = t AS INTEGER))) < 0.08 THEN 'acceptable' ELSE 'incoherent' END AS verdict FROM (SELECT label % 2 AS t, ((vec_id % 10) % 2) AS f, (vec_id % 3) % 2 AS g FROM embeddings)")
def ml_08_coherence(s, d):
    t = table(s, d, "embeddings").select((F.col("label") % 2).alias("t"), (F.col("vec_id") % 10 % 2).alias("f"), (F.col("vec_id") % 3 % 2).alias("g"))
    a, b = (F.avg((F.col(c) == F.col("t")).cast("int")) for c in "fg")
    return t.agg(F.round(a, 4).alias("folded"), F.round(b, 4).alias("direct"), F.when(F.abs(a - b) < 0.03, "coherent").when(F.abs(a - b) < 0.08, "acceptable").otherwise("incoherent").alias("verdict"))


@query()
def ml_09_ablation(s, d):
    """Macro F1 of feature prefixes; the best one is marked."""
    rows = None
    for n in (4, 16, 64):
        t = _labelled(s, d).withColumn("embedding", F.slice("embedding", 1, n))
        p = M.out_of_fold(t, "vec_id", "embedding", "label", 5, M.logistic)
        f1 = R.classification_report(p, "y", "p").agg(F.avg("f1").alias("macro_f1")).select(F.lit(n).alias("features"), F.round("macro_f1", 4).alias("macro_f1"))
        rows = f1 if rows is None else rows.unionByName(f1)
    best = rows.agg(F.max("macro_f1").alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("features", "macro_f1", (F.col("macro_f1") == F.col("best")).alias("is_best"))


@query("SELECT label, round((SELECT count(*) FROM embeddings) / (CAST((SELECT count(DISTINCT label) FROM embeddings) AS DOUBLE) * count(*)), 6) AS weight FROM embeddings GROUP BY label")
def ml_10_class_weights(s, d):
    return M.class_weights(table(s, d, "embeddings"), "label").select("label", F.round("weight", 6).alias("weight"))


@query("SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 'positive' ELSE 'negative' END AS label, least(abs(CAST(embedding[1] AS DOUBLE)), 1) AS confidence FROM embeddings")
def ml_11_batched_inference(s, d):
    """Labels and confidences from an injected scoring function, by Arrow batches."""
    import numpy as np
    import pandas as pd

    def score(batches):
        for b in batches:
            v = np.stack(b["embedding"].to_numpy())[:, 0].astype(float) if len(b) else np.zeros(0)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": np.where(v > 0, "positive", "negative"), "confidence": np.minimum(np.abs(v), 1.0)})

    return table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(score, "vec_id bigint, label string, confidence double")


@query(
    "SELECT vec_id, l1, l2, CASE WHEN l1 = 'neutral' THEN 'n/a' WHEN l2 = 'joy' THEN CASE WHEN e5 >= e6 THEN 'love' ELSE 'praise' END WHEN l2 = 'calm' THEN 'peace' WHEN l2 = 'grief' THEN CASE WHEN e7 >= e8 THEN 'loss' ELSE 'parting' END ELSE 'scorn' END AS l3 FROM (SELECT *, CASE l1 WHEN 'neutral' THEN 'n/a' WHEN 'positive' THEN CASE WHEN e1 >= e2 THEN 'joy' ELSE 'calm' END ELSE CASE WHEN e3 >= e4 THEN 'grief' ELSE 'anger' END END AS l2 FROM (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' ELSE 'negative' END AS l1, "
    + ", ".join(f"embedding[{i}] AS e{i}" for i in range(1, 9))
    + " FROM embeddings))"
)
def ml_12_cascade(s, d):
    e = [F.col("embedding")[i] for i in range(8)]
    l1 = F.when(F.col("label") % 3 == 0, "neutral").when(F.col("label") % 3 == 1, "positive").otherwise("negative")
    l2, l3 = M.cascade(
        l1, {"positive": ["joy", "calm"], "negative": ["grief", "anger"]}, dict(zip(("joy", "calm", "grief", "anger"), e[:4])),
        {"joy": ["love", "praise"], "calm": ["peace"], "grief": ["loss", "parting"], "anger": ["scorn"]}, {"love": e[4], "praise": e[5], "peace": e[4], "loss": e[6], "parting": e[7], "scorn": e[4]}, "neutral",
    )
    return table(s, d, "embeddings").select("vec_id", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


@query()
def ml_13_pca(s, d):
    return M.pca(table(s, d, "embeddings"), "vec_id", "embedding", 2)
