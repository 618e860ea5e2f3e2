"""Queries and operators do the whole job, not a part of it."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.sql import functions as F

from versefold import plans
from versefold.operators import models as M
from versefold.session import table
from versefold.sources import stores


def test_matrix_shards(spark, small, tmp_path):
    df = spark.range(25, numPartitions=3).selectExpr("id", "array(id * 1.5D, 0D) as v")
    assert stores.write_shards(df, "id", "v", str(tmp_path)) == 25
    assert len(list(tmp_path.glob("*.keys.npy"))) >= 3
    assert sorted((r.key, r.vector[0]) for r in stores.read_shards(spark, str(tmp_path), rows=4).collect()) == [(i, i * 1.5) for i in range(25)]
    assert sum(np.load(f).shape[0] for f in tmp_path.glob("*.rows.npy")) == 25


def test_matrix_has_all_rows(spark, small):
    assert plans.QUERIES["src_15_matrix"](spark, small).count() == table(spark, small, "embeddings").count() > 100


@pytest.mark.parametrize("name,of", [("sort_02_numeric_first", "review_tool"), ("sort_03_mixed_direction", "product"), ("sort_04_verdict_rank", "review_tool")])
def test_sorts_keep_all_rows_in_order(spark, small, name, of):
    got = [r["rank"] for r in plans.QUERIES[name](spark, small).collect()]
    assert got == list(range(1, table(spark, small, of).count() + 1)) and len(got) > 100


def test_all_months_in_order(spark, small):
    got = plans.QUERIES["sort_01_domain_order"](spark, small).collect()
    assert [r["月份"] for r in got[:12]] == "正月 二月 三月 四月 五月 六月 七月 八月 九月 十月 十一月 十二月".split()
    assert sum(r.n for r in got) == table(spark, small, "review_tool").count() and got[-1]["月份"] is None


def test_bigrams_of_whole_texts(spark, tmp_path):
    long = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [(1, long, "verse"), (2, "一", "verse"), (3, "", "prose"), (4, None, None), (5, "ab，c", "english")]
    spark.createDataFrame(rows, "item_id bigint, text string, kind string").write.parquet(f"{tmp_path}/eval_item.parquet")
    got = {r.item_id: r.grams for r in plans.QUERIES["ret_03_query_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: [long[i : i + 2] for i in range(59)], 2: [], 3: [], 4: [], 5: ["ab", "b，"]}


def test_sentences_of_all_languages(spark, tmp_path):
    rows = [(1, "一二三四。五六七八！", "zh"), (2, "一二三四。五六七八！", "zh-hant"), (3, "一二三四。", None), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.parts for r in plans.QUERIES["fn_12_sentences"](spark, str(tmp_path)).collect()}
    assert got == {1: "一二三四。¦五六七八！", 2: "一二三四。¦五六七八！", 3: "一二三四。", 4: None}


def test_topics_are_searched_over_all_documents(spark):
    assert M.elbow([9.0, 8.5, 5.0, 4.9]) == 2 and M.elbow([3.0]) == 0
    df = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(30)], "k int, t array<string>")
    docs, top = M.lda(df, "k", F.col("t"), [2, 3], rounds=3, final=5)
    assert docs.count() == 30 and top.count() in (2, 3)
    side = {(r.k % 2, r.dominant_topic) for r in docs.collect()}
    assert {a for a, _ in side} == {0, 1}


def test_clusters_are_found_above_six(spark):
    rows = [(i, [10.0 * (i % 9 == j) + 0.01 * (i // 9) for j in range(9)]) for i in range(90)]
    out, k, score = M.kmeans_search(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 8, 10, starts=3)
    assert k == 9 and score > 0.9 and out.count() == 90


def test_predictions_of_all_labels_by_five_folds(spark, tmp_path, monkeypatch):
    seen = []
    real = M.out_of_fold
    monkeypatch.setattr(M, "out_of_fold", lambda df, key, column, label, k, *a: seen.append(k) or real(df, key, column, label, k, *a))
    rows = [(i, [float(i % 10 == j) for j in range(10)], i % 10) for i in range(100)]
    spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.QUERIES["ml_05_scaled_pipeline"](spark, str(tmp_path)).collect()
    assert seen == [5] and len(got) == 100 and all(r.p == r.y == r.vec_id % 10 for r in got)


def hinge(v, x, y, w):
    return (w * np.maximum(1 - y * (x @ v[:-1] + v[-1]), 0)).sum() / w.sum()


def test_support_vectors_of_all_folds_are_fitted_together(spark, monkeypatch):
    """Losses no worse than those of Spark's own support vectors, and few jobs; classes in parts give the same."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) + 1.2 * np.eye(6)[i % 3] * (1 + i % 2)).tolist(), float(i % 3), 1.0 + i % 3, i // 3 % 2) for i in range(240)]
    x = spark.createDataFrame(rows, "i int, embedding array<double>, y double, weight double, fold int").coalesce(1).persist()
    got, few = M.svc_weights(x, 2, [0.0, 1.0, 2.0]), M.svc_weights(x, 2, [0.0, 1.0, 2.0], 2)
    monkeypatch.setattr(M, "MODELS", 4)
    assert got.shape == (2, 3, 7) and np.allclose(M.svc_weights(x, 2, [0.0, 1.0, 2.0], 2), few, atol=1e-9)
    m, y, w, fold = (np.array([r[j] for r in rows]) for j in (1, 2, 3, 4))
    for f, c in ((0, 0), (1, 2)):
        df = M.vectors(x.where(f"fold <> {f}"), "embedding").withColumn("t", (F.col("y") == c).cast("double"))
        own = LinearSVC(maxIter=20, labelCol="t", weightCol="weight").fit(df)
        use, sign = fold != f, np.where(y == c, 1, -1)
        a, b = (hinge(v, m[use], sign[use], w[use]) for v in (got[f, c], np.append(own.coefficients.toArray(), own.intercept)))
        assert a <= 1.02 * b + 0.002


def test_support_vectors_take_few_jobs(spark, tmp_path):
    rows = [(i, [float(i % 10 == j) for j in range(10)], i % 10) for i in range(100)]
    spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sparkContext.setJobGroup("svc", "svc")
    got = plans.QUERIES["ml_04_linear_svc"](spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svc"))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert len(got) == 100 and all(r.p == r.y == r.vec_id % 10 for r in got)
    assert 0 < jobs < 150  # two for a round, not some for each round of each of 50 models


def test_topics_equal_plain_expectation_maximization(spark, monkeypatch):
    """All models side by side and in blocks give what each gives alone, computed plainly; a text of no word of the vocabulary has even shares."""
    monkeypatch.setattr(M, "DOCUMENTS", 7)
    rng = np.random.default_rng(3)
    texts = [list(rng.choice(list("abcde" if i % 2 else "defgh"), 12)) for i in range(30)] + [["z"]]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t array<string>")
    spark.sparkContext.setJobGroup("lda", "lda")
    docs, top = M.lda(df, "k", F.col("t"), [2, 3, 4], rounds=6, final=9)
    got = {r.k: r for r in docs.collect()}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("lda")) < 50  # two for a round, not some for each round of each model
    spark.sparkContext._jsc.sc().clearJobGroup()
    k = len([c for c in docs.columns if c.startswith("topic_")])
    at = np.repeat(np.arange(30), 12)
    start = np.random.default_rng(42).uniform(0.5, 1.5, (8, 9))
    count = Counter(w for t in texts[:30] for w in t)
    vocabulary = sorted(count, key=lambda w: (-count[w], w))
    words = np.array([vocabulary.index(w) for t in texts[:30] for w in t])

    def plain(k, lo, rounds):
        n_w, n_d = start[:, lo : lo + k], np.zeros((30, k))
        for _ in range(rounds):
            share = (n_w + 0.1) / (n_w + 0.1).sum(0)
            p = share[words] * (n_d[at] + 50 / k)
            perplexity = np.exp(-np.log(p.sum(1) / ((n_d.sum(1)[at] + 50))).mean())
            p /= p.sum(1, keepdims=True)
            n_w, n_d = np.zeros((8, k)), np.zeros((30, k))
            np.add.at(n_w, words, p)
            np.add.at(n_d, at, p)
        return (n_d + 50 / k) / (12 + 50), perplexity

    tried = [plain(k, lo, 6)[1] for k, lo in ((2, 0), (3, 2), (4, 5))]
    assert k == [2, 3, 4][M.elbow(tried)]
    want, _ = plain(k, {2: 0, 3: 2, 4: 5}[k], 9)
    assert np.allclose([[got[i][f"topic_{j}"] for j in range(k)] for i in range(30)], want, atol=1e-3)
    assert got[30].dominant_topic_score == pytest.approx(1 / k) and top.count() == k
