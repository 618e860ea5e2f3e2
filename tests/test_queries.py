"""Every registered query runs on the smallest tables, and equals its SQL where it has one."""

import numpy as np
import pytest

from versefold import plans
from versefold.session import table

from .compare import check, database


def every_vector_once(p, spark, d, column="vec_id"):
    assert sorted(p[column]) == sorted(r.vec_id for r in table(spark, d, "embeddings").select("vec_id").collect())


def topics(p, spark, d):
    share = p[[c for c in p.columns if p[c].dtype == float]]
    assert p["doc_id"].is_unique and len(p) > 0 and ((share >= 0) & (share <= 1)).all(axis=None)


def keywords(p, spark, d):
    assert 4 <= len(p[p.columns[0]].unique()) <= 12


def clusters(p, spark, d):
    every_vector_once(p, spark, d)
    assert p["k"].nunique() == 1 and 3 <= p["k"][0] <= 12 and p["cluster"].nunique() == p["k"][0] and -1 <= p["silhouette"][0] <= 1


def hierarchy(p, spark, d):
    every_vector_once(p, spark, d)
    assert p[[c for c in p.columns if c != "vec_id"][0]].nunique() == 8


def predictions(p, spark, d):
    every_vector_once(p, spark, d)
    # The tables' labels have nothing to do with their vectors: what a model learns is tested on separable rows in test_whole.
    assert set(p["p"]) <= set(p["y"]) and p["p"].nunique() > 1


def split(p, spark, d):
    every_vector_once(p, spark, d)
    flag = [c for c in p.columns if c not in ("vec_id", "label", "embedding")][0]
    shares = p[flag].value_counts(normalize=True)
    assert len(shares) == 2 and abs(shares.min() - 0.2) < 0.05


def ablation(p, spark, d):
    assert sorted(p["features"]) == [4, 16, 64] and p.loc[p["is_best"], "macro_f1"].max() == p["macro_f1"].max() and p["macro_f1"].between(0, 1).all()


def neighbours(p, spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding").toPandas()
    m = np.array(e["embedding"].tolist(), float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids, hits, all_ = e["vec_id"].to_numpy(), 0, 0
    for q in ids[ids % 100 == 0]:
        s = m @ m[ids == q][0]
        s[ids == q] = -2
        best = set(ids[np.argsort(-s, kind="stable")[:10]])
        hits, all_ = hits + len(best & set(p[p["q"] == q]["vec_id"])), all_ + 10
    assert hits >= 0.9 * all_


def components(p, spark, d):
    every_vector_once(p, spark, d)
    assert not p.isna().any(axis=None)


INVARIANTS = {
    "ml_01_lda_topics": topics, "ml_01_lda_keywords": keywords, "ml_02_kmeans": clusters, "ml_03_hierarchical": hierarchy, "ml_04_linear_svc": predictions, "ml_05_scaled_pipeline": predictions,
    "ml_07_stratified_split": split, "ml_09_ablation": ablation, "ml_13_pca": components, "join_10_indexed_top10": neighbours, "text_04_textrank": lambda p, s, d: ranks(p),
}


def ranks(p):
    assert (p.groupby("doc_id")["rank"].max() <= 10).all() and (p.groupby("doc_id")["rank"].min() == 1).all()
    assert all((g.sort_values("rank")["score"].diff().dropna() <= 0).all() for _, g in p.groupby("doc_id"))


@pytest.fixture(scope="module")
def db(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, small, db):
    df = plans.QUERIES[name](spark, small)
    if name in plans.ORACLES:
        check(df, db, plans.ORACLES[name])
    else:
        INVARIANTS[name](df.toPandas(), spark, small)


def test_flagship():
    assert plans.FLAGSHIP in plans.QUERIES
