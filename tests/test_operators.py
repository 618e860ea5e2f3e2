"""Operators on literal fixtures."""

import sqlite3

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versefold.functions import fields as X
from versefold.functions.chinese import number, to_simplified_table, to_traditional_table
from versefold.functions.text import alnum_key, is_blank
from versefold.operators import columns as C
from versefold.operators import lexicon as L
from versefold.operators import relational as R
from versefold.operators import retrieval as V
from versefold.operators import text_stats as T
from versefold.sources import readers as S
from versefold.sources import stores, writers


def values(df, col):
    return [r[col] for r in df.collect()]


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in cols.items())).select(expr.alias("x")).first()[0] if names else None


@pytest.mark.parametrize("text,term,n", [("aaaa", "aa", 3), ("不aaaa", "aa", 2), ("", "a", 0), ("云.云", ".", 1)])
def test_overlap_count(spark, text, term, n):
    assert one(spark, L.overlap_count(F.col("t"), term), t=text) == n


def test_sentences(spark):
    assert one(spark, X.sentences(F.col("t")), t="一二三四。五六七八！\n九十") == ["一二三四。", "五六七八！"]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (4, 1, 3, 2)] + [("b", 7)], "g string, v int")
    assert {r.g: r.upper_median for r in R.upper_median_by(df, ["g"], "v").collect()} == {"a": 3, "b": 7}


def test_dominant_tie(spark):
    df = spark.createDataFrame([("g", x) for x in "abab"] + [("g", None)], "g string, v string")
    assert R.dominant(df, ["g"], "v").first().v == "a"


def test_bins(spark):
    b = C.half_open_bins(F.col("v"), [0, 50, 5000])
    assert [one(spark, b, v=float(x)) for x in (49, 50, 5000)] == ["0-50", "50-5000", "5000+"]


def test_suffix_duplicates(spark):
    df = spark.createDataFrame([("7", 1), ("8", 2), ("7", 3)], "id string, i int")
    assert sorted(values(R.suffix_duplicates(df, "id", [F.asc("i")], "new"), "new")) == ["7-01", "7-02", "8"]


def test_month_window(spark):
    df = spark.range(0, 14).select(F.col("id").cast("int").alias("m"))
    assert sorted(values(df.where(C.month_near(F.col("m"), 1, 1)), "m")) == [1, 2, 12]


def test_rrf_tie_and_zero_weight(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, rank int")
    b = spark.createDataFrame([("b", 1), ("a", 2)], "k string, rank int")
    plain = {r.k: r.score for r in V.fuse([(a, 0.5), (b, 0.5)], "k").collect()}
    assert plain["a"] == pytest.approx(0.5 / 61 + 0.5 / 62) and plain["a"] == pytest.approx(plain["b"])
    assert plain == {r.k: r.score for r in V.fuse([(a, 0.5), (b, 0.5), (a, 0.0)], "k").collect()}


def test_group_cap(spark):
    df = spark.createDataFrame([("x", 4), ("x", 3), ("x", 2), ("y", 1)], "f string, s int")
    got = R.cap_per_group(df, "f", [F.desc("s")], 2, 3).collect()
    assert [(r.f, r.s) for r in got] == [("x", 4), ("x", 3), ("y", 1)]


def test_one_to_one_join_refuses_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(Exception, match="duplicate key"):
        R.one_to_one_outer(a, spark.createDataFrame([(1,)], "id int"), ["id"]).collect()


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert df.select(V.unit(F.col("v")).alias("v")).first().v == [0.0, 0.0]
    assert df.select(V.cosine(F.col("v"), F.col("v")).alias("c")).first().c == 0.0


def test_tfidf_idf_of_common_term(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc")], "id int, t string")
    counts = T.term_counts(df, "id", T.tokens(F.col("t")))
    got = T.tfidf(counts, "id", df.agg(F.count(F.lit(1)).alias("n")), 2, 1.0)
    assert {(r.id, r.term): round(r.score, 6) for r in got.collect()} == {(1, "aa"): 1.0, (2, "aa"): 1.0}


def test_textrank(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb cc bb")], "id int, t string")
    got = {(r.id, r.term): r.score for r in T.textrank(df, "id", T.tokens(F.col("t"))).collect()}
    assert got[1, "aa"] == got[1, "bb"] == 1.0
    assert got[2, "bb"] > got[2, "aa"] and sum(v for (i, _), v in got.items() if i == 2) == pytest.approx(3.0)


def texts_of(spark, rows):
    texts = {}
    for i, t, n in rows:
        texts.setdefault(i, []).extend([t] * n)
    return spark.createDataFrame([*texts.items(), (99, [])], "id int, t array<string>")


def test_places_and_fusion_equal_sorting(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 6)), None if i % 5 == 0 else float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double")
    order = {c: {r[0]: p for p, r in enumerate(sorted(rows, key=lambda r: (r[c] is None, -(r[c] or 0.0), r[0])), 1)} for c in (1, 2)}
    keys = np.array([3, 10, 77, 390])
    values = np.array([[-np.inf if rows[k][c] is None else rows[k][c] for k in keys] for c in (1, 2)])
    assert V.places(df, "k", ["a", "b"], keys, values).tolist() == [[order[c][k] for k in keys.tolist()] for c in (1, 2)]
    want = sorted(((-round(0.7 / (60 + order[1][r[0]]) + 0.3 / (60 + order[2][r[0]]), 7), r[0]) for r in rows))[:25]
    for how in ({}, {"first": 4}, {"first": 64, "most": 1}):  # at once, by growing heads, by ranking all
        got = V.fused_top(df, "k", {"a": 0.7, "b": 0.3, "c": 0.0}, 25, **how)
        assert [(k, s) for k, s in got] == [(k, pytest.approx(-s)) for s, k in want]
    assert V.fused_top(df.limit(0), "k", {"a": 1.0}, 5) == []


def test_bm25_by_hand(spark):
    rows = [(1, "aa", 2), (1, "bb", 1), (2, "bb", 3)]
    got = {r.id: r.score for r in V.bm25(texts_of(spark, rows), "id", F.col("t"), ["aa", "aa"]).collect()}
    idf = np.log((2 - 1 + 0.5) / 1.5 + 1)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3)))}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k bigint, v array<double>")
    got = {(r.q, r["rank"]): r.k for r in V.nearest(df.where("k < 7"), df, "k", "v", 4, block=16).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(7):
        s = u[q] @ u.T
        s[q] = -9
        assert [got[q, i + 1] for i in range(4)] == np.argsort(-s)[:4].tolist()


def test_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 5 = 0")
    cells = V.fit_cells(e, "vec_id", "embedding", 32)
    want = {(r.q, r.vec_id) for r in V.nearest(q, e, "vec_id", "embedding", 10).collect()}
    share = lambda probes, block: len(want & {(r.q, r.vec_id) for r in V.nearest_by_index(q, e, "vec_id", "embedding", 10, cells, probes, block).collect()}) / len(want)
    assert share(32, 16) == 1.0
    recall = share(18, 4096)
    assert recall >= 0.9


def test_ranked_has_no_gaps(spark):
    df = spark.range(0, 1000).select(F.xxhash64("id").alias("v"), "id")
    got = V.ranked(df, [F.asc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [r.v for r in got] == sorted(r.v for r in got)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("云月溪山寒", max_size=12), min_size=1, max_size=5))
def test_greedy_spans_never_overlap(spark, texts):
    terms = ["云月", "云月溪", "山", "寒山", "溪"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    used = {}
    for r in L.greedy(df, "id", "t", terms, 3, 2).collect():
        assert texts[r.id][r.pos - 1 : r.pos - 1 + len(r.term)] == r.term
        span = set(range(r.pos, r.pos + len(r.term)))
        assert not span & used.setdefault(r.id, set())
        used[r.id] |= span


def test_overlay_merge_is_idempotent(spark):
    base = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "id string, x string, y string")
    edits = spark.createDataFrame([("1", "R1", "A", "b"), ("1", "R2", "B", "b"), ("2", "R2", "c", "D"), ("9", "R1", "z", "z")], "id string, who string, x string, y string")
    merged, conflicts = R.overlay_merge(base, edits, "id", ["x", "y"], "who")
    rows = sorted(map(tuple, merged.collect()))
    assert rows == [("1", "A", "b"), ("2", "c", "D")]
    assert [tuple(r) for r in conflicts.collect()] == [("1", "x", 2, "A|B")]
    again, _ = R.overlay_merge(merged, spark.createDataFrame([], edits.schema), "id", ["x", "y"], "who")
    assert sorted(map(tuple, again.collect())) == rows


def test_contains_join_equals_theta_join(spark):
    t = spark.createDataFrame([(1, "霜铃花下", None), (2, "x", "月络兰"), (3, None, None)], "id int, a string, b string")
    terms = spark.createDataFrame([("霜铃花",), ("月络兰",), ("兰",), ("",), (None,)], "term string")
    got = {tuple(r) for r in R.contains_join(t, "id", ["a", "b"], terms, "term").collect()}
    assert got == {(1, "霜铃花"), (2, "月络兰"), (2, "兰")}
    assert R.contains_join(t, "id", ["a"], terms.limit(0), "term").count() == 0


def test_terms_of_any_length_are_found(spark, monkeypatch):
    text = "红云，大红袍子与皇家贵族南方公主"
    terms = ["红云", "大红袍", "皇家贵族南方公", "皇家贵族南方公主", "五字的名称"]
    t = spark.createDataFrame([(1, text), (2, "袍"), (3, None)], "id int, a string")
    lex = spark.createDataFrame([(x,) for x in [*terms, ""]], "term string")
    want = {(1, x) for x in terms if x in text}
    for most in (100_000, 2):  # with and without a broadcast
        monkeypatch.setattr(R.small, "__defaults__", (most,))
        assert {tuple(r) for r in R.contains_join(t, "id", ["a"], lex, "term").collect()} == want
        assert {(r.id, r.term) for r in L.all_matches(t, "id", "a", lex).collect()} == want
    assert L.all_matches(t, "id", "a", lex.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.lengths_of(lex, "term", 2)


def test_greedy_names_what_stands_before(spark):
    df = spark.createDataFrame([(1, "不见溪云云"), (2, None)], "id int, t string")
    got = [(r.pos, r.term, r.before) for r in L.greedy(df, "id", "t", ["溪云", "云", "溪"], 5, 2).collect()]
    assert got == [(3, "溪云", "不见"), (5, "云", "溪云")]
    assert L.greedy(df, "id", "t", [], 5, 2).count() == 0


def test_negated_scores(spark):
    df = spark.createDataFrame([(["不", "x", "暖", "y", "暖"],)], "t array<string>")
    got = df.select(L.negated_scores(F.col("t"), {"joy": {"暖": 1.0}}, ["不"], 2).alias("v")).first().v
    assert got.joy == 0.0  # one within reach, one beyond


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿ID,正文\r\n1,"春风\n又""绿"""\n'.encode())
    df = S.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["ID", "正文"] and [tuple(r) for r in df.collect()] == [("1", '春风\n又"绿"')]


def test_csv_of_any_encoding(spark, tmp_path):
    for name, enc in (("a", "utf-8-sig"), ("b", "gbk"), ("c", "gb18030")):
        (tmp_path / f"{name}.csv").write_bytes("ID,诗名\n1,月下\n".encode(enc))
    (tmp_path / "d.csv").write_bytes(b"ID,\xff\xff\n2,x\n")
    got = S.read_csv_any_encoding(spark, str(tmp_path / "*.csv"), ["ID", "诗名"])
    assert sorted((r.ID, r["诗名"]) for r in got.collect()) == [("1", "月下")] * 3 + [("2", None)]


def test_class_tree(spark, tmp_path):
    (tmp_path / "x.owl").write_text(
        '<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o"><owl:Class rdf:ID="C4_云"><rdfs:subClassOf rdf:resource="#C3_天"/></owl:Class><owl:Class rdf:ID="C3_天"><rdfs:subClassOf rdf:resource="#C2_x"/></owl:Class></rdf:RDF>'
    )
    assert [tuple(r) for r in S.read_class_tree(spark, str(tmp_path / "x.owl")).collect()] == [("云", "天")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "l": {"h": "5"}}\n\n{"a": 2}\n{bad\n')
    df = S.read_json_lines(spark, str(tmp_path / "x.json"), "a int, l struct<h:string>", strict=False)
    assert sorted(tuple(r) for r in S.labelled(df, "l.h", "y", "3").select("a", "y").collect()) == [(1, "5"), (2, "3")]
    with pytest.raises(Exception):
        S.read_json_lines(spark, str(tmp_path / "x.json"), "a int").collect()


def test_stores(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table product (id INTEGER primary key, name TEXT, price REAL)")
    db.executemany("insert into product values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(50)])
    db.commit()
    df = stores.read_sqlite(spark, str(tmp_path / "x.db"), "product")
    assert df.count() == 50 and dict(df.dtypes)["price"] == "double" and df.rdd.getNumPartitions() > 1
    m = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "m.npy", m)
    got = stores.read_matrix(spark, str(tmp_path / "m.npy"), [f"k{i}" for i in range(6)])
    assert {r.key: r.vector for r in got.collect()} == {f"k{i}": m[i].tolist() for i in range(6)}
    with pytest.raises(ValueError):
        stores.read_matrix(spark, str(tmp_path / "m.npy"), ["a"])


def test_config_literal_and_checkpoints(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_x": 1, "a": [1]}')
    (tmp_path / "l.py").write_text("{'a': ['b']}")
    assert S.read_config(spark, str(tmp_path / "c.json")) == {"a": [1]}
    assert S.read_literal(str(tmp_path / "l.py")) == {"a": ["b"]}
    assert S.newest_checkpoint(["checkpoint-9", "checkpoint-10", "x"]) == "checkpoint-10"
    assert S.newest_checkpoint(["config.json", "checkpoint-9"]) == "" and S.newest_checkpoint([]) is None


def test_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.range(3)
    assert [writers.write_version(df, base)[-5:] for _ in range(2)] == ["v0001", "v0002"]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "id int, n string, p double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 6.0)], "id int, n string, p double")
    assert sorted(tuple(r) for r in R.upsert(old, new, ["id"]).collect()) == [(1, "a", 1.0), (2, "b", 5.0), (3, "c", 6.0)]
    assert sorted(r.id for r in R.insert_missing(old, new, ["id"]).collect()) == [1, 2, 3]


def test_keys_and_blanks(spark):
    rows = [(None,), ("",), (" 　\n",), ("Ａ b-C 月。é",)]
    df = spark.createDataFrame(rows, "t string").select(alnum_key("t").alias("k"), is_blank("t").alias("b"))
    assert [tuple(r) for r in df.collect()] == [(None, True), ("", True), ("", True), ("ａbc月é", False)]


def test_numbers_and_scripts(spark):
    assert [number(x) for x in ("十", "廿四", "十六", "二十", "兩", "5", "正", "x", "")] == [10, 24, 16, 20, 2, 5, 1, None, None]
    there, back = to_simplified_table(spark), to_traditional_table(spark)
    assert "愛鄉飛劉後來麵髮乾隆岁".translate(there) == "爱乡飞刘后来面发干隆岁" and len(there) > 2000
    assert "爱乡飞刘".translate(back) == "愛鄉飛劉"
    df = spark.createDataFrame([("鈴木 Bell",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(X.to_simplified(F.col("t")).alias("x")).collect()] == ["铃木 Bell", None, ""]


def test_profile_and_weights(spark):
    w = V.channel_weights({"a": 0.3, "b": 0.3, "c": 0.4}, ["a", "b"])
    assert w == {"a": 0.5, "b": 0.5, "c": 0.0} and V.channel_weights({"a": 1.0}, []) == {"a": 0.0}
    df = spark.createDataFrame([(["x", "y"],)], "d array<string>")
    assert df.select(V.profile_score({"d": F.col("d")}, {"d": (["x"], ["y", "z"])}, {"d": 2.0}).alias("s")).first().s == pytest.approx(3.2)


def test_numbered_groups_and_folds(spark):
    from versefold.operators import models as M

    df = spark.range(0, 5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    rows = R.numbered(df, "g", "id", 1, "place", "total").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.g, r.total), []).append(r.place)
    assert len(rows) == 5000 and all(sorted(p) == list(range(n)) for (_, n), p in groups.items())
    sizes = M.folds(df, "id", "g", 5).groupBy("g", "fold").count().groupBy("g").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)
    split = M.stratified_split(df, "id", "g", 0.2, 3).groupBy("g").agg(F.avg((F.col("split") == "test").cast("int")).alias("s")).collect()
    assert all(abs(r.s - 0.2) < 0.01 for r in split)


def test_windows_over_hot_groups_equal_one_window(spark):
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.randint(0, 50), "x" if rng.random() < 0.05 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, g int, o int, v string").withColumn("v", F.when(F.col("v").isNotNull(), F.col("id")))
    order = [F.asc("o"), F.asc("id")]
    got = {r.id: (r.a, r.b) for r in R.followed(R.carried(df, F.col("v"), ["g"], order, "a"), F.col("v"), ["g"], order, "b").collect()}
    suffixed = {r.id: r.k for r in R.suffix_duplicates(df.select("id", "g", "o"), "g", order, "k").collect()}
    for g in (1, 2, None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(mine):
            before = [x[0] for x in mine[: i + 1] if x[3]]
            behind = [x[0] for x in mine[i + 1 :] if x[3]]
            assert got[r[0]] == (before[-1] if before else None, behind[0] if behind else None)
            assert suffixed[r[0]] == (None if g is None else f"{g}-{i + 1:02d}")
    with pytest.raises(Exception, match="duplicate key"):
        R.assert_unique(df, ["g"], "left").collect()
    assert R.assert_unique(df, ["id"], "left").count() == 800


def test_script_vocabulary_is_not_run(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\nWORDS: dict = {'sky': ['云', '月']}\nLIST = ['x']\nos.abort()\n")
    assert {tuple(r) for r in S.script_vocabulary(spark, str(tmp_path / "a.py"), "WORDS").collect()} == {("sky", "云"), ("sky", "月")}
    assert [tuple(r) for r in S.script_vocabulary(spark, str(tmp_path / "a.py"), "LIST").collect()] == [(None, "x")]
    with pytest.raises(ValueError):
        S.script_vocabulary(spark, str(tmp_path / "a.py"), "NONE")


def test_csv_begins_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a"b\nc')], "ID string, t string")
    writers.write_csv(df, str(tmp_path / "x"), single=True)
    data = next((tmp_path / "x").glob("*.csv")).read_bytes()
    assert data.startswith("\ufeffID,t\n".encode())
    back = S.read_csv(spark, str(tmp_path / "x"))
    assert back.columns == ["ID", "t"] and [tuple(r) for r in back.collect()] == [("1", 'a"b\nc')]


def test_workbooks(spark, tmp_path, monkeypatch):
    import pandas as pd

    frame = pd.DataFrame({"a": ["1", None], "花名": ["霜铃花", "x"]})
    monkeypatch.setattr(pd, "read_excel", lambda path, sheet_name, dtype: frame)
    assert [tuple(r) for r in S.read_excel(spark, "x.xlsx").collect()] == [("1", "霜铃花"), (None, "x")]
    monkeypatch.setattr(pd, "read_excel", lambda *a, **k: (_ for _ in ()).throw(ImportError("openpyxl")))
    with pytest.raises(ImportError, match="workbooks"):
        S.read_excel(spark, "x.xlsx")
