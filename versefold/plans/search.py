"""Retrieval, ranking and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.text import grams
from ..operators import lexicon as L
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import text_stats as T
from ..session import Stage, spread, table
from . import lexicons as W
from .aggregates import LONG
from .joins import DOT, NEAREST, _nearest
from .registry import query
from .texts import DIMENSION_SQL, DIMS, catalog_categories, dimension_columns, idf_vectors

QUERY = ["霜风", "孤灯", "寒烟", "孤灯"]

BM25 = f"""{LONG}, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl), q AS (SELECT * FROM (VALUES ('霜风', 1), ('孤灯', 2), ('寒烟', 1)) v(term, times)), df AS (SELECT term, count(*) AS df FROM tf JOIN q USING (term) GROUP BY 1),
bm AS (SELECT doc_id, sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / av))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY doc_id)"""


def _bm25(s, d):
    return V.bm25(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text")), QUERY)


@query(f"WITH {BM25} SELECT doc_id, round(score, 5) AS score FROM bm")
def ret_01_bm25(s, d):
    return _bm25(s, d).select("doc_id", F.round("score", 5).alias("score"))


@query("SELECT ID, CASE WHEN len(t) = 0 THEN '__empty__' ELSE array_to_string(t, ' ') END AS tokens FROM (SELECT ID, list_filter([花名, 朝代, 作者, 作者], lambda x: x IS NOT NULL AND x <> '' AND x <> 'nan') AS t FROM review_tool)")
def ret_02_field_tokens(s, d):
    t = F.filter(F.array("花名", "朝代", "作者", "作者"), lambda x: x.isNotNull() & (x != "") & (x != "nan"))
    return table(s, d, "review_tool").select("ID", F.when(F.size(t) == 0, "__empty__").otherwise(F.array_join(t, " ")).alias("tokens"))


@query(r"SELECT item_id, list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda g: regexp_matches(g, '^[\p{L}\p{N}_]')) AS grams FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$', '', 'g') AS t FROM eval_item)")
def ret_03_query_tokens(s, d):
    """All runs of two characters of each whole text that begin with a letter or digit; none for shorter texts."""
    terms = F.transform(grams(X.trimmed(F.coalesce("text", F.lit(""))), 2, 2), lambda x: x["term"])
    return table(s, d, "eval_item").select("item_id", F.filter(terms, lambda g: g.rlike(r"^[\p{L}\p{N}_]")).alias("grams"))


def _channel(s, d, first: int, target: list[float]):
    e = table(s, d, "embeddings")
    v = F.transform(F.slice("embedding", first, len(target)), lambda x: x.cast("double"))
    return e.select("vec_id", V.cosine(v, F.array(*[F.lit(float(x)) for x in target])).alias("c"))


def _channel_sql(first: int, target: list[float]) -> str:
    return f"SELECT vec_id, list_cosine_similarity(CAST(list_slice(embedding, {first}, {first + len(target) - 1}) AS DOUBLE[]), {[float(x) for x in target]}::DOUBLE[]) AS c FROM embeddings"


def _ranked_sql(sql: str) -> str:
    return f"SELECT vec_id, row_number() OVER (ORDER BY round(c, 9) DESC, vec_id) AS rank FROM ({sql})"


def _ranked(df):
    return V.ranked(df.select("vec_id", F.round("c", 9).alias("c")), [F.desc("c"), F.asc("vec_id")]).select("vec_id", F.col("rank").cast("bigint").alias("rank"))


@query(_ranked_sql(_channel_sql(1, [0.9, 0.1, 0.2, 0.1, 0.4])))
def ret_04_sentiment_channel(s, d):
    return _ranked(_channel(s, d, 1, [0.9, 0.1, 0.2, 0.1, 0.4]))


@query(_ranked_sql(_channel_sql(6, [1, 0, 2, 0, 1, 1, 0, 0, 3])))
def ret_05_dimension_channel(s, d):
    return _ranked(_channel(s, d, 6, [1, 0, 2, 0, 1, 1, 0, 0, 3]))


@query("WITH u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IN (3, 9))), q AS (SELECT list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) / 2) AS q FROM (SELECT max(CASE WHEN vec_id = 3 THEN u END) AS a, max(CASE WHEN vec_id = 9 THEN u END) AS b FROM u)) SELECT vec_id, row_number() OVER (ORDER BY round(c, 9) DESC NULLS LAST, vec_id) AS rank FROM (SELECT vec_id, CASE WHEN label <> 0 THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) END AS c FROM embeddings, q)")
def ret_06_embedding_channel(s, d):
    """The mean of two unit query vectors, of length 1 again; rows without a vector (here: of label 0) come last."""
    e = table(s, d, "embeddings")
    c = e.crossJoin(F.broadcast(unit_query(e, [3, 9]))).select("vec_id", F.round(F.when(F.col("label") != 0, V.cosine(F.col("embedding"), F.col("q"))), 9).alias("c"))
    return V.ranked(c, [F.desc_nulls_last("c"), F.asc("vec_id")]).select("vec_id", F.col("rank").cast("bigint").alias("rank"))


# Weights of the four channels.
BASE = {"imagery": 0.30, "sentiment": 0.30, "dimension": 0.25, "embedding": 0.15}


@query("SELECT name, round(weight, 6) AS weight FROM (VALUES ('embedding', 0.0::DOUBLE), ('imagery', 0.3::DOUBLE / 0.85::DOUBLE), ('sentiment', 0.3::DOUBLE / 0.85::DOUBLE), ('dimension', 0.25::DOUBLE / 0.85::DOUBLE)) v(name, weight)")
def ret_07_channel_weights(s, d):
    w = V.channel_weights(BASE, ["imagery", "sentiment", "dimension"])
    return s.createDataFrame([(k, round(v, 6)) for k, v in w.items()], "name string, weight double")


@query(f"WITH a AS ({_ranked_sql(_channel_sql(1, [0.9, 0.1, 0.2, 0.1, 0.4]))}), b AS ({_ranked_sql(_channel_sql(6, [1, 0, 2, 0, 1, 1, 0, 0, 3]))}) SELECT vec_id, round(sum(s), 7) AS score FROM (SELECT vec_id, 0.6::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT vec_id, 0.4::DOUBLE / (60 + rank) FROM b) GROUP BY vec_id")
def ret_08_rrf(s, d):
    f = V.fuse([(ret_04_sentiment_channel(s, d), 0.6), (ret_05_dimension_channel(s, d), 0.4), (lambda: ret_04_sentiment_channel(s, d), 0.0)], "vec_id")
    return f.select("vec_id", F.round("score", 7).alias("score"))


#: What a user asks for: words for the lexical channel, a mood, a text whose keywords make the nine dimensions, two vectors.
MOOD, WISH = W.MOODS["思念"], "秋窗送别，想看清雅的花"
WISHED = [float(sum(w in WISH for w in W.DIMENSION_WORDS[k])) for k in DIMS]
_CLASSES = {k: "".join(ws) for k, ws in W.EMOTIONS.items()}


def unit_query(vectors, keys):
    """One row q: the mean of the unit query vectors, of length 1 again."""
    one = lambda k: F.max(F.when(F.col("vec_id") == k, F.transform(V.unit(F.col("embedding")), lambda x: x)))
    mean = F.zip_with(one(keys[0]), one(keys[1]), lambda a, b: (a + b) / 2)
    return vectors.where(F.col("vec_id").isin(*keys)).agg(mean.alias("m")).select(V.unit(F.col("m")).alias("q"))


def channels(s, d):
    """doc_id, source and the four channels' scores: lexical, mood, dimensions, embedding (null where there is no vector).

    Each text is read once, for a written row of counts; scores are expressions on these rows and one row of statistics.
    """
    docs = spread(table(s, d, "documents").where("text is not null").select("doc_id", "source", "text"))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), T.tokens(F.col("text")).alias("t"), F.array(*[F.regexp_count("text", F.lit(f"[{c}]")) for c in _CLASSES.values()]).alias("found"), catalog_categories(F.col("text")).alias("c"))
    rows = Stage(s, "hybrid").write(read.select("doc_id", "source", *V.query_counts(F.col("t"), QUERY), "found", *dimension_columns(F.col("c"))), "counts")
    scored = idf_vectors(V.bm25_score(rows, QUERY, "lexical"))
    total = F.aggregate("found", F.lit(0), lambda a, x: a + x) + 1
    shares = F.concat(F.transform("found", lambda x: x / total), F.array(F.lit(1.0) / total))
    wanted = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    own = scored.select("doc_id", "source", F.round("lexical", 9).alias("imagery"), F.round(V.cosine(shares, wanted(MOOD)), 9).alias("sentiment"), F.round(V.cosine(F.array(*DIMS), wanted(WISHED)), 9).alias("dimension"))
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    near = e.crossJoin(F.broadcast(unit_query(e, [3, 9]))).select(F.col("vec_id").alias("doc_id"), F.round(V.cosine(F.col("embedding"), F.col("q")), 9).alias("embedding"))
    return own.join(near, "doc_id", "left")


def _cosine_sql(xs: list[str], ys: list[float]) -> str:
    dot = " + ".join(f"({x}) * {y}::DOUBLE" for x, y in zip(xs, ys))
    norm = " + ".join(f"({x}) * ({x})" for x in xs)
    return f"CASE WHEN sqrt({norm}) * {sum(y * y for y in ys) ** 0.5}::DOUBLE > 1e-12 THEN ({dot}) / (sqrt({norm}) * {sum(y * y for y in ys) ** 0.5}::DOUBLE) ELSE 0 END"


_COUNTS = ", ".join(f"CAST(length(text) - length(regexp_replace(text, '[{c}]', '', 'g')) AS DOUBLE) AS {k}" for k, c in _CLASSES.items())
_TOTAL = "(" + " + ".join(_CLASSES) + " + 1)"
HYBRID = f"""WITH {BM25}, {DIMENSION_SQL}, em AS (SELECT doc_id, source, {_COUNTS} FROM documents WHERE text IS NOT NULL),
mo AS (SELECT doc_id, coalesce(source, '') AS source, round({_cosine_sql([f"{k} / {_TOTAL}" for k in _CLASSES] + [f"1.0::DOUBLE / {_TOTAL}"], MOOD)}, 9) AS sentiment FROM em),
dm AS (SELECT doc_id, round({_cosine_sql(DIMS, WISHED)}, 9) AS dimension FROM dv),
ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), eu AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM ev WHERE vec_id IN (3, 9)),
eq AS (SELECT list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) / 2) AS q FROM (SELECT max(CASE WHEN vec_id = 3 THEN u END) AS a, max(CASE WHEN vec_id = 9 THEN u END) AS b FROM eu)),
ec AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(v, q), 9) AS embedding FROM ev, eq),
al AS (SELECT doc_id, source, sentiment, dimension, embedding, round(coalesce(score, 0), 9) AS imagery FROM mo JOIN dm USING (doc_id) LEFT JOIN ec USING (doc_id) LEFT JOIN bm USING (doc_id)),
rk AS (SELECT doc_id, source, {", ".join(f"row_number() OVER (ORDER BY {c} DESC NULLS LAST, doc_id) AS r_{c}" for c in BASE)} FROM al),
h AS (SELECT doc_id, source, round({" + ".join(f"{w}::DOUBLE / (60 + r_{c})" for c, w in BASE.items())}, 7) AS score FROM rk ORDER BY score DESC, doc_id LIMIT 60),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM h)
SELECT doc_id, source, score, 'rank ' || row_number() OVER (ORDER BY score DESC, doc_id) || ' from ' || source AS explanation FROM (SELECT * FROM c WHERE n <= 2 ORDER BY score DESC, doc_id LIMIT 10)"""


@query(HYBRID)
def ret_hybrid_recommendation(s, d):
    """Four channels (lexical, mood, nine dimensions, embedding) fused by reciprocal ranks with the active ones' weights, at most two of a source, the ten best with an explanation."""
    active = ["imagery", "sentiment", *(["dimension"] if any(WISHED) else []), "embedding"]
    scores = channels(s, d)
    best = V.fused_top(scores.select("doc_id", *active), "doc_id", V.channel_weights(BASE, active), 60)
    f = s.createDataFrame(best, "doc_id bigint, score double")  # sixty rows
    order = [F.desc("score"), F.asc("doc_id")]
    source = table(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    top = R.cap_per_group(source.join(F.broadcast(f), "doc_id"), "source", order, 2, 10)
    rank = F.row_number().over(Window.orderBy(*order))  # ten rows
    return top.select("doc_id", "source", "score", F.format_string("rank %d from %s", rank, F.col("source")).alias("explanation"))


@query(HYBRID)
def ret_09_capped_with_explanation(s, d):
    return ret_hybrid_recommendation(s, d)


@query(
    "SELECT id, round(score, 3) AS score FROM (SELECT id, 2.0::DOUBLE * (CASE WHEN list_contains(c, 'white') THEN 1 ELSE 0 END) + 1.2::DOUBLE * (CASE WHEN list_contains(c, 'red') THEN 1 ELSE 0 END) + 1.0::DOUBLE * (CASE WHEN list_contains(o, '雲嶺') THEN 1 ELSE 0 END) + CASE WHEN contains(name, '鮮花') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(name, '限量') THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN stock_status = 'sold_out' THEN 2 ELSE 0 END AS score FROM (SELECT id, stock_status, coalesce(name, '') AS name, string_split(lower(coalesce(color, '')), ' ') AS c, string_split(coalesce(origin, ''), ' ') AS o FROM product)) WHERE score > 0 ORDER BY score DESC, id LIMIT 50"
)
def ret_10_profile_score(s, d):
    p = table(s, d, "product").select("id", "stock_status", F.coalesce("name", F.lit("")).alias("name"), F.split(F.lower(F.coalesce("color", F.lit(""))), " ").alias("c"), F.split(F.coalesce("origin", F.lit("")), " ").alias("o"))
    score = V.profile_score({"color": F.col("c"), "origin": F.col("o")}, {"color": (["white"], ["red"]), "origin": (["雲嶺"], [])}, {"color": 2.0, "origin": 1.0}, F.col("name"), ["鮮花", "限量"])
    x = p.select("id", F.round(score - F.when(F.col("stock_status") == "sold_out", 2.0).otherwise(0.0), 3).alias("score"))
    return x.where("score > 0").orderBy(F.desc("score"), "id").limit(50)


@query("SELECT ID, concat_ws('｜', nullif(花名, ''), nullif(诗名, ''), coalesce(nullif(赏析, ''), nullif(正文, ''), 诗名)) AS text FROM review_tool")
def ret_11_text_builder(s, d):
    z = lambda c: F.nullif(F.col(c), F.lit(""))
    return table(s, d, "review_tool").select("ID", F.concat_ws("｜", z("花名"), z("诗名"), F.coalesce(z("赏析"), z("正文"), "诗名")).alias("text"))


@query(f"WITH t AS ({NEAREST}) SELECT q AS a, vec_id AS b, similarity FROM t WHERE rank = 1 AND q < vec_id ORDER BY similarity DESC, a LIMIT 20")
def ret_12_most_similar_pairs(s, d):
    t = _nearest(s, d).where("rank = 1").select(F.col("q").alias("a"), F.col("vec_id").alias("b"), F.round("similarity", 5).alias("similarity"))
    return t.where("a < b").orderBy(F.desc("similarity"), "a").limit(20)


@query(f"WITH s AS MATERIALIZED (SELECT a.vec_id AS q, b.vec_id AS v, round({DOT}, 12) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), t AS MATERIALIZED (SELECT q, min(v) AS v FROM s JOIN (SELECT q, max(c) AS c FROM s GROUP BY q) USING (q, c) GROUP BY q) SELECT x.q AS a, x.v AS b FROM t x JOIN t y ON x.q = y.v AND x.v = y.q WHERE x.q < x.v")
def ret_12_mutual_best(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    t = V.nearest(e, e, "vec_id", "embedding", 1).select(F.col("q").alias("a"), F.col("vec_id").alias("b"))
    back = t.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return t.intersect(back).where("a < b")


@query("SELECT item_id, CASE WHEN contains(text, '送') OR contains(text, '归') THEN 'farewell' WHEN contains(text, '月') THEN 'night' ELSE 'any' END AS intent, CASE CASE WHEN contains(text, '送') OR contains(text, '归') THEN 'farewell' WHEN contains(text, '月') THEN 'night' ELSE 'any' END WHEN 'farewell' THEN '愁' WHEN 'night' THEN '静' ELSE '平' END AS mood FROM eval_item")
def ret_13_intent_fallback(s, d):
    i = L.keyword_rules(F.col("text"), [("farewell", ["送", "归"]), ("night", ["月"])], "any")
    return table(s, d, "eval_item").select("item_id", i.alias("intent")).select("item_id", "intent", F.when(F.col("intent") == "farewell", "愁").when(F.col("intent") == "night", "静").otherwise("平").alias("mood"))
