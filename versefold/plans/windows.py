"""Window-like operators, sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import grams
from ..operators import relational as R
from ..operators import retrieval as V
from ..operators import text_stats as T
from ..session import spread, table
from .registry import query


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL) WHERE rank <= 3")
def win_01_top_k_per_group(s, d):
    t = table(s, d, "documents").where("source is not null and n_chars is not null").select("source", "doc_id", "n_chars")
    return R.top_k(t, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("WITH h AS (SELECT doc_id, source, n_chars FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 120) SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM h) WHERE r <= 2 ORDER BY n_chars DESC, doc_id LIMIT 20")
def win_02_group_cap(s, d):
    t = table(s, d, "documents").where("n_chars is not null and source is not null").select("doc_id", "source", "n_chars")
    return R.cap_per_group(t, "source", [F.desc("n_chars"), F.asc("doc_id")], 2, 20)


@query("SELECT event_id, CASE WHEN n > 1 THEN CAST(user_id AS VARCHAR) || '-' || CASE WHEN r < 10 THEN '0' ELSE '' END || r ELSE CAST(user_id AS VARCHAR) END AS key FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'error')")
def win_03_suffix_duplicates(s, d):
    t = table(s, d, "events").where("event_type = 'error'").select("event_id", "user_id")
    return R.suffix_duplicates(t, "user_id", [F.asc("event_id")], "key").select("event_id", "key")


@query("SELECT row_number() OVER (ORDER BY fetched_at, id) AS seq, id FROM product")
def win_04_sequential_id(s, d):
    return V.ranked(table(s, d, "product").select("fetched_at", "id"), [F.asc_nulls_last("fetched_at"), F.asc("id")], "seq").select(F.col("seq").cast("bigint").alias("seq"), "id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events")
def win_05_carry_forward(s, d):
    t = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.carried(t, F.when(F.col("event_type") == "error", F.col("event_id")), ["user_id"], [F.asc("ts"), F.asc("event_id")], "heading").select("event_id", "heading")


@query("SELECT event_id, first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS anchor FROM events")
def win_06_next_anchor(s, d):
    t = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return R.followed(t, F.when(F.col("event_type") == "error", F.col("event_id")), ["user_id"], [F.asc("ts"), F.asc("event_id")], "anchor").select("event_id", "anchor")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents")
def win_07_rank_position(s, d):
    return V.ranked(table(s, d, "documents").select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")], "rank").select("doc_id", F.col("rank").cast("bigint").alias("rank"))


@query("WITH c AS (SELECT 花名, count(*) AS n FROM review_tool WHERE 花名 IS NOT NULL GROUP BY 1 ORDER BY n DESC, 花名 LIMIT 30), l AS (SELECT n, row_number() OVER (ORDER BY n DESC, 花名) AS i, lag(n) OVER (ORDER BY n DESC, 花名) - n AS fall FROM c) SELECT i AS elbow, fall FROM l WHERE fall IS NOT NULL ORDER BY fall DESC, i LIMIT 1")
def win_08_elbow(s, d):
    top = table(s, d, "review_tool").where(F.col("花名").isNotNull()).groupBy("花名").agg(n()).orderBy(F.desc("n"), "花名").limit(30)
    w = Window.orderBy(F.desc("n"), "花名")  # at most 30 rows
    l = top.select(F.row_number().over(w).cast("bigint").alias("i"), (F.lag("n").over(w) - F.col("n")).alias("fall"))
    return l.where("fall is not null").agg(F.min(F.struct((-F.col("fall")).alias("m"), "i")).alias("x")).select(F.col("x.i").alias("elbow"), (-F.col("x.m")).alias("fall"))


TOK = r"regexp_extract_all(lower(text), '([a-z]{2,}|[一-鿿]{2})', 1)"


@query(f"WITH t AS (SELECT doc_id, unnest({TOK}) AS t, generate_subscripts({TOK}, 1) AS i FROM documents WHERE text IS NOT NULL) SELECT a.doc_id, a.t AS a, b.t AS b, count(*) AS w FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 4 AND a.t <> b.t GROUP BY 1, 2, 3")
def win_09_cooccurrence(s, d):
    return T.cooccurrence(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text")), 4)


@query("SELECT item_id, list_transform(range(1, length(text)), lambda i: substr(text, i, 2)) AS grams FROM eval_item")
def win_10_character_bigrams(s, d):
    return table(s, d, "eval_item").select("item_id", F.transform(grams(F.col("text"), 2, 2), lambda x: x["term"]).alias("grams"))


_N = "('不', '无', '莫', '未', '休')"


@query(f"SELECT doc_id, CAST(len(list_filter(range(1, len(s) + 1), lambda i: s[i] NOT IN {_N} AND (coalesce(s[i - 1] IN {_N} AND i > 1, false) OR coalesce(s[i - 2] IN {_N} AND i > 2, false) OR coalesce(s[i - 3] IN {_N} AND i > 3, false)))) AS INTEGER) AS negated FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(text, '') END AS s FROM documents WHERE text IS NOT NULL)")
def win_11_countdown(s, d):
    """Negated tokens: how many tokens of a document stand within three places after a negating token."""
    toks = F.split(F.col("text"), "")
    fold = F.aggregate(toks, F.struct(F.lit(0).alias("left"), F.lit(0).alias("n")), lambda a, t: F.struct(F.when(t.isin("不", "无", "莫", "未", "休"), 3).otherwise(F.greatest(a["left"] - 1, F.lit(0))).alias("left"), (a["n"] + F.when((a["left"] > 0) & ~t.isin("不", "无", "莫", "未", "休"), 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return table(s, d, "documents").where("text is not null").select("doc_id", fold.alias("negated"))


# --- sorts, limits, top-k


def _in_order(df, order):
    """All rows in order with their place, by range partitions."""
    return V.ranked(df, order).withColumn("rank", F.col("rank").cast("bigint")).orderBy("rank")


MONTHS = ("正月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月")


@query(f"SELECT 月份, n, row_number() OVER (ORDER BY coalesce(list_position({list(MONTHS)}, 月份), 13), 月份 NULLS LAST) AS rank FROM (SELECT 月份, count(*) AS n FROM review_tool GROUP BY 1)")
def sort_01_domain_order(s, d):
    """All values: the twelve months in their order, any others after them, null last."""
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in zip(MONTHS, range(1, 13)) for x in kv]), F.col("月份")), F.lit(13))
    return _in_order(table(s, d, "review_tool").groupBy("月份").agg(n("rows")), [place, F.asc_nulls_last("月份")]).select("月份", F.col("rows").alias("n"), "rank")


@query("SELECT ID, row_number() OVER (ORDER BY TRY_CAST(ID AS INTEGER) IS NULL, TRY_CAST(ID AS INTEGER), ID) AS rank FROM review_tool")
def sort_02_numeric_first(s, d):
    num = F.expr("try_cast(ID as int)")
    return _in_order(table(s, d, "review_tool").select("ID"), [num.isNull(), num, F.asc_nulls_last("ID")]).select("ID", "rank")


@query("SELECT id, price, name, row_number() OVER (ORDER BY supplier_id ASC NULLS LAST, price DESC NULLS LAST, id ASC) AS rank FROM product")
def sort_03_mixed_direction(s, d):
    t = table(s, d, "product").select("supplier_id", "id", "price", "name")
    return _in_order(t, [F.asc_nulls_last("supplier_id"), F.desc_nulls_last("price"), F.asc_nulls_last("id")]).select("id", "price", "name", "rank")


@query("SELECT ID, 审核状态, row_number() OVER (ORDER BY CASE 审核状态 WHEN '⚑' THEN 0 WHEN '✓' THEN 1 ELSE 2 END, ID) AS rank FROM review_tool")
def sort_04_verdict_rank(s, d):
    v = F.when(F.col("审核状态") == "⚑", 0).when(F.col("审核状态") == "✓", 1).otherwise(2)
    return _in_order(table(s, d, "review_tool").select("ID", "审核状态"), [v, F.asc_nulls_last("ID")]).select("ID", "审核状态", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def sort_05_global_top_k(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(25)


def limited(df, k: int):
    """At most k rows; 0 means all."""
    return df.limit(k) if k else df


@query("SELECT count(*) AS all_rows, least(count(*), 10) AS ten FROM product")
def sort_06_optional_limit(s, d):
    t = table(s, d, "product").select("id")
    return limited(t, 0).agg(n("all_rows")).crossJoin(limited(t, 10).agg(n("ten")))


@query("SELECT ID FROM review_tool ORDER BY md5(ID || '42'), ID LIMIT 100")
def sort_07_seeded_sample(s, d):
    """100 rows by the order of a seeded hash: the same rows on every run and at every parallelism."""
    return table(s, d, "review_tool").select("ID").orderBy(F.md5(F.concat("ID", F.lit("42"))), "ID").limit(100)
