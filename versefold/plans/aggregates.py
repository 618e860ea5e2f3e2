"""Grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import text_stats as T
from ..session import spread, table
from .registry import query


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


@query("SELECT 朝代, count(*) AS n FROM review_tool GROUP BY 朝代")
def agg_01_count_by_key(s, d):
    return table(s, d, "review_tool").groupBy("朝代").agg(n())


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT genre) AS genres FROM documents GROUP BY lang")
def agg_02_count_distinct(s, d):
    return table(s, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("genre").alias("genres"))


@query("""SELECT col, count(*) FILTER (v IS NULL) AS nulls, count(*) FILTER (v = '' OR v = 'nan') AS blanks, round(100.0 * count(*) FILTER (v IS NOT NULL AND v NOT IN ('', 'nan')) / count(*), 2) AS pct
FROM (SELECT '花名' AS col, 花名 AS v FROM review_tool UNION ALL SELECT '朝代', 朝代 FROM review_tool UNION ALL SELECT '作者', 作者 FROM review_tool UNION ALL SELECT '正文', 正文 FROM review_tool) GROUP BY col""")
def agg_03_completeness(s, d):
    t = table(s, d, "review_tool").select("花名", "朝代", "作者", "正文").unpivot([], ["花名", "朝代", "作者", "正文"], "col", "v")
    blank = F.col("v").isin("", "nan")
    return t.groupBy("col").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(blank).alias("blanks"), F.round(100 * F.count_if(F.col("v").isNotNull() & ~blank) / F.count(F.lit(1)), 2).alias("pct"))


@query("SELECT coalesce(月份, '(null)') AS month, count(*) AS n, count(*) FILTER (审核状态 = '✓') AS done, count(*) FILTER (审核状态 = '⚑') AS flagged, count(*) FILTER (coalesce(审核状态, '') = '') AS todo FROM review_tool GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(*) FILTER (审核状态 = '✓'), count(*) FILTER (审核状态 = '⚑'), count(*) FILTER (coalesce(审核状态, '') = '') FROM review_tool")
def agg_04_status_counters(s, d):
    st = F.col("审核状态")
    t = table(s, d, "review_tool").select(F.coalesce("月份", F.lit("(null)")).alias("month"), "审核状态")
    g = t.rollup("month").agg(n(), F.count_if(st == "✓").alias("done"), F.count_if(st == "⚑").alias("flagged"), F.count_if(F.coalesce(st, F.lit("")) == "").alias("todo"))
    return g.withColumn("month", F.coalesce("month", F.lit("(all)")))


@query("SELECT source, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 3) AS mean, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL GROUP BY source")
def agg_05_upper_median(s, d):
    t = table(s, d, "documents").where("n_chars is not null and source is not null").select("source", "n_chars")
    basic = t.groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 3).alias("mean"))
    return basic.join(R.upper_median_by(t, ["source"], "n_chars"), "source")


@query("SELECT event_type, round(stddev_samp(value), 4) AS sd, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def agg_06_sample_std(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT label, " + ", ".join(f"round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS m{i}" for i in range(8)) + " FROM embeddings GROUP BY label")
def agg_07_group_means(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(*[F.round(F.avg(F.col("embedding")[i].cast("double")), 6).alias(f"m{i}") for i in range(8)])


@query("SELECT supplier_id, string_agg(DISTINCT category_type, '|' ORDER BY category_type) AS kinds FROM category WHERE category_type IS NOT NULL GROUP BY supplier_id")
def agg_08_sorted_text(s, d):
    return table(s, d, "category").where("category_type is not null").groupBy("supplier_id").agg(R.sorted_text("category_type").alias("kinds"))


@query("SELECT supplier_id, string_agg(name, ' ' ORDER BY id) AS names FROM category GROUP BY supplier_id")
def agg_09_ordered_concat(s, d):
    t = table(s, d, "category").groupBy("supplier_id").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("x"))
    return t.select("supplier_id", F.array_join(F.transform("x", lambda x: x["name"]), " ").alias("names"))


@query("SELECT source, min_by(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM (SELECT * FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY source")
def agg_10_representative(s, d):
    t = table(s, d, "documents").where("source is not null and lang is not null")
    return t.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT 花名, round(avg(CASE WHEN 审核状态 = '✓' THEN 1.0 ELSE 0.0 END), 4) AS share FROM review_tool WHERE 花名 IS NOT NULL GROUP BY 花名")
def agg_11_ratio(s, d):
    return table(s, d, "review_tool").where(F.col("花名").isNotNull()).groupBy("花名").agg(F.round(F.avg(F.coalesce((F.col("审核状态") == "✓").cast("double"), F.lit(0.0))), 4).alias("share"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def agg_12_mode(s, d):
    return R.dominant(table(s, d, "events"), ["user_id"], "event_type")


@query("SELECT 花名, 朝代, n FROM (SELECT 花名, 朝代, count(*) AS n, row_number() OVER (PARTITION BY 花名 ORDER BY count(*) DESC, 朝代) AS r FROM review_tool WHERE 花名 IS NOT NULL AND 朝代 IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def agg_13_dominant_label(s, d):
    return R.dominant(table(s, d, "review_tool").where(F.col("花名").isNotNull()), ["花名"], "朝代")


_NAMED = "SELECT 花名 AS flower, 朝代 AS dynasty FROM review_tool WHERE 花名 <> '' AND 朝代 <> ''"
_TOP = f"WITH t AS ({_NAMED}), r AS (SELECT flower FROM t GROUP BY 1 ORDER BY count(*) DESC, flower LIMIT 10), k AS (SELECT dynasty, row_number() OVER (ORDER BY count(*) DESC, dynasty) AS i FROM t GROUP BY 1 ORDER BY i LIMIT 5)"
_CELLS = ", ".join(f"count(*) FILTER (i = {i}) AS c{i}" for i in range(1, 6))


@query(f"{_TOP} SELECT flower, {_CELLS} FROM t JOIN r USING (flower) LEFT JOIN k USING (dynasty) GROUP BY flower")
def agg_14_contingency(s, d):
    """The ten most frequent flowers by the five most frequent dynasties (c1 the first of them), 0 where there is none."""
    t = table(s, d, "review_tool").where("`花名` <> '' and `朝代` <> ''").select(F.col("花名").alias("flower"), F.col("朝代").alias("dynasty"))
    rows = t.groupBy("flower").agg(n()).orderBy(F.desc("n"), "flower").limit(10).select("flower")
    top = t.groupBy("dynasty").agg(n()).orderBy(F.desc("n"), "dynasty").limit(5)
    columns = top.select("dynasty", F.concat(F.lit("c"), F.row_number().over(Window.orderBy(F.desc("n"), "dynasty"))).alias("c"))  # five rows
    j = t.join(F.broadcast(rows), "flower").join(F.broadcast(columns), "dynasty", "left")
    return R.contingency(j, "flower", "c", [f"c{i}" for i in range(1, 6)])


@query(f"{_TOP} SELECT flower, {_CELLS}, count(i) AS total FROM t JOIN r USING (flower) LEFT JOIN k USING (dynasty) GROUP BY flower")
def agg_15_row_totals(s, d):
    return agg_14_contingency(s, d).withColumn("total", sum((F.col(f"c{i}") for i in range(2, 6)), F.col("c1")))


@query("SELECT CASE WHEN f IS NULL THEN '其他' ELSE 花名 END AS kind, count(*) AS n FROM review_tool LEFT JOIN (SELECT 花名 AS f FROM review_tool WHERE 花名 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 花名 LIMIT 10) ON 花名 = f GROUP BY 1")
def agg_16_top_plus_other(s, d):
    counts = table(s, d, "review_tool").groupBy("花名").agg(n())
    top = counts.where(F.col("花名").isNotNull()).orderBy(F.desc("n"), "花名").limit(10).select("花名", F.lit(True).alias("top"))
    j = counts.join(F.broadcast(top), "花名", "left")
    return j.groupBy(F.when(F.col("top"), F.col("花名")).otherwise("其他").alias("kind")).agg(F.sum("n").alias("n"))


TOK = r"regexp_extract_all(lower(text), '([a-z]{2,}|[一-鿿]{2})', 1)"
LONG = f"tok AS (SELECT doc_id, unnest({TOK}) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2)"


def counts(s, d):
    return T.term_counts(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id", T.tokens(F.col("text")))


@query(f"WITH {LONG} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term")
def agg_17_document_frequency(s, d):
    return T.frequencies(counts(s, d), "doc_id")


@query("SELECT source, round(CAST(sum(w) AS DOUBLE), 4) AS weight FROM (SELECT source, 8.0 * (length(text) - length(replace(text, '月', ''))) AS w FROM documents WHERE source IS NOT NULL AND text IS NOT NULL UNION ALL SELECT source, 120 * 0.08 * (length(text) - length(replace(text, '孤', ''))) FROM documents WHERE source IS NOT NULL AND text IS NOT NULL) GROUP BY source")
def agg_18_weighted_sum(s, d):
    t = table(s, d, "documents").where("source is not null and text is not null")
    hits = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    return t.groupBy("source").agg(F.round(F.sum(8.0 * hits("月")) + F.sum(120 * 0.08 * hits("孤")), 4).alias("weight"))


@query(f"WITH t AS (SELECT lang, unnest({TOK}) AS term FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2) SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 12")
def agg_19_top_terms_per_group(s, d):
    t = table(s, d, "documents").where("lang is not null").select("lang", F.explode(T.tokens(F.col("text"))).alias("term"))
    return R.top_k(t.groupBy("lang", "term").agg(n()), ["lang"], [F.desc("n"), F.asc("term")], 12)


OTHER_FLOWERS = "SELECT DISTINCT entry AS term FROM canon_value WHERE field_name = '花名' AND entry <> '霜铃花' AND entry <> ''"


@query(f"SELECT source, string_agg(term, '|' ORDER BY n DESC, term) AS terms FROM (SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS r FROM (SELECT source, term, sum((length(text) - length(replace(text, term, ''))) // length(term)) AS n FROM documents JOIN ({OTHER_FLOWERS}) ON contains(text, term) WHERE source IS NOT NULL GROUP BY 1, 2)) WHERE r <= 20 GROUP BY source")
def agg_20_whitelisted_terms(s, d):
    """Terms of any length, wherever they stand."""
    from ..operators import lexicon as L

    w = table(s, d, "canon_value").where("field_name = '花名' and entry <> '霜铃花'").select(F.col("entry").alias("term")).distinct()
    docs = table(s, d, "documents").where("source is not null and text is not null").select("source", "text")
    t = L.all_matches(docs, "source", "text", w).select("source", "term")
    top = R.top_k(t.groupBy("source", "term").agg(n()), ["source"], [F.desc("n"), F.asc("term")], 20)
    x = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))).alias("x"))
    return x.select("source", F.array_join(F.transform("x", lambda v: v["term"]), "|").alias("terms"))


@query("SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS mean, count(*) AS n FROM embeddings GROUP BY label")
def agg_21_mean_and_count(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("mean"), n())


PAIRS = "pr AS (SELECT event_id, CASE WHEN value > 60 THEN 'high' WHEN value < 40 THEN 'low' ELSE 'middle' END AS a, CASE WHEN value + user_id % 30 - 15 > 60 THEN 'high' WHEN value + user_id % 30 - 15 < 40 THEN 'low' ELSE 'middle' END AS p FROM events)"


def _pairs(s, d):
    kind = lambda v: F.when(v > 60, "high").when(v < 40, "low").otherwise("middle")
    v = F.col("value")
    return table(s, d, "events").select("event_id", kind(v).alias("a"), kind(v + F.col("user_id") % 30 - 15).alias("p"))


@query(f"WITH {PAIRS} SELECT a, count(*) FILTER (p = 'low') AS low, count(*) FILTER (p = 'middle') AS middle, count(*) FILTER (p = 'high') AS high FROM pr GROUP BY a")
def agg_22_confusion(s, d):
    return R.contingency(_pairs(s, d), "a", "p", ["low", "middle", "high"])


@query(f"WITH {PAIRS}, l AS (SELECT DISTINCT a AS label FROM pr), c AS (SELECT label, (SELECT count(*) FROM pr WHERE a = label AND p = label) AS tp, (SELECT count(*) FROM pr WHERE a = label) AS sup, (SELECT count(*) FROM pr WHERE p = label) AS g FROM l) SELECT label, round(tp / g, 6) AS precision, round(tp / sup, 6) AS recall, round(2 * (tp / g) * (tp / sup) / (tp / g + tp / sup), 6) AS f1, sup AS support FROM c")
def agg_23_precision_recall(s, d):
    return R.classification_report(_pairs(s, d), "a", "p").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("SELECT round(avg(CAST(a = b AS INTEGER)), 4) AS ab, round(avg(CAST(b = c AS INTEGER)), 4) AS bc, round(avg(CAST(a = b AND b = c AS INTEGER)), 4) AS abc FROM (SELECT event_id % 3 AS a, user_id % 3 AS b, CAST(floor(value) AS BIGINT) % 3 AS c FROM events)")
def agg_24_agreement(s, d):
    t = table(s, d, "events").select((F.col("event_id") % 3).alias("a"), (F.col("user_id") % 3).alias("b"), (F.floor("value") % 3).alias("c"))
    share = lambda e, name: F.round(F.avg(F.expr(e).cast("int")), 4).alias(name)
    return t.agg(share("a <=> b", "ab"), share("b <=> c", "bc"), share("a <=> b and b <=> c", "abc"))


@query(f"WITH t AS (SELECT genre, unnest({TOK}) AS term FROM documents WHERE genre IS NOT NULL AND text IS NOT NULL), k AS (SELECT genre, term FROM (SELECT genre, term, row_number() OVER (PARTITION BY genre ORDER BY count(*) DESC, term) AS r FROM t GROUP BY 1, 2) WHERE r <= 50), s AS (SELECT genre, count(*) AS size FROM k GROUP BY 1) SELECT a.genre AS x, b.genre AS y, count(*) AS both, round(count(*) / CAST(any_value(s.size) AS DOUBLE), 4) AS rate FROM k a JOIN k b ON a.term = b.term AND a.genre < b.genre JOIN s ON s.genre = a.genre GROUP BY 1, 2")
def agg_25_set_overlap(s, d):
    """Of every two genres that share any of their fifty most frequent terms, how many they share; lists meet by their terms."""
    t = table(s, d, "documents").where("genre is not null").select("genre", F.explode(T.tokens(F.col("text"))).alias("term"))
    k = R.top_k(t.groupBy("genre", "term").agg(n()), ["genre"], [F.desc("n"), F.asc("term")], 50).select("genre", "term")
    size = k.groupBy("genre").agg(n("size"))
    both = k.select(F.col("genre").alias("x"), "term").join(k.select(F.col("genre").alias("y"), "term"), "term").where("x < y").groupBy("x", "y").agg(n("both"))
    return both.join(size.withColumnRenamed("genre", "x"), "x").select("x", "y", "both", F.round(F.col("both") / F.col("size"), 4).alias("rate"))


@query("SELECT count(*) AS raw, count(*) FILTER (正文 IS NOT NULL) AS matched, count(*) FILTER (正文 IS NOT NULL AND 审核状态 = '✓') AS consistent, round(100.0 * count(*) FILTER (正文 IS NOT NULL AND 审核状态 = '✓') / count(*), 2) AS retention FROM review_tool")
def agg_26_funnel(s, d):
    a, b = F.col("正文").isNotNull(), F.col("审核状态") == "✓"
    return table(s, d, "review_tool").agg(n("raw"), F.count_if(a).alias("matched"), F.count_if(a & b).alias("consistent"), F.round(100 * F.count_if(a & b) / F.count(F.lit(1)), 2).alias("retention"))


@query("SELECT 朝代, CAST(sum(n) AS BIGINT) AS n, string_agg(花名 || ':' || n, '、' ORDER BY n DESC, 花名) FILTER (r <= 5) AS top FROM (SELECT 朝代, 花名, count(*) AS n, row_number() OVER (PARTITION BY 朝代 ORDER BY count(*) DESC, 花名) AS r FROM review_tool WHERE 朝代 IS NOT NULL AND 花名 IS NOT NULL GROUP BY 1, 2) GROUP BY 朝代")
def agg_27_nested_top5(s, d):
    c = table(s, d, "review_tool").where(F.col("朝代").isNotNull() & F.col("花名").isNotNull()).groupBy("朝代", "花名").agg(n())
    total = c.groupBy("朝代").agg(F.sum("n").alias("n"))
    top = R.top_k(c, ["朝代"], [F.desc("n"), F.asc("花名")], 5).groupBy("朝代").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "花名", F.col("n").cast("string")).alias("t")))).alias("x"))
    return total.join(top, "朝代").select("朝代", "n", F.array_join(F.transform("x", lambda v: v["t"]), "、").alias("top"))


@query("SELECT ID FROM (SELECT ID, row_number() OVER (PARTITION BY 诗名, 作者 ORDER BY ID) AS r FROM review_tool) WHERE r > 1")
def agg_28_later_duplicates(s, d):
    return table(s, d, "review_tool").withColumn("r", F.row_number().over(Window.partitionBy("诗名", "作者").orderBy("ID"))).where("r > 1").select("ID")


@query("WITH e AS (SELECT DISTINCT entry AS term FROM canon_value WHERE field_name = '花名' AND entry <> ''), k AS (SELECT doc_id, sum((length(text) - length(replace(text, term, ''))) // length(term)) AS k FROM documents JOIN e ON contains(text, term) GROUP BY doc_id) SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS hits, count(k) AS covered, count(*) - count(k) AS uncovered FROM documents LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL")
def agg_29_lexicon_coverage(s, d):
    from ..operators import lexicon as L

    t = table(s, d, "documents").where("text is not null").select("doc_id", "text")
    lex = table(s, d, "canon_value").where("field_name = '花名'").select(F.col("entry").alias("term")).distinct()
    hits = L.all_matches(t, "doc_id", "text", lex).groupBy("doc_id").agg(n("k"))
    return t.select("doc_id").join(hits, "doc_id", "left").agg(F.sum(F.coalesce("k", F.lit(0))).alias("hits"), F.count_if(F.col("k") > 0).alias("covered"), F.count_if(F.col("k").isNull()).alias("uncovered"))


@query("SELECT lang, col, value, n FROM (SELECT lang, col, value, count(*) AS n, row_number() OVER (PARTITION BY lang, col ORDER BY count(*) DESC, value) AS r FROM (SELECT lang, 'source' AS col, source AS value FROM documents UNION ALL SELECT lang, 'genre', genre FROM documents) WHERE coalesce(value, '') <> '' AND lang IS NOT NULL GROUP BY 1, 2, 3) WHERE r <= 5")
def agg_30_cluster_profile(s, d):
    t = table(s, d, "documents").where("lang is not null").select("lang", "source", "genre").unpivot("lang", ["source", "genre"], "col", "value").where("coalesce(value, '') <> ''")
    return R.top_k(t.groupBy("lang", "col", "value").agg(n()), ["lang", "col"], [F.desc("n"), F.asc("value")], 5).select("lang", "col", "value", "n")


@query("SELECT label, " + ", ".join(f"round(CASE WHEN t = 0 THEN m{i} ELSE m{i} / t END, 5) AS m{i}" for i in range(4)) + " FROM (SELECT *, m0 + m1 + m2 + m3 AS t FROM (SELECT label, " + ", ".join(f"avg(abs(CAST(embedding[{i + 1}] AS DOUBLE))) AS m{i}" for i in range(4)) + " FROM embeddings GROUP BY label))")
def agg_31_normalised_means(s, d):
    m = table(s, d, "embeddings").groupBy("label").agg(*[F.avg(F.abs(F.col("embedding")[i].cast("double"))).alias(f"m{i}") for i in range(4)])
    t = F.col("m0") + F.col("m1") + F.col("m2") + F.col("m3")
    return m.select("label", *[F.round(F.coalesce(F.col(f"m{i}") / F.nullif(t, F.lit(0.0)), F.col(f"m{i}")), 5).alias(f"m{i}") for i in range(4)])


@query("SELECT 月份数字 AS month, count(*) AS n, round((月份数字 - 1) / 12.0 * 2 * pi(), 6) AS theta, round(ln(1 + count(*)), 6) AS r FROM review_tool WHERE 月份数字 > 0 GROUP BY 月份数字")
def agg_32_polar(s, d):
    c = table(s, d, "review_tool").where(F.col("月份数字") > 0).groupBy(F.col("月份数字").alias("month")).agg(n())
    return c.select("month", "n", F.round((F.col("month") - 1) / 12 * 2 * F.pi(), 6).alias("theta"), F.round(F.log1p("n"), 6).alias("r"))


@query(f"SELECT doc_id, len(x) AS tokens, len(list_filter(x, lambda t: contains(t, '月') OR contains(t, '云'))) AS nature, CASE WHEN len(x) = 0 THEN 0 ELSE round(len(list_filter(x, lambda t: contains(t, '月') OR contains(t, '云'))) / CAST(len(x) AS DOUBLE), 4) END AS ratio FROM (SELECT doc_id, {TOK} AS x FROM documents WHERE text IS NOT NULL)")
def agg_33_token_ratio(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("x"))
    m = F.size(F.filter("x", lambda v: F.contains(v, F.lit("月")) | F.contains(v, F.lit("云"))))
    return t.select("doc_id", F.size("x").cast("bigint").alias("tokens"), m.cast("bigint").alias("nature"), F.when(F.size("x") == 0, 0.0).otherwise(F.round(m / F.size("x"), 4)).alias("ratio"))


@query("SELECT lang, genre, round(n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE), 4) AS share, every_long FROM (SELECT lang, genre, count(*) AS n, bool_and(coalesce(n_chars, 0) >= 10) AS every_long FROM documents WHERE lang IS NOT NULL AND genre IS NOT NULL GROUP BY 1, 2)")
def agg_34_stacked_share(s, d):
    g = table(s, d, "documents").where("lang is not null and genre is not null").groupBy("lang", "genre").agg(n(), F.bool_and(F.coalesce("n_chars", F.lit(0)) >= 10).alias("every_long"))
    return g.select("lang", "genre", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 4).alias("share"), "every_long")
