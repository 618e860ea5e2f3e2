"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import lexicon as L
from ..session import table
from .registry import query


@query("SELECT ID AS id, 诗名 AS title, 作者 AS author FROM review_tool")
def proj_01_subset_rename(s, d):
    return table(s, d, "review_tool").select(F.col("ID").alias("id"), F.col("诗名").alias("title"), F.col("作者").alias("author"))


@query("SELECT 花名 AS c3, 诗名 AS c4, 朝代 AS c5, 作者 AS c6 FROM review_tool")
def proj_02_positional_rename(s, d):
    return C.by_position(table(s, d, "review_tool"), {4: "c3", 5: "c4", 6: "c5", 7: "c6"})


@query("SELECT 诗名, 作者, ID, 月份, 花名 AS 花名, 朝代 FROM (SELECT ID, 月份, 花名, 诗名, 朝代, 作者 FROM review_tool)")
def proj_03_priority_order(s, d):
    return C.reorder(table(s, d, "review_tool").select("ID", "月份", "花名", "诗名", "朝代", "作者"), ["诗名", "作者"])


@query("SELECT doc_id, source AS kind, '' AS note FROM documents")
def proj_04_sniffed_columns(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", C.first_column(t, ["category", "source", "genre"], "").alias("kind"), C.first_column(t, ["note", "remark"], "").alias("note"))


@query("SELECT ID, '' AS label, CAST(NULL AS VARCHAR) AS reviewer, CASE WHEN length(正文) < 40 THEN 'short' WHEN length(正文) < 90 THEN 'middle' WHEN 正文 IS NULL THEN 'none' ELSE 'long' END AS size FROM review_tool")
def proj_05_literal_and_case(s, d):
    n = F.length("正文")
    return table(s, d, "review_tool").select("ID", F.lit("").alias("label"), F.lit(None).cast("string").alias("reviewer"), F.when(n < 40, "short").when(n < 90, "middle").when(F.col("正文").isNull(), "none").otherwise("long").alias("size"))


@query("SELECT ID, 'text' AS version, 正文 AS content FROM review_tool UNION ALL SELECT ID, 'comment', 赏析 FROM review_tool UNION ALL SELECT ID, 'note', 审核备注 FROM review_tool")
def proj_06_unpivot(s, d):
    t = table(s, d, "review_tool").select("ID", F.col("正文").alias("text"), F.col("赏析").alias("comment"), F.col("审核备注").alias("note"))
    return t.unpivot("ID", ["text", "comment", "note"], "version", "content")


@query("SELECT ID, 月份 FROM review_tool WHERE trim(月份) IN ('三月', '四月', '五月')")
def proj_07_in_set(s, d):
    return table(s, d, "review_tool").where(F.trim("月份").isin("三月", "四月", "五月")).select("ID", "月份")


@query("SELECT ID, 月份数字 FROM review_tool WHERE 月份数字 IN (12, 1, 2)")
def proj_08_month_window(s, d):
    return table(s, d, "review_tool").where(C.month_near(F.col("月份数字"), 1, 1)).select("ID", "月份数字")


@query("SELECT ID, CASE WHEN 月份数字 = 3 THEN 2 WHEN 月份数字 IN (2, 4) THEN 1 ELSE 0 END AS score FROM review_tool")
def proj_09_tiered_score(s, d):
    m = F.col("月份数字")
    return table(s, d, "review_tool").select("ID", F.when(m == 3, 2).when(C.month_near(m, 3, 1), 1).otherwise(0).alias("score"))


@query("SELECT ID FROM review_tool WHERE NOT (coalesce(trim(正文, ' \n\r\t'), '') = '' AND coalesce(trim(赏析, ' \n\r\t'), '') = '')")
def proj_10_both_blank(s, d):
    blank = lambda c: F.coalesce(F.trim(F.col(c), F.lit(" \n\r\t")), F.lit("")) == ""
    return table(s, d, "review_tool").where(~(blank("正文") & blank("赏析"))).select("ID")


@query("SELECT id, image_url FROM product WHERE trim(coalesce(image_url, '')) <> '' AND (image_local_path IS NULL OR trim(image_local_path) = '')")
def proj_11_null_or_empty(s, d):
    return table(s, d, "product").where("trim(coalesce(image_url, '')) <> '' AND (image_local_path IS NULL OR trim(image_local_path) = '')").select("id", "image_url")


@query(
    "SELECT doc_id, CASE WHEN doc_id BETWEEN 100 AND 199 THEN 'first' WHEN doc_id BETWEEN 300 AND 349 OR doc_id = 500 THEN 'second' ELSE source END AS source, (doc_id BETWEEN 100 AND 199 OR doc_id BETWEEN 300 AND 349 OR doc_id = 500) AS changed FROM documents"
)
def proj_12_range_patch(s, d):
    return C.range_patch(table(s, d, "documents").select("doc_id", "source"), "doc_id", "source", [(100, 199, "first"), (300, 349, "second"), (500, 500, "second")], "changed")


@query(
    "SELECT ID, CASE WHEN trim(花名) IN ('霜铃花', '月络兰') THEN 'north' WHEN trim(花名) IN ('月络兰', '烟缕菊', '雪绵莲') THEN 'south' ELSE 'elsewhere' END AS place FROM review_tool"
)
def proj_13_first_rule_wins(s, d):
    return table(s, d, "review_tool").select("ID", C.first_rule(F.trim("花名"), [(["霜铃花", "月络兰"], "north"), (["月络兰", "烟缕菊", "雪绵莲"], "south")], "elsewhere").alias("place"))


@query(
    "SELECT r.ID, CAST(coalesce(CASE r.月份 WHEN '正月' THEN 1 WHEN '二月' THEN 2 WHEN '三月' THEN 3 WHEN '四月' THEN 4 WHEN '五月' THEN 5 WHEN '六月' THEN 6 WHEN '七月' THEN 7 WHEN '八月' THEN 8 WHEN '九月' THEN 9 WHEN '十月' THEN 10 WHEN '十一月' THEN 11 WHEN '十二月' THEN 12 END, 0) AS INTEGER) AS month FROM review_tool r"
)
def proj_14_recode(s, d):
    months = ["正月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月"]
    return table(s, d, "review_tool").select("ID", C.recode(F.col("月份"), {m: i + 1 for i, m in enumerate(months)}, 0).alias("month"))


@query("SELECT event_id, CASE WHEN value > 60 THEN 'high' WHEN value < 40 THEN 'low' ELSE 'middle' END AS kind FROM events")
def proj_15_three_way(s, d):
    return table(s, d, "events").select("event_id", F.when(F.col("value") > 60, "high").when(F.col("value") < 40, "low").otherwise("middle").alias("kind"))


@query(
    "SELECT vec_id, CASE WHEN p - n > 0.05 THEN 'positive' WHEN n - p > 0.05 THEN 'negative' ELSE 'neutral' END AS kind, round(CASE WHEN p - n > 0.05 THEN (p - n) / greatest(p + n, 1e-8) WHEN n - p > 0.05 THEN (n - p) / greatest(p + n, 1e-8) ELSE 0 END, 4) AS confidence FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS p, abs(CAST(embedding[2] AS DOUBLE)) AS n FROM embeddings)"
)
def proj_16_signed_difference(s, d):
    t = table(s, d, "embeddings").select("vec_id", F.abs(F.col("embedding")[0].cast("double")).alias("p"), F.abs(F.col("embedding")[1].cast("double")).alias("n"))
    kind, confidence = C.neutral_band(F.col("p"), F.col("n"))
    return t.select("vec_id", kind.alias("kind"), F.round(confidence, 4).alias("confidence"))


@query(
    "SELECT doc_id, CASE WHEN n_chars IS NULL THEN NULL WHEN n_chars < 50 THEN '0-50' WHEN n_chars < 100 THEN '50-100' WHEN n_chars < 500 THEN '100-500' WHEN n_chars < 5000 THEN '500-5000' ELSE '5000+' END AS bin FROM documents"
)
def proj_17_bins(s, d):
    return table(s, d, "documents").select("doc_id", C.half_open_bins(F.col("n_chars"), [0, 50, 100, 500, 5000]).alias("bin"))


@query(
    "SELECT event_id, CAST(floor((CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 ELSE greatest(a, b) END) * 1000 + 1e-6) AS BIGINT) AS confidence, CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 ELSE greatest(a, b) END >= CAST(0.65 AS DOUBLE) AS high, CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 ELSE greatest(a, b) END < CAST(0.4 AS DOUBLE) AS review FROM (SELECT event_id, CAST(0.9 AS DOUBLE) * least(value / CAST(50 AS DOUBLE), 1.0) AS a, CASE WHEN user_id % 2 = 0 THEN CAST(0.8 AS DOUBLE) * least((user_id % 10) / CAST(6 AS DOUBLE), 1.0) ELSE CAST(0 AS DOUBLE) END AS b FROM events)"
)
def proj_18_confidence(s, d):
    t = table(s, d, "events")
    a = C.clamped(F.lit(0.9), F.col("value"), 50.0)
    b = F.when(F.col("user_id") % 2 == 0, C.clamped(F.lit(0.8), F.col("user_id") % 10, 6.0)).otherwise(0.0)
    c = C.combined(a, b)
    return t.select("event_id", F.floor(c * 1000 + 1e-6).alias("confidence"), (c >= 0.65).alias("high"), (c < 0.4).alias("review"))


@query(
    "SELECT doc_id, CASE WHEN contains(text, '公分') OR contains(text, '到貨') THEN 'shop' WHEN contains(text, '一名') OR contains(text, '性喜') THEN 'plant' WHEN contains(text, '何以') OR contains(text, '章法') THEN 'comment' ELSE 'other' END AS kind FROM documents"
)
def proj_19_keyword_rules(s, d):
    return table(s, d, "documents").select("doc_id", L.keyword_rules(F.col("text"), [("shop", ["公分", "到貨"]), ("plant", ["一名", "性喜"]), ("comment", ["何以", "章法"])], "other").alias("kind"))


@query(
    "SELECT doc_id, CASE WHEN g AND NOT o THEN 'gift' WHEN o AND NOT g THEN 'self' WHEN g AND o AND length(text) > 200 THEN 'gift' ELSE 'ambiguous' END AS kind FROM (SELECT doc_id, text, coalesce(contains(text, '送') OR contains(text, '忆'), false) AS g, coalesce(contains(text, '闲') OR contains(text, '孤'), false) AS o FROM documents)"
)
def proj_20_xor_keywords(s, d):
    has = lambda *w: F.coalesce(F.expr(" or ".join(f"contains(text, '{x}')" for x in w)), F.lit(False))
    g, o = has("送", "忆"), has("闲", "孤")
    return table(s, d, "documents").select("doc_id", F.when(g & ~o, "gift").when(o & ~g, "self").when(g & o & (F.length("text") > 200), "gift").otherwise("ambiguous").alias("kind"))


@query(
    "SELECT vec_id, CASE WHEN label % 2 = 0 THEN CASE WHEN a >= b THEN 'joy' ELSE 'calm' END ELSE CASE WHEN c >= e THEN 'grief' ELSE 'anger' END END AS best FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e FROM embeddings)"
)
def proj_21_constrained_label(s, d):
    v = [F.col("embedding")[i].cast("double") for i in range(4)]
    best = C.constrained_arg_max(F.when(F.col("label") % 2 == 0, F.lit("even")).otherwise("odd"), {"even": ["joy", "calm"], "odd": ["grief", "anger"]}, dict(zip(("joy", "calm", "grief", "anger"), v)))
    return table(s, d, "embeddings").select("vec_id", best.alias("best"))


@query("SELECT event_id, event_type, kind FROM (SELECT event_id, event_type, CASE WHEN value > 60 THEN 'high' WHEN value < 40 THEN 'low' ELSE 'middle' END AS kind FROM events) WHERE (event_type, kind) IN (('click', 'high'), ('click', 'middle'), ('error', 'low'), ('view', 'high'))")
def proj_22_consistency(s, d):
    t = table(s, d, "events").select("event_id", "event_type", F.when(F.col("value") > 60, "high").when(F.col("value") < 40, "low").otherwise("middle").alias("kind"))
    rules = s.createDataFrame([("click", "high"), ("click", "middle"), ("error", "low"), ("view", "high")], "event_type string, kind string")
    return t.join(F.broadcast(rules), ["event_type", "kind"], "left_semi").select("event_id", "event_type", "kind")


@query("SELECT ID, 诗名 FROM review_tool WHERE 月份 = '三月' AND 审核状态 = '✓' AND (contains(诗名, '露') OR contains(作者, '露') OR contains(正文, '露'))")
def proj_23_request_filter(s, d):
    return C.request_filter(table(s, d, "review_tool"), {"月份": "三月", "审核状态": "✓", "审核员": None}, "露", ["诗名", "作者", "正文"]).select("ID", "诗名")


@query(
    "SELECT ID, CASE WHEN a AND b THEN 'both' WHEN a THEN 'text only' WHEN b THEN 'comment only' ELSE 'none' END AS verdict FROM (SELECT ID, coalesce(contains(正文, '月'), false) AS a, coalesce(contains(赏析, '月'), false) AS b FROM review_tool)"
)
def proj_24_verdict(s, d):
    a, b = (F.coalesce(F.contains(F.col(c), F.lit("月")), F.lit(False)) for c in ("正文", "赏析"))
    return table(s, d, "review_tool").select("ID", F.when(a & b, "both").when(a, "text only").when(b, "comment only").otherwise("none").alias("verdict"))


@query("SELECT 花名, CASE WHEN bool_or(审核状态 = '⚑') THEN '⚑' WHEN bool_or(审核状态 = '✓') THEN '✓' ELSE '' END AS status FROM review_tool WHERE 花名 IS NOT NULL GROUP BY 花名")
def proj_25_status_majority(s, d):
    rank = F.when(F.col("审核状态") == "⚑", 2).when(F.col("审核状态") == "✓", 1).otherwise(0)
    g = table(s, d, "review_tool").where(F.col("花名").isNotNull()).groupBy("花名").agg(F.max(rank).alias("r"))
    return g.select("花名", F.when(F.col("r") == 2, "⚑").when(F.col("r") == 1, "✓").otherwise("").alias("status"))


@query("SELECT 花名, 朝代, count(*) AS n FROM review_tool WHERE 花名 IS NOT NULL AND 朝代 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def proj_26_least_group(s, d):
    return table(s, d, "review_tool").where(F.col("花名").isNotNull() & F.col("朝代").isNotNull()).groupBy("花名", "朝代").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
