"""Joins, merges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import retrieval as V
from ..session import table
from .registry import query


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def join_01_left_chain(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return j.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT coalesce(d.doc_id, e.doc_id) AS doc_id, d.lang, e.label FROM documents d FULL OUTER JOIN (SELECT vec_id AS doc_id, label FROM embeddings) e ON d.doc_id = e.doc_id")
def join_02_full_outer_one_to_one(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return R.one_to_one_outer(table(s, d, "documents").select("doc_id", "lang"), e, ["doc_id"]).select("doc_id", "lang", "label")


@query("SELECT c.id AS category_id, any_value(c.name) AS name, count(*) AS n FROM product p JOIN category c ON p.category_id = c.id GROUP BY c.id")
def join_03_inner_group(s, d):
    p = table(s, d, "product").where("category_id is not null").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))  # aggregated before the join
    c = table(s, d, "category").select(F.col("id").alias("category_id"), "name")
    return p.join(c, "category_id").select("category_id", "name", "n")


@query("SELECT doc_id, lang, label FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS i FROM documents) JOIN (SELECT label, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) USING (i)")
def join_04_positional(s, d):
    a = V.ranked(table(s, d, "documents").select("doc_id", "lang"), [F.col("doc_id")], "i")
    b = V.ranked(table(s, d, "embeddings").select("vec_id", "label"), [F.col("vec_id")], "i")
    return a.join(b, "i").select("doc_id", "lang", "label")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def join_05_anti(s, d):
    li = table(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(s, d, "part").join(li, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50)")
def join_06_semi(s, d):
    top = table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).select(F.col("c_custkey").alias("o_custkey"))
    return table(s, d, "orders").join(F.broadcast(top), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT p.id, c.full_path FROM product p LEFT JOIN (SELECT supplier_id, min_by(full_path, id) AS full_path FROM category WHERE full_path IS NOT NULL GROUP BY supplier_id) c ON p.supplier_id = c.supplier_id")
def join_07_first_match(s, d):
    c = table(s, d, "category").where("full_path is not null").select("supplier_id", "full_path", F.col("id").alias("o"))
    return R.first_match(table(s, d, "product").select("id", "supplier_id"), c, ["supplier_id"], "o").select("id", "full_path")


CONTAINS = "SELECT DISTINCT p.id, c.entry AS term FROM product p JOIN (SELECT DISTINCT entry FROM canon_value WHERE field_name = '花名') c ON contains(coalesce(p.name, ''), c.entry) OR contains(coalesce(p.spec_text, ''), c.entry) OR contains(coalesce(p.description, ''), c.entry)"


def _flowers(s, d):
    return table(s, d, "canon_value").where("field_name = '花名'").select(F.col("entry").alias("term")).distinct()


@query(CONTAINS)
def join_08_containment(s, d):
    p = table(s, d, "product").select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "spec_text", "description")])
    t = _flowers(s, d)  # a fixed reference list
    hit = F.contains("name", "term") | F.contains("spec_text", "term") | F.contains("description", "term")
    return p.join(R.small(t, 1000), hit).select("id", "term").distinct()  # for a list of that size; contains_join for others


@query(CONTAINS)
def join_09_containment_by_grams(s, d):
    return R.contains_join(table(s, d, "product"), "id", ["name", "spec_text", "description"], _flowers(s, d), "term")


DOT = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEAREST = f"SELECT q, vec_id, rank, similarity FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({DOT}, 12) DESC, b.vec_id) AS rank, round({DOT}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10"


def _nearest(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(e, e, "vec_id", "embedding", 10)


@query(NEAREST)
def join_10_all_pairs_top10(s, d):
    return _nearest(s, d).select("q", "vec_id", "rank", F.round("similarity", 5).alias("similarity"))


@query()
def join_10_indexed_top10(s, d):
    """Approximate neighbours of every row whose id is divisible by 100, against all rows."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    cells = V.fit_cells(e, "vec_id", "embedding", 32)
    return V.nearest_by_index(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, cells, 18)


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS similarity FROM embeddings")
def join_11_one_query_vector(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))


EDITS = """e AS (
 SELECT ID, 'A' AS reviewer, CASE WHEN 月份数字 = 3 THEN '露' || 诗名 ELSE 诗名 END AS 诗名, 审核状态 FROM review_tool
 UNION ALL SELECT ID, 'B', CASE WHEN 月份数字 IN (3, 4) THEN '霜' || 诗名 ELSE 诗名 END, CASE WHEN 月份数字 = 5 THEN '⚑' ELSE 审核状态 END FROM review_tool
 UNION ALL SELECT 'none-' || ID, 'C', 'x', 'y' FROM review_tool WHERE 月份数字 = 1),
ch AS (SELECT e.ID, reviewer, '诗名' AS field, e.诗名 AS v FROM e JOIN review_tool b ON b.ID = e.ID WHERE e.诗名 IS NOT NULL AND e.诗名 IS DISTINCT FROM b.诗名
 UNION ALL SELECT e.ID, reviewer, '审核状态', e.审核状态 FROM e JOIN review_tool b ON b.ID = e.ID WHERE e.审核状态 IS NOT NULL AND e.审核状态 IS DISTINCT FROM b.审核状态)"""


def _overlay(s, d):
    base = table(s, d, "review_tool").select("ID", "诗名", "审核状态", "月份数字")
    m = F.col("月份数字")
    a = base.select("ID", F.lit("A").alias("reviewer"), F.when(m == 3, F.concat(F.lit("露"), "诗名")).otherwise(F.col("诗名")).alias("诗名"), "审核状态")
    b = base.select("ID", F.lit("B").alias("reviewer"), F.when(m.isin(3, 4), F.concat(F.lit("霜"), "诗名")).otherwise(F.col("诗名")).alias("诗名"), F.when(m == 5, "⚑").otherwise(F.col("审核状态")).alias("审核状态"))
    c = base.where(m == 1).select(F.concat(F.lit("none-"), "ID").alias("ID"), F.lit("C").alias("reviewer"), F.lit("x").alias("诗名"), F.lit("y").alias("审核状态"))
    return R.overlay_merge(base.select("ID", "诗名", "审核状态"), a.unionByName(b).unionByName(c), "ID", ["诗名", "审核状态"], "reviewer")


@query(f"WITH {EDITS} SELECT b.ID, coalesce((SELECT min_by(v, reviewer) FROM ch WHERE ch.ID = b.ID AND field = '诗名'), b.诗名) AS 诗名, coalesce((SELECT min_by(v, reviewer) FROM ch WHERE ch.ID = b.ID AND field = '审核状态'), b.审核状态) AS 审核状态 FROM review_tool b")
def join_12_overlay_merge(s, d):
    return _overlay(s, d)[0]


@query(f"""WITH {EDITS} SELECT ID, field, count(DISTINCT v) AS n_values, string_agg(DISTINCT v, '|' ORDER BY v) AS "values" FROM ch GROUP BY ID, field HAVING count(DISTINCT v) > 1""")
def join_12_overlay_conflicts(s, d):
    return _overlay(s, d)[1]


@query("SELECT ref_id, entry || '|' || CASE WHEN len(other_names) > 0 THEN array_to_string(other_names, '|') || '|' ELSE '' END || field_name AS terms FROM canon_value")
def join_13_ordered_override(s, d):
    t = table(s, d, "canon_value")
    return t.select("ref_id", F.array_join(F.array_distinct(F.concat(F.array("entry"), F.coalesce("other_names", F.array().cast("array<string>")), F.array("entry", "field_name"))), "|").alias("terms"))


@query("SELECT coalesce(a.term, b.term) AS term, CASE WHEN a.term IS NOT NULL AND b.term IS NOT NULL THEN 'both' WHEN a.term IS NOT NULL THEN 'list only' ELSE 'rows only' END AS verdict, coalesce(b.n, 0) AS n FROM (SELECT DISTINCT entry AS term FROM canon_value WHERE field_name = '花名') a FULL OUTER JOIN (SELECT 花名 AS term, count(*) AS n FROM review_tool WHERE 花名 IS NOT NULL GROUP BY 花名) b ON a.term = b.term")
def join_14_vocabulary_union(s, d):
    a = _flowers(s, d).withColumn("a", F.lit(1))
    b = table(s, d, "review_tool").where(F.col("花名").isNotNull()).groupBy(F.col("花名").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("a").isNotNull() & F.col("n").isNotNull(), "both").when(F.col("a").isNotNull(), "list only").otherwise("rows only")
    return a.join(b, "term", "full_outer").select("term", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c.id, p.id AS parent_id FROM category c LEFT JOIN category p ON c.supplier_id = p.supplier_id AND c.parent_external_id = p.external_id")
def join_15_natural_key_parent(s, d):
    c = table(s, d, "category")
    p = c.select("supplier_id", F.col("external_id").alias("parent_external_id"), F.col("id").alias("parent_id"))
    return c.join(p, ["supplier_id", "parent_external_id"], "left").select("id", "parent_id")


# --- set operations


@query("SELECT 'review' AS origin, ID AS key FROM review_tool UNION ALL SELECT 'raw', raw_id FROM poem_raw")
def set_01_union_all(s, d):
    return table(s, d, "review_tool").select(F.lit("review").alias("origin"), F.col("ID").alias("key")).unionByName(table(s, d, "poem_raw").select(F.lit("raw").alias("origin"), F.col("raw_id").alias("key")))


@query("SELECT key, origin FROM (SELECT key, origin, row_number() OVER (PARTITION BY key ORDER BY p) AS r FROM (SELECT s_nationkey AS key, min(s_name) AS origin, 0 AS p FROM supplier GROUP BY 1 UNION ALL SELECT c_nationkey, min(c_name), 1 FROM customer GROUP BY 1)) WHERE r = 1")
def set_02_union_first_wins(s, d):
    a = table(s, d, "supplier").where("s_nationkey is not null").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("origin"))
    b = table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("origin"))
    return R.union_first([a, b], ["key"])


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def set_03_distinct_keep_first(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("(SELECT o_custkey AS key, 'both' AS kind FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'P') UNION ALL (SELECT o_custkey, 'first only' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'first only' FROM orders WHERE o_orderstatus = 'P')")
def set_04_intersect_except(s, d):
    a, b = (table(s, d, "orders").where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("key")) for x in "FP")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("first only")))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i), lambda i: x[i]), '') AS letters FROM (SELECT doc_id, string_split(text, '') AS x FROM documents)")
def set_05_ordered_distinct_in_row(s, d):
    t = table(s, d, "documents")
    return t.select("doc_id", F.array_join(F.array_distinct(F.split("text", "")), "").alias("letters"))
