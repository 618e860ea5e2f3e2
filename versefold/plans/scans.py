"""Sources and sinks: tables written in another format and read again, texts parsed by lines, work lists and logs."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import functions as F

from ..operators import relational as R
from ..session import Stage, table
from ..sources import readers as S
from ..sources import stores
from ..sources import writers as K
from .registry import query


@query("SELECT ID, 诗名, 正文 FROM review_tool WHERE 正文 IS NOT NULL AND 正文 <> ''")
def src_01_csv(s, d):
    st = Stage(s, "csv")
    K.write_csv(table(s, d, "review_tool").select("ID", "诗名", "正文").where(F.col("正文") != ""), f"{st.root}/x")
    return S.read_csv(s, f"{st.root}/x").select("ID", F.col("诗名"), "正文")


@query("SELECT CAST(ref_id AS VARCHAR) AS ref_id, entry FROM canon_value")
def src_02_any_encoding(s, d):
    st = Stage(s, "enc")
    K.write_csv(table(s, d, "canon_value").select(F.col("ref_id").cast("string"), "entry"), f"{st.root}/x")
    return S.read_csv_any_encoding(s, f"{st.root}/x/*.csv", ["ref_id", "entry"]).select("ref_id", "entry")


@query("SELECT CAST(ref_id AS VARCHAR) AS ref_id, field_name, entry FROM canon_value")
def src_03_tsv_tree(s, d):
    st = Stage(s, "tsv")
    c = table(s, d, "canon_value").select(F.col("ref_id").cast("string"), "field_name", "entry")
    for f in ("花名", "朝代", "月份"):
        c.where(F.col("field_name") == f).write.option("header", True).option("sep", "\t").csv(f"{st.root}/x/{f}")
    return S.read_tsv_tree(s, f"{st.root}/x", "*.csv").select("ref_id", "field_name", "entry")


@query("SELECT entry AS term, field_name AS parent FROM canon_value")
def src_06_class_tree(s, d):
    """Classes of an OWL file with their parents; the file is written line by line first."""
    st = Stage(s, "owl")
    one = F.format_string('<owl:Class rdf:ID="C4_%s"><rdfs:subClassOf rdf:resource="#C3_%s"/></owl:Class>', "entry", "field_name")
    rows = table(s, d, "canon_value").select(F.lit(1).alias("o"), one.alias("line"))
    ends = s.createDataFrame([(0, '<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">'), (2, "</rdf:RDF>")], "o int, line string")
    rows.union(ends).coalesce(1).sortWithinPartitions("o").select("line").write.text(f"{st.root}/x")
    return S.read_class_tree(s, f"{st.root}/x")


@query("SELECT event_id, coalesce(nullif(event_type, 'view'), '3') AS label FROM events")
def src_05_json_lines(s, d):
    st = Stage(s, "json")
    e = table(s, d, "events").select("event_id", F.struct(F.nullif("event_type", F.lit("view")).alias("holistic")).alias("labels"))
    e.write.json(f"{st.root}/x")
    return S.labelled(S.read_json_lines(s, f"{st.root}/x", "event_id bigint, labels struct<holistic:string>"), "labels.holistic", "label", "3").select("event_id", "label")


LINES = "l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)"


def _lines(s, d):
    return S.numbered_lines(table(s, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"WITH {LINES}, h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^卷\\d+ .*') THEN regexp_extract(line, '^卷\\d+ (.*)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM l) SELECT doc_id, CAST(i AS INTEGER) AS i, heading, line FROM h WHERE NOT regexp_matches(line, '^卷\\d+ .*') AND trim(line) <> '' AND heading IS NOT NULL")
def src_07_markdown_lines(s, d):
    return S.under_headings(_lines(s, d), "doc_id", {"heading": r"^卷\d+ (.*)"}).where("heading is not null").select("doc_id", "i", "heading", "line")


@query(f"WITH {LINES}, r AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^卷\\d+ (.*)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n, regexp_matches(line, '^卷\\d+ (.*)') AS st, regexp_matches(line, '^（') AS co FROM l) SELECT doc_id, CAST(n AS BIGINT) AS n, max(regexp_extract(line, '^卷\\d+ (.*)', 1)) FILTER (st) AS title, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT st AND NOT co), '') AS body, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT st AND co), '') AS comment FROM r WHERE n > 0 AND trim(line) <> '' GROUP BY doc_id, n")
def src_07_records(s, d):
    return S.records(_lines(s, d), "doc_id", r"^卷\d+ (.*)", "^（")


@query("WITH " + LINES + ", h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^卷\\d+ .*') THEN regexp_extract(line, '^卷\\d+ (.*)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS volume FROM l), e AS (SELECT volume, unnest(string_split_regex(trim(line), '[\\s　]+')) AS entry FROM h WHERE NOT regexp_matches(line, '^卷\\d+ .*') AND trim(line) <> '') SELECT DISTINCT volume, entry FROM e WHERE entry <> '' AND volume IS NOT NULL")
def src_08_catalog(s, d):
    return S.catalog_entries(_lines(s, d), "doc_id", {"volume": r"^卷\d+ (.*)"}).where("volume is not null")


@query("WITH " + LINES + ", h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^卷\\d+ .*') THEN regexp_extract(line, '^卷\\d+ (.*)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM l), p AS (SELECT doc_id, i, heading, unnest(regexp_extract_all(line, '([一-鿿]{2,5})', 1)) AS phrase FROM h WHERE NOT regexp_matches(line, '^卷\\d+ .*') AND trim(line) <> '' AND heading IS NOT NULL) SELECT phrase, arg_min(heading, doc_id * 1000000 + i) AS heading FROM p GROUP BY phrase")
def src_09_phrase_headings(s, d):
    return S.phrase_headings(_lines(s, d), "doc_id", r"^卷\d+ (.*)")


@query("SELECT kind AS file, CAST(i - 1 AS INTEGER) AS i, s[i] AS line FROM (SELECT kind, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT kind, string_split_regex(string_agg(coalesce(text, ''), chr(10) ORDER BY item_id) || chr(10), '\\r?\\n') AS s FROM eval_item GROUP BY kind))")
def src_10_text_files(s, d):
    """Lines of several text files, one for each kind of item, with their file and place."""
    st = Stage(s, "text")
    items = table(s, d, "eval_item").select("kind", "item_id", F.coalesce("text", F.lit("")).alias("text"))
    items.repartition("kind").sortWithinPartitions("kind", "item_id").select("kind", "text").write.partitionBy("kind").text(f"{st.root}/x")
    return S.text_files(s, f"{st.root}/x/*/*.txt").select(F.regexp_extract("file", r"kind=(\w+)", 1).alias("file"), "i", "line")


def _local_folder(s, name: str) -> str:
    """A folder for formats that are one local file; executors must see the shared folder as a file system."""
    root = Stage(s, name).root
    if "://" in root and not root.startswith("file://"):
        raise ValueError("this format needs a shared folder that is mounted as a file system")
    path = root.removeprefix("file://")
    os.makedirs(path)
    return path


@query("SELECT CAST(ref_id AS BIGINT) AS ref_id, entry FROM canon_value WHERE field_name = '花名' ORDER BY ref_id")
def src_11_sqlite(s, d):
    """A table of a SQLite file, read by ranges of rows in parallel, with projection and order."""
    path = f"{_local_folder(s, 'sqlite')}/x.db"
    rows = table(s, d, "canon_value").select("ref_id", "field_name", "entry").collect()  # the reference list is fixed and small
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE canon (ref_id INTEGER PRIMARY KEY, field_name TEXT, entry TEXT)")
        db.executemany("INSERT INTO canon VALUES (?, ?, ?)", [tuple(r) for r in rows])
    return stores.read_sqlite(s, path, "canon").where("field_name = '花名'").select("ref_id", "entry").orderBy("ref_id")


def _matrix(s, d):
    """The whole table as shards of numpy matrices with their keys, written by the executors and read by ranges of rows."""
    path = _local_folder(s, "npy")
    stores.write_shards(table(s, d, "embeddings"), "vec_id", "embedding", path)
    return stores.read_shards(s, path).select(F.col("key").alias("vec_id"), F.round(F.col("vector")[0], 5).alias("first"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def src_15_matrix(s, d):
    return _matrix(s, d)


@query("SELECT 'checkpoint-20' AS folder")
def src_22_newest_checkpoint(s, d):
    names = [f"checkpoint-{r.ref_id % 20 + 1}" for r in table(s, d, "canon_value").select("ref_id").collect()]
    return s.createDataFrame([(S.newest_checkpoint(names),)], "folder string")


HTML = "'<div>' || name || '<br/>顏色：<b>' || coalesce(color, '') || '</b><br>產地:' || coalesce(origin, '?') || '</div><a href=\"https://x.invalid/SalePage/Index/' || id || '\">'"


@query("SELECT id, nullif(color, '') AS color, coalesce(nullif(origin, ''), NULL) AS origin FROM product WHERE origin IS NOT NULL AND origin <> '' AND color IS NOT NULL AND color <> ''")
def src_12_html_label_value(s, d):
    p = table(s, d, "product").where("origin is not null and origin <> '' and color is not null and color <> ''")
    html = F.expr(HTML)
    return p.select("id", S.label_value(html, "顏色").alias("color"), S.label_value(html, "產地").alias("origin"))


@query(r"SELECT id, coalesce(nullif(regexp_extract(url, '/SalePageCategory/(\d+)', 1), ''), nullif(regexp_extract(url, '/page/(\d+)', 1), ''), nullif(regexp_extract(url, '/SalePage/Index/(\d+)', 1), ''), 'unknown') AS key FROM category")
def src_13_url_key(s, d):
    return table(s, d, "category").select("id", S.url_key(F.col("url")).alias("key"))


@query("SELECT id FROM product WHERE trim(coalesce(image_url, '')) <> '' AND coalesce(trim(image_local_path), '') = '' ORDER BY id LIMIT 20")
def src_14_work_list(s, d):
    """What is left to fetch, limited after the filter."""
    todo = table(s, d, "product").where("trim(coalesce(image_url, '')) <> '' and coalesce(trim(image_local_path), '') = ''")
    return todo.orderBy("id").limit(20).select("id")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0")
def src_15_vectors_not_cached(s, d):
    """Rows whose vector a stored table lacks: validity by keys, not by the number of rows."""
    st = Stage(s, "vectors")
    e = table(s, d, "embeddings")
    kept = st.write(e.where("vec_id % 7 <> 0").select("vec_id", "embedding"), "cache")
    return e.join(kept.select("vec_id"), "vec_id", "left_anti").select("vec_id")


@query("SELECT * FROM (VALUES ('sky', '云'), ('sky', '月'), ('land', '山')) v(dim, keyword)")
def src_16_config(s, d):
    st = Stage(s, "config")
    s.createDataFrame([('{"_note": "x", "sky": ["云", "月"], "land": ["山"]}',)], "value string").coalesce(1).write.text(f"{st.root}/x")
    c = S.read_config(s, f"{st.root}/x/*.txt")
    return s.createDataFrame([(k, w) for k, ws in c.items() for w in ws], "dim string, keyword string")


@query("SELECT field_name AS category, entry AS term FROM canon_value WHERE entry IS NOT NULL")
def src_20_script_vocabulary(s, d):
    """A vocabulary that a script assigns to a name, read without running the script."""
    st = Stage(s, "script")
    words: dict[str, list[str]] = {}
    for r in table(s, d, "canon_value").where("entry is not null").select("field_name", "entry").collect():  # the reference list is fixed and small
        words.setdefault(r.field_name, []).append(r.entry)
    script = f"import os\n\nWORDS = {words!r}\n\nif __name__ == '__main__':\n    raise SystemExit(1)\n"
    s.createDataFrame([(script,)], "value string").coalesce(1).write.text(f"{st.root}/x")
    return S.script_vocabulary(s, f"{st.root}/x/*.txt", "WORDS")


@query("SELECT ref_id FROM canon_value WHERE entry NOT IN ('霜铃花', '月络兰', '正月')")
def src_18_stop_words(s, d):
    st = Stage(s, "words")
    s.createDataFrame([("# comment",), ("霜铃花",), (" 月络兰 ",), ("",)], "value string").coalesce(1).write.text(f"{st.root}/x")
    w = S.read_words(s, f"{st.root}/x", ["正月"])
    return table(s, d, "canon_value").join(w, F.col("entry") == F.col("word"), "left_anti").select("ref_id")


@query("SELECT * FROM (VALUES ('云', '天文', 1.0::DOUBLE), ('月', '天文', 2.0::DOUBLE), ('溪', '地理', 1.0::DOUBLE)) v(term, category, weight)")
def src_19_inline_lexicon(s, d):
    return S.lexicon_table(s, {"天文": {"云": 1, "月": 2}, "地理": {"溪": 1, "云": 5}})


@query("SELECT item_id, 'len ' || length(text) AS answer, CAST(1 AS INTEGER) AS provider FROM eval_item")
def src_21_client_with_fallback(s, d):
    def broken(prompts):
        raise RuntimeError("unreachable")

    return S.ask(table(s, d, "eval_item"), "item_id", "text", [broken, lambda ps: [f"len {len(p)}" for p in ps]])


# --- sinks


@query("SELECT id, name, coalesce(n.price, p.price) AS price FROM (SELECT id, name, price FROM product WHERE id % 4 <> 0) p LEFT JOIN (SELECT id, price * 2 AS price FROM product WHERE id % 2 = 0) n USING (id) UNION ALL SELECT id, name, price * 2 FROM product WHERE id % 4 = 0")
def sink_03_upsert(s, d):
    p = table(s, d, "product").select("id", "name", "price")
    incoming = p.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.col("name")).alias("name"), (F.col("price") * 2).alias("price"))
    return R.upsert(p.where("id % 4 <> 0"), incoming, ["id"])


@query("SELECT ID FROM review_tool WHERE coalesce(trim(赏析), '') = ''")
def sink_04_unfinished(s, d):
    t = table(s, d, "review_tool")
    return K.unfinished(t.select("ID"), t.select("ID", F.col("赏析").alias("result")), "ID", "result")


@query("""SELECT id, '{' || concat_ws(',', '"name":' || to_json(name), '"level":' || level) || '}' AS document FROM category""")
def sink_06_json_documents(s, d):
    return K.to_json_documents(table(s, d, "category").select("id", "name", "level"), "id")


LAST = "(SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)"


@query(f"SELECT c.c_custkey, coalesce((SELECT v FROM {LAST} WHERE user_id = c_custkey AND event_type = 'click'), c.c_acctbal) AS c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM {LAST} WHERE user_id = c_custkey AND event_type = 'error' AND v > 50)")
def sink_09_edit_log(s, d):
    """The last click sets the balance, an error above 50 deletes the row, other fields are not allowed."""
    e = table(s, d, "events")
    f = F.when(F.col("event_type") == "click", "c_acctbal").when(F.col("event_type") == "error", "__deleted").otherwise(F.col("event_type"))
    log = e.select(F.col("user_id").alias("c_custkey"), f.alias("field"), F.when(f == "__deleted", (F.col("value") > 50).cast("string")).otherwise(F.col("value").cast("string")).alias("value"), "event_id")
    return K.apply_edits(table(s, d, "customer").select("c_custkey", "c_acctbal"), log, "c_custkey", "field", "value", ["event_id"], ["c_acctbal"])


@query("SELECT max(TRY_CAST(ID AS BIGINT)) + 1 AS next_id FROM review_tool")
def sink_09_next_id(s, d):
    return K.next_id(table(s, d, "review_tool"), "ID")


@query("SELECT id, name FROM category")
def sink_02_versions(s, d):
    """Two versions are written; the first one stays as it was."""
    base = Stage(s, "versions").root
    c = table(s, d, "category").select("id", "name")
    first = K.write_version(c, base)
    K.write_version(s.read.parquet(first).where("id < 10"), base)
    return s.read.parquet(first)


@query("SELECT id, name FROM category WHERE level = 1")
def sink_07_dry_run(s, d):
    return K.report(table(s, d, "category").where("level = 1").select("id", "name"), None)


@query("SELECT 0::BIGINT AS differing")
def sink_08_model_round_trip(s, d):
    """A fitted model is written and loaded again; its predictions stay the same."""
    from pyspark.ml import PipelineModel

    from ..operators import models as M

    x = M.vectors(table(s, d, "embeddings"), "embedding").select("vec_id", "features", (F.col("label") % 2).cast("double").alias("y"), F.lit(1.0).alias("weight"))
    model, path = M.logistic(5).fit(x), f"{Stage(s, 'model').root}/m"
    model.write().overwrite().save(path)
    a, b = model.transform(x).select("vec_id", F.col("p").alias("a")), PipelineModel.load(path).transform(x).select("vec_id", F.col("p").alias("b"))
    return a.join(b, "vec_id").agg(F.count_if(F.col("a") != F.col("b")).alias("differing"))
