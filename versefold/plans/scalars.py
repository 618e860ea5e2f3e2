"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.text import han_only
from ..operators import lexicon as L
from ..operators import retrieval as V
from ..operators.relational import small
from ..session import table
from .registry import query


@query("SELECT doc_id, regexp_replace(text, '[^一-鿿]', '', 'g') AS han FROM documents")
def fn_01_han_only(s, d):
    return table(s, d, "documents").select("doc_id", han_only(F.col("text")).alias("han"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^一-鿿，。！？；：、]', ' ', 'g'), ' +', ' ', 'g')) AS clean FROM documents")
def fn_02_han_and_stops(s, d):
    return table(s, d, "documents").select("doc_id", X.han_and_stops(F.col("text")).alias("clean"))


@query("SELECT doc_id, regexp_replace(text, '[，。！？；：、“”‘’（）《》\\n\\r]', ' ', 'g') AS spaced FROM documents")
def fn_03_punctuation_to_space(s, d):
    return table(s, d, "documents").select("doc_id", X.unpunctuated(F.col("text")).alias("spaced"))


@query("SELECT ID, translate(诗名, '《》（）·', '') AS bare FROM review_tool")
def fn_04_strip_punctuation(s, d):
    return table(s, d, "review_tool").select("ID", X.without(F.col("诗名"), "《》（）·").alias("bare"))


@query(r"""SELECT ID, regexp_replace(replace(replace(regexp_replace(诗名, '[\s\x0b\p{Z}]+', '', 'g'), '（', '('), '）', ')'), '[·•・,，。;；:：!！?？"“”''‘’]', '', 'g') AS form FROM review_tool""")
def fn_05_match_form(s, d):
    return table(s, d, "review_tool").select("ID", X.match_form(F.col("诗名")).alias("form"))


_CUT = r"regexp_replace(regexp_replace(name, '(?s)[（(].*$', ''), '^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$', '', 'g')"
_BARE = rf"regexp_replace({_CUT}, '^(?:鮮花|葉材|配花|觀果|乾花|永生花|花器|花泥|包裝|工具)[\s\x0b\p{{Z}}]*[-－][\s\x0b\p{{Z}}]*', '')"


BASE_NAME = rf"regexp_replace(split_part(split_part({_BARE}, ' - ', 1), '－', 1), '^[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+$', '', 'g')"


@query(f"SELECT id, {BASE_NAME} AS base FROM product")
def fn_06_base_name(s, d):
    return table(s, d, "product").select("id", X.base_name(F.col("name")).alias("base"))


@query("SELECT ref_id, array_to_string(list_filter(CASE WHEN ends_with(entry, '花') THEN [entry, substr(entry, 1, length(entry) - 1)] ELSE [entry, entry || '花'] END, lambda x: length(x) >= 2), '|') AS forms FROM canon_value WHERE field_name = '花名'")
def fn_07_suffix_variants(s, d):
    return table(s, d, "canon_value").where("field_name = '花名'").select("ref_id", F.array_join(X.variants(F.col("entry")), "|").alias("forms"))


# The Traditional characters among the names of these tables, and below each its Simplified form; independent of the conversion that is tested.
_TRADITIONAL = "鈴絡蘭煙縷綿蓮羅鏡雲結繡風鐸綺紋曉絲嵐淚鶴頂蟬螢燈魚鱗龍鬚鳳龜綃樓盞層霧歸來聽階壺紅迴腸無臥榮臺涼綠黃藍純淺銀濃馬題詠農曆舊閏時間輯編檳種個兩條東後會長門開關書畫詩詞國學體點過還進遠運邊頭髮價師數氣熱現禮節紮薦藝裝親貨買賣選闆靚鮮鵝"
_SIMPLIFIED = "铃络兰烟缕绵莲罗镜云结绣风铎绮纹晓丝岚泪鹤顶蝉萤灯鱼鳞龙须凤龟绡楼盏层雾归来听阶壶红回肠无卧荣台凉绿黄蓝纯浅银浓马题咏农历旧闰时间辑编槟种个两条东后会长门开关书画诗词国学体点过还进远运边头发价师数气热现礼节扎荐艺装亲货买卖选板靓鲜鹅"


@query(f"SELECT id, translate(name, '{_TRADITIONAL}', '{_SIMPLIFIED}') AS simplified FROM product")
def fn_08_simplified(s, d):
    return table(s, d, "product").select("id", X.to_simplified(F.col("name")).alias("simplified"))


@query("SELECT ID, ref_id FROM review_tool JOIN (SELECT entry AS k, ref_id FROM canon_value WHERE field_name = '花名' UNION SELECT unnest(other_names), ref_id FROM canon_value WHERE field_name = '花名') ON replace(花名, ' ', '') = k")
def fn_09_alias_lookup(s, d):
    c = table(s, d, "canon_value").where("field_name = '花名'")
    alias = c.select(F.col("entry").alias("k"), "ref_id").union(c.select(F.explode("other_names").alias("k"), "ref_id")).distinct()
    return table(s, d, "review_tool").select("ID", F.replace(F.col("花名"), F.lit(" "), F.lit("")).alias("k")).join(small(alias), "k").select("ID", "ref_id")


@query(r"SELECT ID, nullif(regexp_extract(作者, '^\s*[〔\[（(]?(前昱|后昱|昱|东澹|西澹|澹|瑄)[〕\]）)]?\s*[·• ]?\s*([^\s，。、；·（）()\[\]〔〕]{1,8})\s*$', 1), '') AS dynasty, nullif(regexp_extract(作者, '^\s*[〔\[（(]?(前昱|后昱|昱|东澹|西澹|澹|瑄)[〕\]）)]?\s*[·• ]?\s*([^\s，。、；·（）()\[\]〔〕]{1,8})\s*$', 2), '') AS author FROM review_tool")
def fn_10_dynasty_author(s, d):
    a, b = X.dynasty_author(F.col("作者"), ["昱", "前昱", "后昱", "澹", "东澹", "西澹", "瑄"])
    return table(s, d, "review_tool").select("ID", a.alias("dynasty"), b.alias("author"))


@query(r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL), g AS (SELECT *, list_filter(string_split_regex(line, '[，。！？；、]'), lambda x: length(x) > 0) AS seg FROM l) SELECT doc_id, count(*) FILTER (len(seg) > 0 AND list_max(list_transform(seg, lambda x: length(x))) <= 12 AND list_sum(list_transform(seg, lambda x: length(x))) / CAST(len(seg) AS DOUBLE) <= 8 AND NOT regexp_matches(line, '[（(【\[]') AND NOT regexp_matches(line, '^(?:何以|此处|结处|起句|或云|注|按)')) AS verses FROM g GROUP BY doc_id")
def fn_11_verse_lines(s, d):
    l = table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))
    return l.select("doc_id", F.size(F.filter("l", lambda x: F.coalesce(X.is_verse(x), F.lit(False)))).cast("bigint").alias("verses"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^。！？\n]*[。！？]|[^。！？\n]+'), lambda x: regexp_replace(x, '^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$', '', 'g')), lambda x: length(x) >= 4), '¦') AS parts FROM documents")
def fn_12_sentences(s, d):
    """Documents of every language, also of none."""
    return table(s, d, "documents").select("doc_id", F.array_join(X.sentences(F.col("text")), "¦").alias("parts"))


# Sentences with any of these are dropped; the byline that may end a text.
DROPPED = [
    "何逊是|梁天监|驻扬州|建安王|水曹|记室|行参军",
    "是(晚唐|初唐|盛唐|中唐|北宋|南宋|南朝|北朝|元|明|清)诗人[，。]|他的诗在当时|诗人。他的诗",
    "生于|卒于|字[一-鿿]{1,3}[，。、]|号[一-鿿]{1,4}[，。]",
    "进士|官至|贬为|流寓|谪|靖康|安史|天宝|开元年间",
    "题为《|误加之题|为据|《初学记》|《艺文类聚》|《全唐诗》",
    "化自|引自|出自.*诗句|见《[^》]+》卷",
    "与[^。]{1,20}相比|不如[^。]{1,15}|胜于[^。]{1,15}",
    "收录于|收录在|版本|刻本|校勘",
    "美学家|评论家|学者.*谈到|黄震云|署名",
    "这首诗是[^。]{0,40}写的[。]",
    "文人专咏|时代较早|极负盛名[，。]",
]
BYLINE = r"[（(][一-鿿]{2,4}[）)]\s*$"
_SENTENCES = r"list_filter(list_transform(regexp_extract_all(赏析, '[^。！？\n\r]*[。！？]|[^。！？\n\r]+'), lambda x: regexp_replace(x, '^[\s\x0b\p{Z}]+|[\s\x0b\p{Z}]+$', '', 'g')), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '%s'))" % "|".join(f"(?:{p})" for p in DROPPED)


@query(rf"SELECT ID, regexp_replace(regexp_replace(CASE WHEN len({_SENTENCES}) > 0 THEN array_to_string({_SENTENCES}, '') ELSE 赏析 END, '{BYLINE}', ''), '^[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+$', '', 'g') AS kept FROM review_tool")
def fn_13_kept_sentences(s, d):
    """The comment without sentences of any of eleven patterns (the whole comment if none is left) and without a byline at its end."""
    return table(s, d, "review_tool").select("ID", X.trimmed(F.regexp_replace(X.kept_sentences(F.col("赏析"), DROPPED), BYLINE, "")).alias("kept"))


@query("SELECT doc_id, CAST((SELECT count(*) FROM (SELECT unnest(range(1, greatest(length(text), 1))) AS i) WHERE substr(text, i, 2) = '微雪' AND NOT (i > 1 AND contains('不无莫非未休勿', substr(text, i - 1, 1)))) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def fn_14_overlap_count_negated(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", L.overlap_count(F.col("text"), "微雪").alias("n"))


@query("SELECT genre, CAST(sum((length(text) - length(replace(text, '孤', '')))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY genre")
def fn_15_plain_count(s, d):
    return table(s, d, "documents").where("text is not null").groupBy("genre").agg(F.sum(F.regexp_count("text", F.lit("孤"))).cast("bigint").alias("n"))


@query("SELECT doc_id, length(text) AS n, substr(replace(text, chr(10), ' '), 1, 20) AS preview FROM documents")
def fn_16_length_preview(s, d):
    return table(s, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 20).alias("preview"))


@query("SELECT id, replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM product")
def fn_17_html_escape(s, d):
    return table(s, d, "product").select("id", X.escaped(F.col("name")).alias("html"))


@query("SELECT id, array_to_string(list_transform(string_split(lower(replace(category_type, '_', ' ')), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM category")
def fn_18_title_case(s, d):
    return table(s, d, "category").select("id", F.initcap(F.replace(F.col("category_type"), F.lit("_"), F.lit(" "))).alias("title"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract(TRY_CAST(props AS JSON), '$.k') AS BIGINT), -1) AS k FROM events")
def fn_19_json_decode(s, d):
    return table(s, d, "events").select("event_id", F.coalesce(X.json_or(F.col("props"), "k bigint", F.lit(None))["k"], F.lit(-1)).alias("k"))


@query("SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fn_20_json_from_answer(s, d):
    answer = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(s, d, "events").select("event_id", F.from_json(X.outer_json(answer), "k bigint")["k"].alias("k"))


@query(r"SELECT id, array_to_string(list_filter(list_transform(string_split_regex(spec_text, '[|｜、,，/]'), lambda x: trim(x)), lambda x: x <> ''), ';') AS items FROM product")
def fn_21_delimited_list(s, d):
    return table(s, d, "product").select("id", F.array_join(X.parts(F.col("spec_text"), "[|｜、,，/]"), ";").alias("items"))


@query("SELECT user_id, sum(CASE event_type WHEN 'click' THEN 1 ELSE 0 END)::INTEGER AS clicks FROM events GROUP BY user_id HAVING sum(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) > 0")
def fn_22_pairs_parse(s, d):
    c = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    text = c.groupBy("user_id").agg(F.array_join(F.collect_list(F.concat_ws(":", F.concat(F.lit("t:"), "event_type"), F.col("n").cast("string"))), "|").alias("t"))
    return text.select("user_id", F.try_element_at(X.pairs(F.col("t")), F.lit("t:click")).alias("clicks")).where("clicks is not null")


@query("SELECT id, CASE WHEN len(string_split(full_path, '/')) >= 3 THEN string_split(full_path, '/')[2] END AS level2 FROM category")
def fn_23_path_level(s, d):
    return table(s, d, "category").select("id", X.second_level(F.col("full_path")).alias("level2"))


SQ = "list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))"


@query(f"SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt({SQ}), 5) AS first, round(sqrt({SQ}), 5) AS norm FROM embeddings")
def fn_24_l2_normalise(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.unit(F.col("embedding"))[0], 5).alias("first"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_25_cosine(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 5).alias("c"))


@query("SELECT vec_id, len(embedding) + 6 AS n, 0.0::DOUBLE AS last FROM embeddings")
def fn_26_zero_pad(s, d):
    p = V.padded(F.col("embedding"), 70)
    return table(s, d, "embeddings").select("vec_id", F.size(p).cast("bigint").alias("n"), p[69].alias("last"))


@query("SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS best FROM (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings)")
def fn_27_arg_max_label(s, d):
    return table(s, d, "embeddings").select("vec_id", V.arg_max([(x, F.col("embedding")[i]) for i, x in enumerate("abc")]).alias("best"))


@query("SELECT vec_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 5) AS p FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)")
def fn_28_softmax(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(V.softmax(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 3))[0], 5).alias("p"))


@query("SELECT ref_id, array_to_string(list_slice(other_names, 1, 2), '、') AS preview FROM canon_value")
def fn_29_list_preview(s, d):
    return table(s, d, "canon_value").select("ref_id", F.array_join(F.slice("other_names", 1, 2), "、").alias("preview"))


@query(r"SELECT id, TRY_CAST(replace(nullif(regexp_extract(t, '(\d[\d,]*\.?\d*)', 1), ''), ',', '') AS DOUBLE) AS amount, CASE WHEN regexp_matches(t, 'HK\$|HKD') THEN 'HKD' WHEN regexp_matches(t, 'US\$|USD') THEN 'USD' WHEN regexp_matches(t, '[¥￥]|CNY|RMB') THEN 'CNY' END AS currency FROM (SELECT id, coalesce(currency, '') || ' ' || name AS t FROM product)")
def fn_30_price_text(s, d):
    t = F.concat(F.coalesce("currency", F.lit("")), F.lit(" "), "name")
    return table(s, d, "product").select("id", X.price(t).alias("amount"), X.currency(t).alias("currency"))


@query(r"SELECT ID, regexp_matches(ID, '^.+-\d{2}$') AS suffixed, regexp_replace(ID, '-\d{2}$', '') AS base FROM review_tool")
def fn_31_id_pattern(s, d):
    return table(s, d, "review_tool").select("ID", F.col("ID").rlike(r"^.+-\d{2}$").alias("suffixed"), F.regexp_replace("ID", r"-\d{2}$", "").alias("base"))
