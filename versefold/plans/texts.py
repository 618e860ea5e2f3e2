"""Text-mining dataflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators import lexicon as L
from ..operators import relational as R
from ..operators import text_stats as T
from ..session import spread, table
from . import lexicons as W
from .aggregates import LONG, TOK, counts
from .registry import query
from .scalars import BASE_NAME


def n(name="n"):
    return F.count(F.lit(1)).alias(name)


def _texts(s, d):
    return spread(table(s, d, "documents").where("text is not null").select("doc_id", "text"))


def rows_sql(pairs, names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in p) + ")" for p in pairs) + f") v({names})"


SAMPLE = """WITH b AS (SELECT ID, 月份, 月份数字, 花名, 朝代, coalesce(length(赏析), 0) AS c, coalesce(length(正文), 0) AS t FROM review_tool),
l1 AS (SELECT ID, 1 AS layer, c AS o FROM (SELECT ID, c, row_number() OVER (PARTITION BY 月份 ORDER BY c DESC, ID) AS r FROM b WHERE 月份 IN ('正月','二月','三月','四月','五月','六月','七月','八月','九月','十月','十一月','十二月')) WHERE r <= 200 // 12),
l2 AS (SELECT ID, 2 AS layer, -c AS o FROM (SELECT ID, c, row_number() OVER (PARTITION BY 花名 ORDER BY c DESC, ID) AS r FROM b WHERE 花名 IS NOT NULL AND 花名 NOT IN (SELECT 花名 FROM b JOIN l1 USING (ID) WHERE 花名 IS NOT NULL)) WHERE r = 1),
l3 AS (SELECT ID, 3 AS layer, -c AS o FROM (SELECT ID, c, row_number() OVER (PARTITION BY 朝代 ORDER BY c DESC, ID) AS r FROM b WHERE 朝代 IS NOT NULL AND 朝代 NOT IN (SELECT 朝代 FROM b JOIN (SELECT ID FROM l1 UNION SELECT ID FROM l2) USING (ID) WHERE 朝代 IS NOT NULL)) WHERE r = 1),
u AS (SELECT ID, layer, -o AS o FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT ID, 4, t FROM b WHERE t < 20 UNION ALL SELECT ID, 5, 0 FROM b),
f AS (SELECT ID, min(layer) AS layer, min_by(o, layer) AS o FROM u GROUP BY ID)
SELECT ID, layer FROM (SELECT *, row_number() OVER (ORDER BY layer, o, md5(concat(ID, '42')), ID) AS r FROM f) WHERE r <= 200"""


@query(SAMPLE)
def text_01_stratified_sample(s, d):
    """A sample of 200 in layers: longest comment by month, of uncovered flowers, of uncovered dynasties, the shortest texts, and a seeded fill by hash."""
    months = ["正月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月"]
    b = table(s, d, "review_tool").select("ID", "月份", "花名", "朝代", F.coalesce(F.length("赏析"), F.lit(0)).alias("c"), F.coalesce(F.length("正文"), F.lit(0)).alias("t"))
    longest = [F.desc("c"), F.asc("ID")]
    l1 = R.top_k(b.where(F.col("月份").isin(*months)), ["月份"], longest, 200 // 12)
    l2 = R.top_k(b.where(F.col("花名").isNotNull()).join(l1.select("花名").distinct(), "花名", "left_anti"), ["花名"], longest, 1)
    so_far = l1.select("ID", "朝代").union(l2.select("ID", "朝代"))
    l3 = R.top_k(b.where(F.col("朝代").isNotNull()).join(so_far.select("朝代").distinct(), "朝代", "left_anti"), ["朝代"], longest, 1)
    layers = [x.select("ID", F.lit(i).alias("layer"), o.alias("o")) for i, x, o in ((1, l1, -F.col("c")), (2, l2, -F.col("c")), (3, l3, -F.col("c")), (4, b.where("t < 20"), F.col("t")), (5, b, F.lit(0)))]
    u = layers[0]
    for x in layers[1:]:
        u = u.union(x)
    first = u.groupBy("ID").agg(F.min(F.struct("layer", "o")).alias("x")).select("ID", "x.layer", "x.o")
    return first.orderBy("layer", "o", F.md5(F.concat(F.coalesce("ID", F.lit("")), F.lit("42"))), "ID").limit(200).select("ID", "layer")


@query(f"SELECT doc_id, len({TOK}) AS n, array_to_string(list_slice({TOK}, 1, 5), ' ') AS first FROM documents WHERE text IS NOT NULL")
def text_02_tokens(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("first"))


TFIDF = f"""WITH {LONG}, nd AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT term, ln((1 + n) / (1.0::DOUBLE + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), nd WHERE df >= 2 AND df <= 0.85 * n ORDER BY total DESC, term LIMIT 300),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)), x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM w)
SELECT doc_id, term, round(score, 4) AS score FROM x"""


@query(TFIDF)
def text_03_tfidf(s, d):
    nd = table(s, d, "documents").where("text is not null").agg(n("n"))
    x = T.tfidf(counts(s, d), "doc_id", nd)
    return x.select("doc_id", "term", F.round("score", 4).alias("score"))


@query(f"SELECT doc_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM ({TFIDF})) WHERE rank <= 20")
def text_03_tfidf_top20(s, d):
    return R.top_k(text_03_tfidf(s, d), ["doc_id"], [F.desc("score"), F.asc("term")], 20)


@query()
def text_04_textrank(s, d):
    return T.textrank(_texts(s, d), "doc_id", T.tokens(F.col("text")))


@query(
    f"WITH d AS (SELECT genre, doc_id, list_distinct({TOK}) AS t FROM documents WHERE genre IS NOT NULL AND text IS NOT NULL), b AS (SELECT genre, term, count(*) AS n FROM (SELECT genre, unnest(t) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, sum(n) AS df FROM b GROUP BY 1 HAVING sum(n) >= 2), g AS (SELECT genre, count(*) AS ng FROM d GROUP BY 1) SELECT genre, term, n, round(log2(n * (SELECT count(*) FROM d) / (CAST(ng AS DOUBLE) * df)), 4) AS pmi FROM b JOIN f USING (term) JOIN g USING (genre)"
)
def text_05_pmi(s, d):
    x = T.pmi(table(s, d, "documents").where("text is not null"), "genre", "doc_id", T.tokens(F.col("text")))
    return x.select("genre", "term", "n", F.round("pmi", 4).alias("pmi"))


_NEG = ", ".join(f"'{x}'" for x in W.NEGATORS)
_EIGHT = rows_sql([(t, c, v) for c, ws in W.EIGHT.items() for t, v in ws.items()], "t, class, v")
_BEFORE = "(" + " OR ".join(f"coalesce(lag(t, {k}) OVER w IN ({_NEG}), false)" for k in (1, 2, 3)) + ")"


@query(
    f"WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS t, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text IS NOT NULL), sg AS (SELECT doc_id, t, CASE WHEN {_BEFORE} THEN -1 ELSE 1 END AS sign FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)), sm AS (SELECT doc_id, class, sum(sign * v) AS v FROM sg JOIN {_EIGHT} USING (t) GROUP BY 1, 2), wd AS (SELECT d.doc_id, "
    + ", ".join(f"round(coalesce(sum(v) FILTER (class = '{c}'), 0)::DOUBLE / greatest(any_value(length(text)), 1), 6) + 0.0 AS {c}" for c in W.EIGHT)
    + f" FROM documents d LEFT JOIN sm ON sm.doc_id = d.doc_id WHERE text IS NOT NULL GROUP BY d.doc_id) SELECT *, CASE WHEN {' AND '.join(f'{c} = 0' for c in W.EIGHT)} THEN NULL {' '.join(f'WHEN {c} = greatest({', '.join(W.EIGHT)}) THEN {chr(39)}{c}{chr(39)}' for c in W.EIGHT)} END AS best FROM wd"
)
def text_06_emotion_vector(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.split("text", "").alias("t"))
    v = L.negated_scores(F.col("t"), W.EIGHT, W.NEGATORS, 3)
    size = F.greatest(F.size("t"), F.lit(1))
    names = list(W.EIGHT)
    wide = t.select("doc_id", v.alias("v"), size.alias("n")).select("doc_id", *[F.round(F.col(f"v.{x}") / F.col("n"), 6).alias(x) for x in names])
    from ..operators.retrieval import arg_max

    nothing = sum((F.abs(F.col(x)) for x in names[1:]), F.abs(F.col(names[0]))) == 0
    return wide.withColumn("best", F.when(~nothing, arg_max([(x, F.col(x)) for x in names])))  # no hit: no label


C3, C2 = list(dict.fromkeys(W.FEELINGS.values())), list(dict.fromkeys(W.PARENT.values()))
_MARKS = r"[\s，。！？；、：“”‘’（）《》【】·—…]"
_STEPS = "|".join([*W.NEGATORS, *sorted(W.FEELINGS, key=lambda x: (-len(x), x))])
_BAND = 0.002


def _feelings_sql(column: str) -> str:
    """A CTE pair for one text column: steps and summed classes over the text's length."""
    steps = f"regexp_extract_all({column}, '(?s){_STEPS}|.')"
    return f"""s_{column} AS (SELECT ID, {steps} AS s, length({column}) AS n FROM clean), h_{column} AS (SELECT ID, s[i] AS term, CASE WHEN coalesce(s[i - 1] IN ({_NEG}), false) OR coalesce(s[i - 2] IN ({_NEG}), false) THEN -1 ELSE 1 END AS sign, n FROM (SELECT ID, s, n, unnest(range(1, len(s) + 1)) AS i FROM s_{column})),
c_{column} AS (SELECT ID, {", ".join(f"round(coalesce(sum(sign * length(term)) FILTER (class = '{c}'), 0)::DOUBLE / greatest(any_value(n), 1), 6) AS {c}" for c in C3)}, count(*) AS k FROM h_{column} JOIN {rows_sql(list(W.FEELINGS.items()), "term, class")} USING (term) GROUP BY ID)"""


_BLEND = ", ".join(f"round(0.6::DOUBLE * coalesce(p.{c}, 0) + 0.4::DOUBLE * coalesce(q.{c}, 0), 6) AS {c}" for c in C3)
_C2_SQL = ", ".join(f"round({' + '.join(c for c in C3 if W.PARENT[c] == x)}, 6) AS {x}" for x in C2)


@query(
    rf"WITH clean AS (SELECT ID, regexp_replace(coalesce(正文, ''), '{_MARKS}', '', 'g') AS poem, coalesce(赏析, '') AS comment FROM review_tool), {_feelings_sql('poem')}, {_feelings_sql('comment')}, bl AS (SELECT r.ID, {_BLEND}, coalesce(p.k, 0) AS poem_words, coalesce(q.k, 0) AS comment_words FROM clean r LEFT JOIN c_poem p ON p.ID = r.ID LEFT JOIN c_comment q ON q.ID = r.ID), up AS (SELECT *, {_C2_SQL} FROM bl), si AS (SELECT *, round({' + '.join(W.POSITIVE_SIDE)}, 6) AS positive, round({' + '.join(W.NEGATIVE_SIDE)}, 6) AS negative FROM up) SELECT ID, {', '.join(C3)}, {', '.join(C2)}, positive, negative, CASE WHEN abs(positive - negative) < {_BAND} THEN 'neutral' WHEN positive > negative THEN 'positive' ELSE 'negative' END AS polarity, CASE {' '.join(f'WHEN {c} = greatest({', '.join(C3)}) THEN {chr(39)}{c}{chr(39)}' for c in C3)} END AS dominant, poem_words, comment_words FROM si"
)
def text_07_longest_match_polarity(s, d):
    """Three levels of feeling of a poem and its comment, blended 0.6 and 0.4.

    Each text is read in steps: a negation, the longest term at a place, or one character. A term counts its length over
    the text's length, negative where one of the two steps before is a negation. Finest classes add up to their parents,
    those to two sides; sides nearer than a band are neutral. Comments are read by characters too, without a segmenter.
    """
    heads = F.create_map(*[F.lit(x) for kv in W.FEELINGS.items() for x in kv])
    r = table(s, d, "review_tool").select("ID", F.regexp_replace(F.coalesce("正文", F.lit("")), _MARKS, "").alias("poem"), F.coalesce("赏析", F.lit("")).alias("comment"))

    def scored(text):
        """STRUCT<hits ARRAY<STRUCT<class, w>>, n>: of one text, without leaving its row."""
        steps = F.regexp_extract_all(text, F.lit(f"(?s)({_STEPS}|.)"), F.lit(1))
        negation = lambda x: x.isin(*W.NEGATORS)

        def of(t):
            near = lambda i, k: F.coalesce((i >= k) & negation(F.get(t, i - k)), F.lit(False))
            each = F.transform(t, lambda x, i: F.struct(F.try_element_at(heads, x).alias("class"), (F.length(x) * F.when(near(i, 1) | near(i, 2), -1).otherwise(1)).alias("w")))
            return F.filter(each, lambda h: h["class"].isNotNull())

        return F.transform(F.array(steps), of)[0]

    t = r.select("ID", scored(F.col("poem")).alias("p"), F.length("poem").alias("np"), scored(F.col("comment")).alias("q"), F.length("comment").alias("nq"))

    def level(hits: str, n: str, name: str):
        total = F.aggregate(F.filter(hits, lambda h: h["class"] == name), F.lit(0), lambda a, h: a + h["w"])
        return F.round(total / F.greatest(F.col(n), F.lit(1)), 6)

    blend = t.select("ID", *[F.round(0.6 * level("p", "np", c) + 0.4 * level("q", "nq", c), 6).alias(c) for c in C3], F.size("p").cast("bigint").alias("poem_words"), F.size("q").cast("bigint").alias("comment_words"))
    total = lambda names: F.round(sum((F.col(c) for c in names[1:]), F.col(names[0])), 6)
    up = blend.select("*", *[total([c for c in C3 if W.PARENT[c] == x]).alias(x) for x in C2])
    si = up.select("*", total(W.POSITIVE_SIDE).alias("positive"), total(W.NEGATIVE_SIDE).alias("negative"))
    from ..operators.retrieval import arg_max

    gap = F.col("positive") - F.col("negative")
    polarity = F.when(F.abs(gap) < _BAND, "neutral").when(gap > 0, "positive").otherwise("negative")
    return si.select("ID", *C3, *C2, "positive", "negative", polarity.alias("polarity"), arg_max([(c, F.col(c)) for c in C3]).alias("dominant"), "poem_words", "comment_words")


PN = [(t, 1) for t in W.POSITIVE] + [(t, -1) for t in W.NEGATIVE]


@query(
    f"WITH c AS (SELECT doc_id, substr(text, i, 1) AS t, CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END AS b FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text IS NOT NULL)) SELECT doc_id, CAST(sum(CASE WHEN b IN ('不','无','莫','未','休','勿') THEN -w ELSE w END) AS BIGINT) AS score, count(*) AS hits FROM c JOIN {rows_sql(PN, 'term, w')} ON t = term GROUP BY doc_id"
)
def text_08_simple_sentiment(s, d):
    """Counts of single characters by two patterns for each polarity, in the scan's own stage."""
    t = table(s, d, "documents").where("text is not null")
    count = lambda chars, before="": F.regexp_count("text", F.lit(f"{before}[{''.join(chars)}]")).cast("bigint")
    negated = f"(?<=[{''.join(W.NEGATORS)}])"
    score = count(W.POSITIVE) - 2 * count(W.POSITIVE, negated) - count(W.NEGATIVE) + 2 * count(W.NEGATIVE, negated)
    return t.select("doc_id", score.alias("score"), count([*W.POSITIVE, *W.NEGATIVE]).alias("hits")).where("hits > 0")


CL = [(t, c) for c, ts in W.CLASSES.items() for t in ts] + [(t, c) for c, ts in W.SINGLES.items() for t in ts]


@query(
    f"WITH l AS (SELECT * FROM {rows_sql(CL, 'term, label')}), wt AS (SELECT label, 1 / log2(count(*) + 1) AS w FROM l GROUP BY label), g AS (SELECT doc_id, substr(text, i, k) AS term, CASE WHEN i > 1 THEN substr(text, i - 1, 1) ELSE '' END AS b FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE text IS NOT NULL), (VALUES (1), (2)) n(k) WHERE i + k <= length(text) + 1), sc AS (SELECT doc_id, label, sum(w) AS score FROM g JOIN l USING (term) JOIN wt USING (label) WHERE b NOT IN ('不','无','莫','非','未','休','勿') GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM sc) SELECT doc_id, CASE WHEN count(*) = 1 THEN max(label) ELSE 'Uncertain' END AS label FROM m WHERE abs(score - top) < 1e-9 GROUP BY doc_id"
)
def text_09_pseudo_label(s, d):
    """Terms of two characters and fourteen single ones, overlapping, each unless negated; the class of the greatest weighted count if it is one."""
    t = _texts(s, d)
    labels = list(W.CLASSES)
    every = lambda lists: [x for ts in lists.values() for x in ts]
    t = t.select("doc_id", *[L.terms_at_places(F.col("text"), every(lists), L.NEGATION).alias(c) for c, lists in (("two", W.CLASSES), ("one", W.SINGLES))])
    hits = lambda c: F.size(F.filter("two", lambda x: x.isin(*W.CLASSES[c]))) + F.size(F.filter("one", lambda x: x.isin(*W.SINGLES[c])))
    size = {c: len(W.CLASSES[c]) + len(W.SINGLES[c]) for c in labels}
    scores = F.array(*[F.struct((hits(c) / F.log2(F.lit(size[c] + 1.0))).alias("score"), F.lit(c).alias("label")) for c in labels])
    x = t.select("doc_id", scores.alias("s")).withColumn("top", F.array_max(F.transform("s", lambda v: v["score"]))).where("top > 0")
    best = x.select("doc_id", F.filter("s", lambda v: F.abs(v["score"] - F.col("top")) < 1e-9).alias("b"))
    return best.select("doc_id", F.when(F.size("b") == 1, F.col("b")[0]["label"]).otherwise("Uncertain").alias("label"))


def _greedy_terms(s, d, low: int, singles: bool):
    kept = [k for k in W.HEADINGS if low <= len(k) <= 5 or singles and len(k) == 1]
    terms = F.regexp_extract_all("text", F.lit(f"({L.trie_pattern(kept)})"), F.lit(1))
    return _texts(s, d).select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(n())


def _imagery(s, d):
    return L.greedy(_texts(s, d), "doc_id", "text", list(W.HEADINGS), 5, 2)


LONG_TERMS = "|".join(sorted((k for k in W.HEADINGS if len(k) > 1), key=lambda x: (-len(x), x)))
SHORT_TERMS = "".join(k for k in W.HEADINGS if len(k) == 1)


@query(
    f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LONG_TERMS}')) AS term FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{LONG_TERMS}', '-', 'g'), '[{SHORT_TERMS}]')) FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2"
)
def text_10_greedy_two_phase(s, d):
    """A place that no term of two characters or more covers takes its single character: one pattern, longest terms first."""
    return _greedy_terms(s, d, 2, True)


@query(f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LONG_TERMS}|[{SHORT_TERMS}]')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2")
def text_11_greedy_one_phase(s, d):
    return _greedy_terms(s, d, 1, False)


_HEADS = rows_sql(list(W.HEADINGS.items()), "term, heading")
MATCHES = f"""m AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LONG_TERMS}')) AS term FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{LONG_TERMS}', '-', 'g'), '[{SHORT_TERMS}]')) FROM documents WHERE text IS NOT NULL)),
by_heading AS (SELECT doc_id, heading, count(*) AS n FROM m JOIN {_HEADS} USING (term) GROUP BY 1, 2)"""


@query(f"WITH {MATCHES} SELECT doc_id, string_agg(heading, '、' ORDER BY n DESC, heading) AS headings, string_agg(heading || ':' || n, '|' ORDER BY n DESC, heading) AS frequency, string_agg('卷一/' || heading || '/词', '|' ORDER BY n DESC, heading) AS paths, any_value(raw) AS raw_words FROM by_heading JOIN (SELECT doc_id, string_agg(DISTINCT term, '|' ORDER BY term) AS raw FROM m GROUP BY doc_id) USING (doc_id) GROUP BY doc_id")
def text_12_imagery_table(s, d):
    heads = F.create_map(*[F.lit(x) for kv in W.HEADINGS.items() for x in kv])
    m = _imagery(s, d).withColumn("heading", F.try_element_at(heads, F.col("term")))
    by = m.groupBy("doc_id", "heading").agg(n(), F.min("pos").alias("pos"))
    words = m.groupBy("doc_id").agg(R.sorted_text("term", "|").alias("raw_words"))
    x = by.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "heading"))).alias("x"))
    return x.join(words, "doc_id").select("doc_id", F.array_join(F.transform("x", lambda v: v["heading"]), "、").alias("headings"), F.array_join(F.transform("x", lambda v: F.concat_ws(":", v["heading"], (-v["m"]).cast("string"))), "|").alias("frequency"), F.array_join(F.transform("x", lambda v: F.concat(F.lit("卷一/"), v["heading"], F.lit("/词"))), "|").alias("paths"), "raw_words")


def _rule_sql():
    out = []
    for r in W.RULES:
        t = " + ".join(f"CASE WHEN contains(text, '{x}') THEN {r['weight']}::DOUBLE ELSE 0 END" for x in r["triggers"])
        p = " + ".join(f"CASE WHEN regexp_matches(text, '{x}') THEN 1.2::DOUBLE * {r['weight']} ELSE 0 END" for x in r["patterns"])
        out.append(f"SELECT doc_id, '{r['label']}' AS label, {t} + {p} AS score FROM documents WHERE text IS NOT NULL")
    return "SELECT doc_id, label, score, least(score / 4, 1) AS confidence FROM (SELECT doc_id, label, round(score, 4) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM (" + " UNION ALL ".join(out) + ")) WHERE r = 1 AND score > 0"


@query(_rule_sql())
def text_13_rule_labels(s, d):
    t = table(s, d, "documents").where("text is not null")
    best = F.array_sort(F.transform(L.rule_scores(F.col("text"), W.RULES), lambda x: F.struct((-x["score"]).alias("m"), x["label"].alias("label"))))[0]
    x = t.select("doc_id", best.alias("b"))
    return x.select("doc_id", F.col("b.label").alias("label"), F.round(-F.col("b.m"), 4).alias("score")).where("score > 0").withColumn("confidence", F.least(F.col("score") / 4, F.lit(1.0)))


@query(
    rf"WITH m AS (SELECT DISTINCT p.supplier_id, c.entry, p.id, p.name FROM product p JOIN (SELECT DISTINCT entry FROM canon_value WHERE field_name = '花名') c ON contains(p.name, c.entry)), o AS (SELECT supplier_id, {BASE_NAME} AS entry, id, name FROM product WHERE name IS NOT NULL AND id NOT IN (SELECT id FROM m)), e AS (SELECT *, 'listed' AS kind FROM m UNION ALL SELECT *, 'supplier only' FROM o WHERE entry <> '') SELECT supplier_id, entry, kind, count(*) AS n, string_agg(name, '|' ORDER BY id) FILTER (r <= 8) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY supplier_id, kind, entry ORDER BY id) AS r FROM e) GROUP BY 1, 2, 3"
)
def text_14_coverage(s, d):
    """Flowers of the list by supplier with up to eight examples, and beside them the suppliers' varieties that no listed flower names."""
    t = table(s, d, "canon_value").where("field_name = '花名'").select(F.col("entry").alias("term")).distinct()
    p = table(s, d, "product").select("id", "supplier_id", "name")
    found = R.contains_join(p, "id", ["name"], t, "term")
    listed = found.join(p, "id").select("supplier_id", F.col("term").alias("entry"), F.lit("listed").alias("kind"), "id", "name")
    other = p.where("name is not null").join(found.select("id").distinct(), "id", "left_anti").select("supplier_id", X.base_name(F.col("name")).alias("entry"), F.lit("supplier only").alias("kind"), "id", "name").where("entry <> ''")
    m = listed.unionByName(other)
    by = ["supplier_id", "kind", "entry"]
    total = m.groupBy(*by).agg(n())
    ex = R.top_k(m, by, [F.asc("id")], 8).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("x"))
    same = [total[c].eqNullSafe(ex[c]) for c in by]
    return total.join(ex, same[0] & same[1] & same[2]).select(total["supplier_id"], total["entry"], total["kind"], "n", F.array_join(F.transform("x", lambda v: v["name"]), "|").alias("examples"))


@query("SELECT item_id, array_to_string(list_slice(list_concat(list_filter(u, lambda x: x IN ('月', '云', '霜')), list_filter(u, lambda x: x NOT IN ('月', '云', '霜'))), 1, 12), '') AS pool FROM (SELECT item_id, list_transform(list_filter(range(1, len(x) + 1), lambda i: list_position(x, x[i]) = i), lambda i: x[i]) AS u FROM (SELECT item_id, string_split(text, '') AS x FROM eval_item))")
def text_15_feature_pool(s, d):
    """Ordered union of two lists, guide words first, cut at a size."""
    t = table(s, d, "eval_item").select("item_id", F.array_distinct(F.split("text", "")).alias("u"))
    guide = lambda x: x.isin("月", "云", "霜")
    return t.select("item_id", F.array_join(F.slice(F.concat(F.filter("u", guide), F.filter("u", lambda x: ~guide(x))), 1, 12), "").alias("pool"))


@query("SELECT ref_id, array_to_string(flatten(list_transform([entry, field_name], lambda t: CASE WHEN t = entry THEN list_concat(list_concat([t], other_names), [t, t, t]) ELSE [t] END)), ' ') AS boosted FROM canon_value")
def text_16_term_expansion(s, d):
    t = table(s, d, "canon_value")
    syn = F.coalesce("other_names", F.array().cast("array<string>"))
    x = F.flatten(F.transform(F.array("entry", "field_name"), lambda w: F.when(w == F.col("entry"), F.concat(F.array(w), syn, F.array_repeat(w, 3))).otherwise(F.array(w))))
    return t.select("ref_id", F.array_join(x, " ").alias("boosted"))


DIMS = list(W.DIMENSIONS)


def catalog_categories(text):
    """ARRAY<STRING>: categories of the catalog paths that a text's terms lead to (a/category/b; each heading once)."""
    kept = sorted(W.HEADINGS)
    terms = F.regexp_extract_all(text, F.lit(f"({L.trie_pattern(kept)})"), F.lit(1))
    heads = F.create_map(*[F.lit(x) for kv in W.HEADINGS.items() for x in kv])
    paths = F.transform(F.array_distinct(F.transform(terms, lambda t: F.try_element_at(heads, t))), lambda h: F.concat(F.lit("卷一/"), h, F.lit("/词")))
    return F.transform(F.filter(F.transform(paths, lambda p: F.split(p, "/")), lambda p: F.size(p) >= 3), lambda p: p[1])


def dimension_columns(categories):
    """Nine counts of an array of categories."""
    count = lambda names: F.size(F.filter(categories, lambda x: x.isin(*names)))
    return [count(W.DIMENSIONS[k]).alias(k) for k in DIMS]


def dimension_counts(docs):
    """doc_id and the nine counts of its text."""
    return docs.select("doc_id", catalog_categories(F.col("text")).alias("c")).select("doc_id", *dimension_columns(F.col("c")))


def idf_vectors(counts):
    """The rows with the nine counts times ln(N / max(1, df)), of length 1; zero vectors stay. The statistics are one row."""
    other = [c for c in counts.columns if c not in DIMS]
    idf = counts.agg(*[F.log(F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col(k) > 0))).alias(f"i_{k}") for k in DIMS])
    w = counts.crossJoin(F.broadcast(idf)).select(*other, *[(F.col(k) * F.col(f"i_{k}")).alias(k) for k in DIMS])
    norm = F.sqrt(sum((F.col(k) * F.col(k) for k in DIMS), F.lit(0.0)))
    return w.withColumn("n", norm).select(*other, *[F.when(F.col("n") > 0, F.col(k) / F.col("n")).otherwise(0.0).alias(k) for k in DIMS])


DIMENSION_SQL = (
    f"{MATCHES}, dc AS (SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (heading IN ({', '.join(repr(c) for c in cs)})) AS {k}" for k, cs in W.DIMENSIONS.items())
    + " FROM documents d LEFT JOIN by_heading h ON h.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id), di AS (SELECT "
    + ", ".join(f"ln(count(*) / greatest(1, count(*) FILTER ({k} > 0))::DOUBLE) AS i_{k}" for k in DIMS)
    + " FROM dc), dw AS (SELECT doc_id, "
    + ", ".join(f"{k} * i_{k} AS {k}" for k in DIMS)
    + " FROM dc, di), dn AS (SELECT *, sqrt("
    + " + ".join(f"{k} * {k}" for k in DIMS)
    + ") AS n FROM dw), dv AS (SELECT doc_id, "
    + ", ".join(f"CASE WHEN n > 0 THEN {k} / n ELSE 0 END AS {k}" for k in DIMS)
    + " FROM dn)"
)


@query(f"WITH {DIMENSION_SQL} SELECT doc_id, " + ", ".join(f"round({k}, 5) AS {k}" for k in DIMS) + " FROM dv")
def text_17_category_idf(s, d):
    v = idf_vectors(dimension_counts(_texts(s, d)))
    return v.select("doc_id", *[F.round(k, 5).alias(k) for k in DIMS])


@query("SELECT i.item_id, array_to_string(list_sort(list_intersect(list_distinct(string_split(i.text, '')), ['月', '云', '霜', '雪', '灯'])), '|') AS confirmed FROM eval_item i")
def text_18_confirmed(s, d):
    keep = F.array(*[F.lit(x) for x in ("月", "云", "霜", "雪", "灯")])
    return table(s, d, "eval_item").select("item_id", F.array_join(F.array_sort(F.array_intersect(F.array_distinct(F.split("text", "")), keep)), "|").alias("confirmed"))


_KEPT = [k for k in DIMS if k != "nature"]
_BEST = "CASE " + " ".join(f"WHEN {k} = greatest({', '.join(_KEPT)}) THEN '{k}'" for k in _KEPT) + " END"


@query(f"WITH {DIMENSION_SQL} SELECT doc_id, {_BEST} AS best FROM dc WHERE {' + '.join(_KEPT)} > 0")
def text_19_denoised_label(s, d):
    """The dominant one of the dimensions without a noisy one, recomputed; of equal ones the first. Texts of no other dimension have none."""
    from ..operators.retrieval import arg_max

    c = dimension_counts(table(s, d, "documents").where("text is not null"))
    return c.where(sum((F.col(k) for k in _KEPT), F.lit(0)) > 0).select("doc_id", arg_max([(k, F.col(k)) for k in _KEPT]).alias("best"))


@query(
    f"WITH t AS (SELECT item_id, {TOK} AS t FROM eval_item WHERE text IS NOT NULL), c AS (SELECT item_id, t, j, unnest(range(1, len(t) + 1)) AS i FROM (SELECT item_id, t, unnest(range(1, len(t) + 1)) AS j FROM t)), w AS (SELECT item_id, t[j] AS term, avg((1.0::DOUBLE / (1 + abs(i - j)) + 1.0::DOUBLE / (2 + abs(i - j))) / 2) AS w FROM c GROUP BY item_id, j, t[j]), m AS (SELECT item_id, term, round(max(w), 6) AS weight FROM w GROUP BY 1, 2) SELECT item_id, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, term) AS rank FROM m) WHERE rank <= 10"
)
def text_20_token_importance(s, d):
    """Mean of a matrix over heads and rows, the greatest weight of each token, the ten best. The matrices stand for a model's: two heads whose weights fall with the distance."""
    t = table(s, d, "eval_item").where("text is not null").select("item_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    place = F.sequence(F.lit(1), F.size("t"))
    head = lambda h: F.transform(place, lambda i: F.transform(place, lambda j: F.lit(1.0) / (h + F.abs(i - j))))
    x = T.token_importance(t.withColumn("heads", F.array(head(1), head(2))), "item_id", "t", "heads")
    return R.top_k(x.select("item_id", "term", F.round("weight", 6).alias("weight")), ["item_id"], [F.desc("weight"), F.asc("term")], 10)


MANUAL = [("云", "天文"), ("月", "天文"), ("溪云", "地理"), ("飞鸟", "禽鸟")]


@query(
    f"SELECT term, CASE WHEN a.h IS NOT NULL AND b.h IS NOT NULL THEN CASE WHEN a.h = b.h THEN 'agree' ELSE 'differ' END WHEN a.h IS NOT NULL THEN 'manual only' ELSE 'catalog only' END AS verdict FROM {rows_sql(MANUAL, 'term, h')} FULL OUTER JOIN {rows_sql(list(W.HEADINGS.items()), 'term, h').replace(') v(', ') w(')} USING (term)".replace("a.h", "v.h").replace("b.h", "w.h")
)
def text_21_three_way_coverage(s, d):
    a = s.createDataFrame(MANUAL, "term string, a string")
    b = s.createDataFrame(list(W.HEADINGS.items()), "term string, b string")
    v = F.when(F.col("a") == F.col("b"), "agree").when(F.col("a").isNotNull() & F.col("b").isNotNull(), "differ").when(F.col("a").isNotNull(), "manual only").otherwise("catalog only")
    rank = F.create_map(*[F.lit(x) for kv in (("differ", 0), ("agree", 1), ("manual only", 2), ("catalog only", 3)) for x in kv])
    return a.join(b, "term", "full_outer").select("term", v.alias("verdict")).orderBy(rank[F.col("verdict")], "term")


@query(f"WITH t AS (SELECT lang, unnest({TOK}) AS term FROM documents WHERE text IS NOT NULL) SELECT term, count(*) AS total, count(*) FILTER (lang = 'zh') AS in_zh, length(term) AS size, term IN (SELECT entry FROM canon_value) AS is_entry FROM t GROUP BY term HAVING count(*) >= 5")
def text_22_subset_frequency(s, d):
    t = table(s, d, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("term"))
    c = t.groupBy("term").agg(n("total"), F.count_if(F.col("lang") == "zh").alias("in_zh")).where("total >= 5")
    e = table(s, d, "canon_value").select(F.col("entry").alias("term"), F.lit(True).alias("e")).distinct()
    return c.join(R.small(e), "term", "left").select("term", "total", "in_zh", F.length("term").cast("bigint").alias("size"), F.coalesce("e", F.lit(False)).alias("is_entry"))
