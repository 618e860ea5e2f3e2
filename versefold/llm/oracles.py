"""SQL for the queries of this package that SQL can express over whole tables."""

from __future__ import annotations


def alnum(x: str) -> str:
    return rf"coalesce(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{Han}}]+', '', 'g'), '')"


def _field(label: str) -> str:
    names = "(?:诗名|作者|正文)"
    head = rf"(?s)(?:^|\|\|[ \t]*|[\n\t])[ \t]*(?:\[{label}\]|{label}[ \t]*[:：=＝])(.*?)"
    tail = rf"(?:[ \t]*(?:\|\||\n|\t)[ \t]*(?:\[{names}\]|{names}[ \t]*[:：=＝])|\z)"
    return f"""CASE WHEN regexp_matches(record, '^\\s*\\{{') THEN json_extract_string(TRY_CAST(record AS JSON), '$."{label}"') ELSE regexp_extract(record, '{head}{tail}', 1) END"""


HAS_BODY = r"regexp_matches(coalesce(正文, ''), '[^\s\p{Z}]')"
POEMS = f"""poems AS (SELECT ID AS key, {alnum("诗名")} AS title, {alnum("作者")} AS author, {alnum("正文")} AS body FROM review_tool WHERE {HAS_BODY}
UNION ALL SELECT raw_id, {alnum(_field("诗名"))}, {alnum(_field("作者"))}, {alnum(_field("正文"))} FROM poem_raw)"""

TEXTS = f"""t AS (SELECT ID, {alnum("诗名")} || {alnum("正文")} AS s FROM review_tool WHERE {HAS_BODY})"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {POEMS} SELECT first_key, key AS copy_key FROM (SELECT key, min(key) OVER (PARTITION BY title, author, body) AS first_key FROM poems) WHERE key <> first_key",
    "p3_collapsed": f"WITH {POEMS} SELECT min(key) AS first_key, count(*) AS n_copies FROM poems GROUP BY title, author, body",
    "p6_found": f"""WITH {TEXTS},
g AS (SELECT DISTINCT ID, substr(s, i, 3) AS g FROM (SELECT ID, s, unnest(range(1, greatest(length(s) - 1, 1))) AS i FROM t)), n AS (SELECT ID, count(*) AS n FROM g GROUP BY ID),
c AS (SELECT a.ID AS id_a, b.ID AS id_b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.ID < b.ID GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.ID = id_a JOIN n y ON y.ID = id_b WHERE k >= 0.6 * (x.n + y.n - k)
UNION SELECT a.ID, b.ID FROM t a JOIN t b ON a.s = b.s AND a.ID < b.ID WHERE a.s <> ''""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {alnum("text")} AS s FROM documents), e AS (SELECT item_id, {alnum("text")} AS s FROM eval_item),
i AS (SELECT DISTINCT item_id, substr(s, p, 30) AS r FROM (SELECT item_id, s, unnest(range(1, length(s) - 28)) AS p FROM e WHERE length(s) >= 30))
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, substr(s, p, 30) AS r FROM (SELECT doc_id, s, unnest(range(1, length(s) - 28)) AS p FROM d WHERE length(s) >= 30)) JOIN i USING (r)""",
}

_OPEN, _CLOSE = "（(〔\\[【", "）)〕\\]】"
_PLAIN = r"'[^\p{L}\p{N}\p{Han}]+'"

#: Components by recursion over the least ID; the reference list's dynasties make one pattern.
ORACLES["p1_found"] = f"""WITH RECURSIVE dy AS (SELECT string_agg(entry, '|' ORDER BY length(entry) DESC, entry) AS alt FROM canon_value WHERE field_name = '朝代'),
cut AS (SELECT ID, unnest(string_split_regex(coalesce(作者, ''), '\\s*[、，；;/／|&＆]\\s*')) AS x FROM review_tool),
bare AS (SELECT ID, CASE WHEN regexp_replace(regexp_replace(x, '[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]', ' ', 'g'), {_PLAIN}, '', 'g') = '' THEN x ELSE trim(regexp_replace(x, '[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]', ' ', 'g')) END AS x FROM cut),
named AS (SELECT ID, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(x, '^[\\s\\p{{Z}}]*(?:' || alt || ')[\\s\\p{{Z}}]*[·・•．.:：][\\s\\p{{Z}}]*', ''), '(?i)^[\\s\\p{{Z}}]*by[\\s\\p{{Z}}]+', '')), {_PLAIN}, '', 'g'), '^(\\p{{Han}}{{2,}})(?:撰|著|辑|譯|译)$', '\\1') AS name FROM bare, dy),
e AS (SELECT DISTINCT ID, 'a' || name AS ent FROM named WHERE name NOT IN ('', 'nan', 'none', 'null', '佚名', '未详', '无名氏', '未知', '不详') UNION SELECT ID, 'n' || regexp_replace(ID, '-\\d+$', '') FROM review_tool),
cc(id, comp) USING KEY (id) AS (SELECT ID, ID FROM review_tool UNION SELECT e2.ID, min(cc.comp) FROM cc JOIN e e1 ON cc.id = e1.ID JOIN e e2 ON e1.ent = e2.ent JOIN recurring.cc r ON r.id = e2.ID WHERE cc.comp < r.comp GROUP BY e2.ID)
SELECT id, comp AS group_id FROM cc WHERE comp IN (SELECT comp FROM cc GROUP BY comp HAVING count(*) > 1)"""

_ALPHA = r"\p{Latin}\p{Cyrillic}\p{Greek}"
_ALIKE = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝԍΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιγνορυκ"
_ODD = r"[\x{a0}\x{ad}\x{2000}-\x{200f}\x{202a}-\x{202f}\x{205f}-\x{2064}\x{2066}-\x{2069}\x{3000}\x{feff}\x{fe00}-\x{fe0f}\x{300}-\x{36f}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{2f00}-\x{2fdf}\x{f900}-\x{faff}ɑɡı]"
_EMOJI = r"[\x{1f300}-\x{1faff}\x{2600}-\x{27bf}]"
_CELL = rf"regexp_replace(regexp_replace(v, '({_EMOJI})\x{{fe0f}}', '\1', 'g'), '({_EMOJI})\x{{200d}}({_EMOJI})', '\1\2', 'g')"

#: The same cells by character classes: odd characters outside emoji, neighbours of two scripts, words all of look-alikes.
ORACLES["p2_found"] = rf"""WITH c AS (SELECT 'review_tool' AS table_name, ID AS row_key, '正文' AS field_name, 正文 AS v FROM review_tool UNION ALL SELECT 'product', CAST(id AS VARCHAR), 'name', name FROM product UNION ALL SELECT 'category', CAST(id AS VARCHAR), 'name', name FROM category),
n AS (SELECT table_name, row_key, field_name, {_CELL} AS v FROM c WHERE v IS NOT NULL)
SELECT table_name, row_key, field_name FROM n WHERE regexp_matches(v, '{_ODD}') OR regexp_matches(v, '\p{{Latin}}[\p{{Cyrillic}}\p{{Greek}}]|[\p{{Cyrillic}}\p{{Greek}}]\p{{Latin}}|\p{{Cyrillic}}\p{{Greek}}|\p{{Greek}}\p{{Cyrillic}}') OR regexp_matches(v, '(?:^|[^{_ALPHA}])[{_ALIKE}]+(?:$|[^{_ALPHA}])')"""

#: Classes of equal texts, their links by shared runs of three, and components by recursion over the smallest key.
_CLASSES = f"""{TEXTS}, r AS (SELECT s, min(ID) AS rep FROM t WHERE s <> '' GROUP BY s),
g AS (SELECT DISTINCT rep, substr(s, i, 3) AS g FROM (SELECT rep, s, unnest(range(1, greatest(length(s) - 1, 1))) AS i FROM r)), n AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
c AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT x AS representative_a, y AS representative_b FROM c JOIN n p ON p.rep = x JOIN n q ON q.rep = y WHERE k >= 0.6 * (p.n + q.n - k))"""
ORACLES["p6_links"] = f"WITH {_CLASSES} SELECT * FROM links"
ORACLES["p6_grouped"] = f"""WITH RECURSIVE {_CLASSES}, arc AS MATERIALIZED (SELECT representative_a AS u, representative_b AS v FROM links UNION ALL SELECT representative_b, representative_a FROM links),
cc(id, comp) USING KEY (id) AS (SELECT rep, rep FROM r UNION SELECT v, min(cc.comp) FROM cc JOIN arc ON cc.id = u JOIN recurring.cc w ON w.id = v WHERE cc.comp < w.comp GROUP BY v)
SELECT t.ID AS key, r.rep AS representative, (SELECT count(*) FROM arc WHERE u = r.rep) AS n_links, comp AS group_id FROM t JOIN r USING (s) JOIN cc ON cc.id = r.rep"""
