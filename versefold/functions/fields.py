"""Scalar functions on single fields: cleaning, splitting, parsing and formatting, all in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .chinese import to_simplified_table, to_traditional_table


def _translated(c: Column, table: dict[int, str]) -> Column:
    return F.translate(c, "".join(map(chr, table)), "".join(table.values())) if table else c


def to_simplified(c: Column) -> Column:
    """Every Traditional character's Simplified form (see chinese.to_simplified_table)."""
    return _translated(c, to_simplified_table(SparkSession.active()))


def to_traditional(c: Column) -> Column:
    return _translated(c, to_traditional_table(SparkSession.active()))


# Marks that do not count when names are matched, and categories before a product's name.
DROPPED = "·•・,，。;；:：!！?？\"“”'‘’"
CATEGORIES = ("鮮花", "葉材", "配花", "觀果", "乾花", "永生花", "花器", "花泥", "包裝", "工具")


def han_and_stops(c: Column) -> Column:
    """Ideographs and sentence punctuation; other characters become single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^一-鿿，。！？；：、]", " "), " +", " "))


def unpunctuated(c: Column) -> Column:
    """Punctuation and line breaks become spaces."""
    return F.regexp_replace(c, r"[，。！？；：、“”‘’（）《》\n\r]", " ")


def without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def match_form(c: Column) -> Column:
    """For matching: no white space of any kind, round brackets of one width, no bullets, stops or quotes."""
    return F.regexp_replace(F.translate(F.regexp_replace(c, r"[\s\p{Z}]+", ""), "（）", "()"), f"[{DROPPED}]", "")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def base_name(c: Column) -> Column:
    """A product's name without a bracketed end, without a category and dash before it, up to the next ` - ` or `－`."""
    cut = trimmed(F.regexp_replace(c, r"(?s)[（(].*$", ""))
    cut = F.regexp_replace(cut, rf"^(?:{'|'.join(CATEGORIES)})[\s\p{{Z}}]*[-－][\s\p{{Z}}]*", "")
    return trimmed(F.regexp_replace(F.regexp_replace(cut, r"(?s) - .*$", ""), r"(?s)－.*$", ""))


def variants(c: Column, suffix: str = "花") -> Column:
    """A token with and without a suffix, two characters or more, each once."""
    bare = F.regexp_replace(c, f"{suffix}$", "")
    return F.array_distinct(F.filter(F.array(c, bare, F.concat(bare, F.lit(suffix))), lambda x: F.length(x) >= 2))


def dynasty_author(c: Column, dynasties: Sequence[str]) -> tuple[Column, Column]:
    """(dynasty, author) of `dynasty·author` or `[dynasty] author`; null where there is no such pattern. Longest dynasty first."""
    alt = "|".join(sorted(dynasties, key=lambda x: (-len(x), x)))
    p = rf"^\s*[〔\[（(]?({alt})[〕\]）)]?\s*[·• ]?\s*([^\s，。、；·（）()\[\]〔〕]{{1,8}})\s*$"
    return F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.nullif(F.regexp_extract(c, p, 2), F.lit(""))


def is_verse(c: Column) -> Column:
    """Whether a line reads like verse: segments of at most 12 characters, 8 on average, no brackets, no word of comment before it."""
    seg = F.filter(F.split(c, "[，。！？；、]"), lambda x: F.length(x) > 0)
    longest = F.array_max(F.transform(seg, lambda x: F.length(x)))
    mean = F.aggregate(seg, F.lit(0), lambda a, x: a + F.length(x)) / F.size(seg)
    return (F.size(seg) > 0) & (longest <= 12) & (mean <= 8) & ~c.rlike("[（(【\\[]") & ~c.rlike("^(?:何以|此处|结处|起句|或云|注|按)")


def sentences(c: Column, least: int = 4) -> Column:
    """Parts after 。！？ or line breaks, of at least `least` characters."""
    return F.filter(F.transform(F.split(c, r"(?<=[。！？])\s*|\n+"), trimmed), lambda x: F.length(x) >= least)


def kept_sentences(c: Column, patterns: Sequence[str], least: int = 4) -> Column:
    """The sentences that match none of the patterns, joined; the text itself if none is left."""
    alt = "|".join(f"(?:{p})" for p in patterns)
    kept = F.filter(sentences(c, least), lambda x: ~x.rlike(alt))
    return F.when(F.size(kept) > 0, F.array_join(kept, "")).otherwise(c)


def escaped(c: Column) -> Column:
    """Text safe within HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def json_or(c: Column, schema: str, default: Column) -> Column:
    return F.coalesce(F.from_json(c, schema), default)


def outer_json(c: Column) -> Column:
    """The outermost {...} of an answer that may stand in Markdown fences; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def parts(c: Column, delimiters: str) -> Column:
    """A delimited list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, delimiters), lambda x: F.trim(x)), lambda x: x != "")


def pairs(c: Column) -> Column:
    """MAP of `k:v|k:v`; a key may hold colons, the last one counts."""
    entries = F.filter(F.split(c, r"\|"), lambda x: x.rlike(r"^.+:[^:]+$"))
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.regexp_extract(x, r"^(.+):([^:]+)$", 1), F.regexp_extract(x, r"^(.+):([^:]+)$", 2).try_cast("int"))))


def second_level(c: Column) -> Column:
    """The second part of a path of three parts or more, else null."""
    p = F.split(c, "/")
    return F.when(F.size(p) >= 3, p[1])


def price(c: Column) -> Column:
    """The first number of a text, thousands separators removed; null if there is none."""
    return F.replace(F.nullif(F.regexp_extract(c, r"(\d[\d,]*\.?\d*)", 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def currency(c: Column) -> Column:
    return F.when(c.rlike(r"HK\$|HKD"), "HKD").when(c.rlike(r"US\$|USD"), "USD").when(c.rlike("[¥￥]|CNY|RMB"), "CNY")
