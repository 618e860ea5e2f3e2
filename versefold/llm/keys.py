"""Row keys and letters-and-digits texts shared by the duplicate finders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, is_blank

#: Labels of the three fields of a submitted poem.
LABELS = ("诗名", "作者", "正文")


def _labelled(record: Column, label: str) -> Column:
    """The part of a record after this label, up to the next label that follows a separator."""
    other = "|".join(LABELS)
    opening = r"(?:^|\|\|[ \t]*|[\n\t])"
    head = rf"(?:\[{label}\]|{label}[ \t]*[:：=＝])"
    following = rf"(?=[ \t]*(?:\|\||\n|\t)[ \t]*(?:\[(?:{other})\]|(?:{other})[ \t]*[:：=＝])|\z)"
    pattern = rf"(?s){opening}[ \t]*{head}(.*?){following}"
    return F.when(record.rlike(pattern), F.regexp_extract(record, pattern, 1))


def parse_record(record: Column) -> dict[str, Column]:
    """诗名, 作者, 正文 out of one string: a JSON object, `label: x || label: y`, `[label]x` lines or `label=x` by tabs.

    A field that is absent is null. A null record has three null fields.
    """
    is_json = record.rlike(r"^\s*\{")
    parsed = F.from_json(F.when(is_json, record), ", ".join(f"`{x}` string" for x in LABELS))
    return {x: F.when(is_json, parsed[x]).otherwise(_labelled(record, x)) for x in LABELS}


def poems(review: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """key, title, author, body: letters and digits of poems with a body, null fields as empty strings."""
    norm = lambda c: F.coalesce(alnum_key(c), F.lit(""))
    out = review.where(~is_blank("正文")).select(
        F.col("ID").alias("key"), norm("诗名").alias("title"), norm("作者").alias("author"), norm("正文").alias("body")
    )
    if raw is not None:
        f = parse_record(F.col("record"))
        out = out.unionByName(raw.select(F.col("raw_id").alias("key"), norm(f["诗名"]).alias("title"), norm(f["作者"]).alias("author"), norm(f["正文"]).alias("body")))
    return out
