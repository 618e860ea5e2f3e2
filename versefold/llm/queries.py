"""The queries of this package, one group for each problem, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import alignment, bpe, canonical, confusable, copies, keys, listings, minmax, related, splitting

FIELDS = ["title", "author", "body"]


def _dynasties(s: SparkSession, d: str) -> list[str]:
    """The reference list's dynasties; a fixed table, whose size is checked."""
    rows = table(s, d, "canon_value").where("field_name = '朝代' and entry is not null").select("entry").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many dynasties for one pattern")
    return sorted(r.entry for r in rows)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    rows = related.groups(table(s, d, "review_tool"), "ID", related.author_names(F.col("作者"), _dynasties(s, d)), related.original_number(F.col("ID")))
    return rows.where("n_rows > 1").select(F.col("key").alias("id"), "group_id")


def p1_splits(s: SparkSession, d: str) -> DataFrame:
    rows = related.splits(table(s, d, "review_tool"), "ID", related.author_names(F.col("作者"), _dynasties(s, d)), related.original_number(F.col("ID")), "月份数字")
    return rows.withColumnRenamed("key", "id")


def _cells(s: SparkSession, d: str, of: Callable[[DataFrame, str, str, str], DataFrame]) -> DataFrame:
    cells = [of(table(s, d, t), t, k, f) for t, k, f in (("review_tool", "ID", "正文"), ("product", "id", "name"), ("category", "id", "name"))]
    return cells[0].unionByName(cells[1]).unionByName(cells[2])


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return _cells(s, d, confusable.disguised).select("table_name", "row_key", "field_name")


def p2_normalized(s: SparkSession, d: str) -> DataFrame:
    return _cells(s, d, confusable.normalized).select("table_name", "row_key", "field_name", "normalized")


def _poems(s: SparkSession, d: str) -> DataFrame:
    return keys.poems(table(s, d, "review_tool"), table(s, d, "poem_raw"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    found = copies.copies(_poems(s, d), "key", FIELDS)
    return found.where("key <> first_key").select("first_key", F.col("key").alias("copy_key"))


def p3_collapsed(s: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_poems(s, d), "key", FIELDS)


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return listings.pairs(listings.groups(table(s, d, "product"), table(s, d, "canon_value")))


def p4_groups(s: SparkSession, d: str) -> DataFrame:
    return listings.groups(table(s, d, "product"), table(s, d, "canon_value"))


def _entered(s: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(canonical.entered(table(s, d, "review_tool"), "ID", ["花名", "朝代", "月份"]), table(s, d, "canon_value"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return _entered(s, d).select("id", "field_name", "ref_id")


def p5_unmatched(s: SparkSession, d: str) -> DataFrame:
    """The report of values without a match, with the number of rows of each."""
    return _entered(s, d).where("ref_id = 0").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def _texts(s: SparkSession, d: str) -> DataFrame:
    return keys.poems(table(s, d, "review_tool")).select("key", F.concat("title", "body").alias("text"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return minmax.near_duplicates(_texts(s, d), "key", "text")


def p6_grouped(s: SparkSession, d: str) -> DataFrame:
    return minmax.grouped(_texts(s, d), "key", "text")


def p6_links(s: SparkSession, d: str) -> DataFrame:
    """The links of p6_grouped: pairs of representatives of different texts."""
    return minmax.class_links(_texts(s, d), "key", "text")[0]


def p7_ids(s: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(s, d, "documents"), "doc_id", "text")


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return alignment.leaks(table(s, d, "documents"), "doc_id", "text", table(s, d, "eval_item"), "item_id", "text")


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d).where("longest_run >= 30").select("doc_id", "item_id")


def p8_leaks(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d)


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(s, d, "documents"), "doc_id", "text").where("piece_no = 0").select("doc_id")


def p9_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(s, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_normalized, p3_found, p3_collapsed, p4_found, p4_groups, p5_found, p5_unmatched, p6_found, p6_grouped, p6_links, p7_ids, p8_found, p8_leaks, p9_found, p9_pieces)
}
