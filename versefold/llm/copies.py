"""Copies hidden by formatting (problem 3): commutative multiset fingerprints of field names and values.

Each normalized (field name, value) pair is hashed to two 60-bit numbers; the numbers of a record's fields are added, so
that field order does not matter. Records are grouped by the sums with partial aggregation, which one hot group cannot
overload. Field equality is verified by the distinct records of each fingerprint: a hash aggregation that drops copies
before its shuffle and sorts nothing. A fingerprint with more than one record (a collision, some 2^-120 a pair) is taken
out, and its rows are grouped by their fields. Keys are matched with groups in rows of a key and two numbers.

Defined cases: null fields equal empty ones; the driver's tables decide by themselves which rows take part. A row
that is there twice with one key is counted in n_copies, but is not a copy of itself in `copies`' pairs of keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stage

_MASK = (1 << 60) - 1


def multiset_hash(fields: list[str], seed: int) -> Column:
    """A sum of hashes of (name, value) pairs that no order of fields changes; up to 8 fields without overflow."""
    if len(fields) > 8:
        raise ValueError("at most 8 fields")
    return reduce(lambda a, b: a + b, [F.xxhash64(F.lit(f"{seed}:{x}"), F.coalesce(F.col(f"`{x}`"), F.lit(""))).bitwiseAND(F.lit(_MASK)) for x in sorted(fields)])


def fingerprints(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, the fields and the two halves of the fingerprint, f1 and f2."""
    return df.select(F.col(f"`{key}`").alias("key"), *[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in fields], multiset_hash(fields, 1).alias("f1"), multiset_hash(fields, 2).alias("f2"))


def _collided(rows: DataFrame, fields: list[str], stage: Stage) -> DataFrame:
    """f1, f2: fingerprints that different records have."""
    distinct = rows.select("f1", "f2", *fields).distinct()
    return stage.write(distinct.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "collided")


def copies(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, first_key: of every record in a group of two or more."""
    stage = Stage(df.sparkSession, "copies")
    rows = fingerprints(df, key, fields)
    narrow = stage.write(rows.select("key", "f1", "f2"), "keys")
    groups = narrow.groupBy("f1", "f2").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = narrow.join(groups, ["f1", "f2"])
    collided = _collided(rows, fields, stage)
    if collided.isEmpty():
        return found.select("key", "first_key")
    other = rows.join(collided, ["f1", "f2"], "left_semi")
    exact = other.groupBy("f1", "f2", *fields).agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n")).where("n > 1")
    regrouped = other.join(exact, ["f1", "f2", *fields]).select("key", "first_key")
    return found.join(collided, ["f1", "f2"], "left_anti").select("key", "first_key").unionByName(regrouped)


def collapse(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each distinct record: first_key, n_copies BIGINT (the record itself counted). Null keys and keys of several records do no harm."""
    stage = Stage(df.sparkSession, "collapse")
    rows = fingerprints(df, key, fields)
    collided = _collided(rows, fields, stage)
    counted = [F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n_copies")]
    if collided.isEmpty():
        return rows.select("key", "f1", "f2").groupBy("f1", "f2").agg(*counted).select("first_key", "n_copies")
    sure = rows.select("key", "f1", "f2").join(collided, ["f1", "f2"], "left_anti").groupBy("f1", "f2").agg(*counted)
    other = rows.join(collided, ["f1", "f2"], "left_semi").groupBy("f1", "f2", *fields).agg(*counted)
    return sure.select("first_key", "n_copies").unionByName(other.select("first_key", "n_copies"))
