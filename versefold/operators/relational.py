"""Joins, merges, windows and aggregates that the built-in operators express only together.

All of them are declarative: they take and give DataFrames, never collect, and leave the physical choice to Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import grams
from ..session import cut


# --- joins and merges


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The same rows; running the plan fails if a key is there twice. Partial aggregates: a hot key fails early and alone."""
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.any_value(c).alias(c) for c in rest])
    return one.where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key in {name}")).cast("boolean")).otherwise(F.lit(True))).select(*df.columns)


def one_to_one_outer(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join that fails on a duplicate key of either side. The join reuses the checks' partitioning."""
    return assert_unique(left, keys, "left").join(assert_unique(right, keys, "right"), list(keys), "full_outer")


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Left join with the right side's row of least order for each key."""
    cols = [c for c in right.columns if c not in (*keys, order)]
    one = right.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in cols])
    return left.join(one, list(keys), "left")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table marked for a broadcast if it has at most `most` rows, else as it is: a shuffled join then."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lengths_of(terms: DataFrame, term: str, most: int = 256) -> list[int]:
    """The different lengths of the terms, by an aggregate; terms of more than `most` lengths are no word list."""
    found = sorted(r[0] for r in terms.where(F.length(term) > 0).select(F.length(term)).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"terms of more than {most} different lengths")
    return found


def contains_join(texts: DataFrame, key: str, haystacks: Sequence[str], terms: DataFrame, term: str) -> DataFrame:
    """key, term: pairs where any of the haystack columns contains the term, by an equi-join.

    Substrings of the terms' lengths are exploded and joined by equality, so that no theta join compares every text with
    every term; a small list of terms meets them before anything is shuffled. Empty and null terms are in nothing.
    """
    terms = terms.where(F.length(term) > 0).select(term).distinct()
    lengths = lengths_of(terms, term)
    if not lengths:
        return texts.select(key).limit(0).withColumn(term, F.lit(None).cast("string"))
    of = lambda h: F.flatten(F.array(*[F.transform(grams(F.coalesce(F.col(h), F.lit("")), n, n), lambda x: x["term"]) for n in lengths]))
    every = F.array_distinct(F.flatten(F.array(*[of(h) for h in haystacks])))
    exploded = texts.select(F.col(key), F.explode(every).alias(term))
    return exploded.join(small(terms), term).select(key, term)


def overlay_merge(base: DataFrame, edits: DataFrame, key: str, fields: Sequence[str], source: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): edits by several sources over a base, field by field.

    A source changes a field if its value differs from the base. One changed value replaces the base; of several
    different ones the first source's (in order of its name) is taken and the field is reported as a conflict. Edits of
    unknown keys are ignored. Null never counts as a change.
    """
    long_ = lambda df, extra: df.select(key, *extra, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, *extra, "x.*")
    changed = long_(edits, [source]).alias("e").join(long_(base, []).alias("b"), [key, "field"]).where(F.col("e.value").isNotNull() & ~F.col("e.value").eqNullSafe(F.col("b.value")))
    folded = changed.groupBy(key, "field").agg(F.min_by(F.col("e.value"), F.col(source)).alias("winner"), F.count_distinct(F.col("e.value")).alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.col("e.value"))), "|").alias("values"))
    wide = folded.groupBy(key).pivot("field", list(fields)).agg(F.first("winner"))
    merged = base.alias("b").join(wide.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key, "left")
    types = dict(base.dtypes)
    merged = merged.select(key, *[F.coalesce(F.col(f"__{f}").cast(types[f]), F.col(f)).alias(f) for f in fields], *[c for c in base.columns if c not in (key, *fields)])
    return merged, folded.where("n_values > 1").select(key, "field", "n_values", "values")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Column-wise coalesce of the new over the old row; rows of either side stay."""
    old, new = existing.alias("o"), incoming.alias("n")
    cols = [c for c in existing.columns if c not in keys]
    joined = old.join(new, list(keys), "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in incoming.columns else F.col(f"o.{c}") for c in cols])


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of existing, and incoming rows whose key is new."""
    return existing.unionByName(incoming.join(existing.select(*keys), list(keys), "left_anti"))


def union_first(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union with precedence: for each key the row of the first source that has it (its least row, if it has several)."""
    cols = sources[0].columns
    tagged = [s.select(*cols, F.lit(i).alias("__source")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    rest = [c for c in cols if c not in keys]
    one = out.groupBy(*keys).agg(F.min(F.struct("__source", *rest)).alias("x"))
    return one.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


# --- windows


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the plan limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def cap_per_group(df: DataFrame, by: str, order: Sequence[Column], cap: int, k: int, considered: int | None = None) -> DataFrame:
    """The first k rows in order with at most cap of each group, among the first `considered` rows (6 k if not given)."""
    head = df.orderBy(*order).limit(considered or 6 * k)
    capped = head.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= cap).drop("__n")
    return capped.orderBy(*order).limit(k)


def suffix_duplicates(df: DataFrame, key: str, order: Sequence[Column], out: str) -> DataFrame:
    """Keys that are there several times get -01, -02, ... in order; single keys stay."""
    parts, w = _in_parts(df, [key], order), Window.partitionBy(key)
    sizes = parts.groupBy(key, "__p").agg(F.count(F.lit(1)).alias("__k"))
    upto = F.sum("__k").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select(key, "__p", F.coalesce(upto, F.lit(0)).alias("__s"), F.sum("__k").over(w).alias("__n"))
    local = F.row_number().over(Window.partitionBy(key, "__p").orderBy("__m"))
    joined = _beside(parts.withColumn("__r", local), shift, [key], ["__s", "__n"])
    text, i = F.col(key).cast("string"), (F.col("__r") + F.col("__s")).cast("string")
    return joined.withColumn(out, F.when(F.col("__n") > 1, F.concat(text, F.lit("-"), F.when(F.length(i) < 2, F.lpad(i, 2, "0")).otherwise(i))).otherwise(text)).select(*df.columns, out)


def _in_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows with their range partition __p by groups and order, and their place __m in it, cut from the lineage.

    A group may hold a third of all rows: it is spread over partitions, and what a window has to know of the partitions
    before (or behind) one is a row for each group and partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    return cut(spread).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())


def _beside(parts: DataFrame, ends: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows with columns of their group's row of their partition; null groups too."""
    a, b = parts.alias("a"), ends.alias("b")
    same = F.col("a.__p") == F.col("b.__p")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left").select("a.*", *[F.col(f"b.{c}") for c in columns])


def carried(df: DataFrame, c: Column, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """The last value that is not null up to each row of its group, this row included."""
    parts = _in_parts(df.withColumn("__c", c), by, order)
    local = F.last("__c", ignorenulls=True).over(Window.partitionBy("__p", *by).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0))
    ends = parts.groupBy("__p", *by).agg(F.max_by("__c", F.when(F.col("__c").isNotNull(), F.col("__m"))).alias("__e"))
    before = F.last("__e", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    found = _beside(parts.withColumn(out, local), ends.withColumn("__b", before), by, ["__b"])
    return found.withColumn(out, F.coalesce(out, "__b")).select(*df.columns, out)


def followed(df: DataFrame, c: Column, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """The first value that is not null behind each row of its group, this row left out."""
    parts = _in_parts(df.withColumn("__c", c), by, order)
    local = F.first("__c", ignorenulls=True).over(Window.partitionBy("__p", *by).orderBy("__m").rowsBetween(1, Window.unboundedFollowing))
    ends = parts.groupBy("__p", *by).agg(F.min_by("__c", F.when(F.col("__c").isNotNull(), F.col("__m"))).alias("__e"))
    behind = F.first("__e", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__p").rowsBetween(1, Window.unboundedFollowing))
    found = _beside(parts.withColumn(out, local), ends.withColumn("__b", behind), by, ["__b"])
    return found.withColumn(out, F.coalesce(out, "__b")).select(*df.columns, out)


def carry_forward(c: Column, by: Sequence[str], order: Sequence[Column]) -> Column:
    """As a column, for groups that one task may hold (the lines of one text); `carried` is for groups of any size."""
    return F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def numbered(df: DataFrame, by: str, key: str, seed: int, place: str, total: str) -> DataFrame:
    """Places 0, 1, ... of each group's rows in the order of a seeded hash, and the group's size.

    A group may hold a third of all rows, so no task numbers a whole group: the hash's first bits cut it into 1024 parts,
    parts are numbered by themselves and shifted by the sizes of the parts before them.
    """
    h = F.xxhash64(key, F.lit(seed))
    parts = df.withColumn("__h", h).withColumn("__b", F.shiftrightunsigned("__h", 54))
    sizes = parts.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by)
    shift = sizes.select(by, "__b", F.coalesce(F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"), F.sum("__n").over(w).alias(total))
    local = F.row_number().over(Window.partitionBy(by, "__b").orderBy("__h", key))
    numbered_parts = parts.withColumn("__r", local).alias("p").join(shift.alias("s"), (F.col(f"p.{by}").eqNullSafe(F.col(f"s.{by}"))) & (F.col("p.__b") == F.col("s.__b")))
    return numbered_parts.select(*[F.col(f"p.{c}") for c in df.columns], (F.col("__r") - 1 + F.col("__s")).alias(place), F.col(total))


# --- aggregates


def upper_median_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, upper_median: from counts of each value, so that a group's memory follows its different values, not its rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    at = F.floor(F.sum("n").over(w) / 2)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("__at", at).withColumn("__upto", upto).where("__upto > __at").groupBy(*by).agg(F.min(value).alias("upper_median"))


def dominant(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """by, label, n: the most frequent label of each group, the smallest of equally frequent ones."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("x")).select(*by, F.col("x.l").alias(label), (-F.col("x.m")).alias("n"))


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column over given column values, 0 where there is none."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def sorted_text(c: str, separator: str = "|") -> Column:
    """Distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def classification_report(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support; 0 where a division has no denominator. One pass of counts."""
    n = pairs.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = n.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed")))).alias("x")).select("x.*")
    s = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed"))
    p, r = F.coalesce(F.col("tp") / F.nullif(F.col("guessed"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    return s.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")
