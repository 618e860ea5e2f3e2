"""Splits that keep related records together (problem 1).

Records and entities (authors, original numbers) form a bipartite graph. Only records that touch two or more entities
can carry a tie further, so these connectors alone, one for each distinct set of entities, take part in the rounds: each
connector takes the least label of its entities, each entity the least label of its connectors, and then the label of
its label, which makes the number of rounds logarithmic in the longest chain. Labels of every round are a table in the
shared folder. Everything is keyed by 64-bit hashes; nothing is collected but sums.

Then whole groups are assigned to splits. Groups that hold at least 1/2000 of all rows (at most 2000 of them) are
assigned each for itself; all others fall by hash into 4096 bins of groups. These at most 6096 items, each with its
counts of the stratification label, are assigned greedily, the largest first, each to the split where the squared
deviation from the wanted share of every label and of the total becomes least.

Defined cases: null, blank and unknown authors tie nothing; a null ID has no number and is a group of its own; repeated
rows are tied by their ID; an empty table gives an empty result; equal deviations go to the split named first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alnum_key
from ..session import Stage

#: Spellings of a missing author, as letters and digits in lower case.
UNKNOWN = ("", "nan", "none", "null", "na", "佚名", "佚", "未详", "无名氏", "無名氏", "未知", "未知作者", "不详", "不詳", "未詳", "阙名", "闕名", "失名", "匿名", "待考", "无", "anonymous", "anon", "unknown")
_OPEN, _CLOSE = "（(〔\\[【", "）)〕\\]】"


def author_names(cell: Column, dynasties: list[str]) -> Column:
    """ARRAY<STRING>: the authors that a cell names, each as letters and digits in lower case, unknown ones left out.

    Taken away: bracketed additions beside the name, a dynasty with a dot before or after it, 撰 and similar marks, by.
    Cells are cut at 、，；; / & | and at a comma unless it stands within one Latin name.
    """
    dynasty = "|".join(sorted((d for d in dynasties if d), key=lambda x: (-len(x), x))) or "(?!)"
    c = F.coalesce(cell, F.lit(""))
    parts = F.split(c, r"\s*[、，；;/／|&＆]\s*|(?<=\p{IsHan})\s*,\s*|,\s*(?=\p{IsHan})|(?<=\p{L}\s\p{L}{1,30}),\s*(?=\p{L}+\s+\p{L})")

    def clean(x: Column) -> Column:
        bare = F.trim(F.regexp_replace(x, rf"[{_OPEN}][^{_OPEN}{_CLOSE}]*[{_CLOSE}]", " "))
        x = F.when(alnum_key(bare) == "", x).otherwise(bare)
        x = F.regexp_replace(x, rf"^[\s\p{{Z}}]*(?:{dynasty})[\s\p{{Z}}]*[·・•．.:：][\s\p{{Z}}]*(?=\S)", "")
        x = F.regexp_replace(x, rf"(?<=\S)[\s\p{{Z}}]*[·・•][\s\p{{Z}}]*(?:{dynasty})[\s\p{{Z}}]*$", "")
        x = F.regexp_replace(x, r"(?i)^[\s\p{Z}]*by[\s\p{Z}]+", "")
        x = alnum_key(x)
        return F.regexp_replace(x, r"(?<=\p{IsHan}{2})(?:撰|著|撰著|编著|編著|輯|辑|譯|译)$", "")

    return F.array_distinct(F.filter(F.transform(parts, clean), lambda x: ~x.isin(*UNKNOWN)))


def original_number(key: Column) -> Column:
    """The key without a last -NN."""
    return F.regexp_replace(key, r"-\d+$", "")


def entity_sets(df: DataFrame, key: str, authors: Column, number: Column) -> DataFrame:
    """key, entities ARRAY<BIGINT> (sorted): hashes of the authors, and of the number where other rows share it."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.transform(authors, lambda x: F.xxhash64(F.lit("author"), x)).alias("names"), F.when(number.isNotNull(), F.xxhash64(F.lit("number"), number)).alias("number"))
    common = rows.where("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number", F.col("number").alias("shared"))
    joined = rows.join(common, "number", "left")
    return joined.select("key", F.array_sort(F.array_distinct(F.filter(F.concat("names", F.array("shared")), lambda x: x.isNotNull()))).alias("entities"))


def components(sets: DataFrame, stage: Stage, most_rounds: int = 100) -> DataFrame:
    """entity, label: the component's least entity, for entities that some row ties to another one."""
    connectors = sets.where(F.size("entities") > 1).select("entities").distinct().select(F.xxhash64("entities").alias("record"), F.explode("entities").alias("entity"))
    connectors = stage.write(connectors, "connectors")
    labels, before = stage.write(connectors.select("entity", F.col("entity").alias("label")).distinct(), "labels0"), None
    for k in range(1, most_rounds):
        records = connectors.join(labels, "entity").groupBy("record").agg(F.min("label").alias("label"))
        nearer = connectors.join(records, "record").groupBy("entity").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("entity").alias("label"), F.col("label").alias("further"))
        labels = stage.write(nearer.join(jump, "label", "left").select("entity", F.least("label", "further").alias("label")), f"labels{k}")
        total = labels.agg(F.sum(F.col("label").cast("decimal(20,0)"))).first()[0]
        stage.drop(f"labels{k - 1}")
        if total == before:  # labels only ever fall
            return labels
        before = total
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def groups(df: DataFrame, key: str, authors: Column, number: Column) -> DataFrame:
    """key, group_id (the group's smallest key), n_rows: of every row; a row without ties is a group of its own."""
    stage = Stage(df.sparkSession, "related")
    sets = stage.write(entity_sets(df, key, authors, number), "sets")
    labels = components(sets, stage)
    first = sets.select("key", F.try_element_at("entities", F.lit(1)).alias("entity"))
    named = first.join(labels, "entity", "left").select("key", F.coalesce("label", "entity", F.xxhash64(F.lit("row"), F.coalesce("key", F.expr("uuid()")))).alias("component"))
    named = stage.write(named, "named")
    ids = named.groupBy("component").agg(F.min("key").alias("group_id"), F.count(F.lit(1)).alias("n_rows"))
    return named.join(ids, "component").select("key", "group_id", "n_rows")


def assign(counts: np.ndarray, shares: list[float]) -> np.ndarray:
    """The split of each item; counts: (items, labels). Greedy, the largest item first."""
    wanted = np.array(shares, float) / sum(shares)
    c = np.hstack([counts, counts.sum(1, keepdims=True)]).astype(float)
    total = np.maximum(c.sum(0), 1)
    weight = np.append(np.full(counts.shape[1], 1 / max(1, counts.shape[1])), 1.0) if counts.shape[1] else np.ones(1)
    target, have = wanted[:, None] * total, np.zeros((len(wanted), c.shape[1]))
    out = np.zeros(len(c), np.int64)
    for i in np.argsort(-c[:, -1], kind="stable"):
        gap = have - target
        change = (((gap + c[i]) ** 2 - gap**2) / total**2 * weight).sum(1)
        out[i] = int(np.argmin(change))
        have[out[i]] += c[i]
    return out


def splits(df: DataFrame, key: str, authors: Column, number: Column, label: str, shares: dict[str, float] | None = None, bins: int = 4096, large: int = 2000, strata: int = 256) -> DataFrame:
    """key, group_id, split: rows of one group in one split, the label's distribution alike in all splits.

    Every label is a stratum of its own up to `strata` different ones; more labels than that are hashed into so many strata.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark: SparkSession = df.sparkSession
    stage = Stage(spark, "splits")
    member = groups(df, key, authors, number)
    labels = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("")).alias("label")).dropDuplicates(["key"])
    member = stage.write(member.join(labels, "key", "left"), "member")
    n = member.count()
    item = F.when(F.col("n_rows") * large >= n, F.concat(F.lit("g"), F.coalesce("group_id", F.lit("")))).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("group_id"), F.lit(bins)).cast("string")))
    member = member.withColumn("item", item)
    # Bounded: at most (bins + large) * strata counts.
    many = member.select("label").distinct().limit(strata + 1).count() > strata
    kind = F.pmod(F.xxhash64("label"), F.lit(strata)).cast("string") if many else F.col("label")
    table = member.groupBy("item", kind.alias("label")).count().toPandas()
    counts = table.pivot(index="item", columns="label", values="count").fillna(0).sort_index()
    names = list(shares)
    plan = assign(counts.to_numpy(), list(shares.values())) if len(counts) else np.zeros(0, np.int64)
    chosen = spark.createDataFrame([(i, names[k]) for i, k in zip(counts.index, plan)], "item string, split string")
    return member.join(F.broadcast(chosen), "item").select("key", "group_id", "split")
