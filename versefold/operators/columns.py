"""Column arithmetic: choosing, recoding, binning and scoring columns. Nothing here starts a job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_position(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Columns 1, 2, ... by position counted from 1, under new names."""
    return df.select([F.col(f"`{df.columns[i - 1]}`").alias(n) for i, n in names.items()])


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """These columns first, as far as they are there; the rest keeps its order."""
    return df.select([c for c in first if c in df.columns] + [c for c in df.columns if c not in first])


def insert_after(df: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """A column put right after another one; at the end if that is absent."""
    cols = [c for c in df.columns if c != name]
    at = cols.index(after) + 1 if after in cols else len(cols)
    return df.select(*cols[:at], value.alias(name), *cols[at:])


def first_column(df: DataFrame, candidates: Sequence[str], default: str | None) -> Column:
    """The first of the candidates that the table has, else a literal."""
    return next((F.col(f"`{c}`") for c in candidates if c in df.columns), F.lit(default))


def month_near(month: Column, center: int, reach: int) -> Column:
    """Whether a month (1-12) lies within `reach` months around a center, the year taken as a circle."""
    return month.between(1, 12) & (F.pmod(month - F.lit(center) + F.lit(18), F.lit(12)) - 6).between(-reach, reach)


def range_patch(df: DataFrame, key: str, field: str, rules: Sequence[tuple[int, int, str]], changed: str) -> DataFrame:
    """The field's new value by inclusive ranges of a key, and whether a rule applied; the first rule wins."""
    hit = [F.when(F.col(key).between(a, b), F.lit(v)) for a, b, v in rules]
    new = F.coalesce(*hit)
    return df.withColumn("__new", new).select(*[F.coalesce("__new", field).alias(field) if c == field else F.col(c) for c in df.columns], F.col("__new").isNotNull().alias(changed))


def first_rule(value: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    """The label of the first set that holds the value."""
    return F.coalesce(*[F.when(value.isin(*xs), F.lit(label)) for xs, label in rules], F.lit(default))


def recode(value: Column, codes: Mapping, default) -> Column:
    """A dictionary lookup; unmapped and null values get the default."""
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.coalesce(F.try_element_at(m, value), F.lit(default))


def neutral_band(positive: Column, negative: Column, band: float = 0.05) -> tuple[Column, Column]:
    """(kind, confidence) by the difference of two scores, neutral within the band."""
    diff, total = positive - negative, F.greatest(positive + negative, F.lit(1e-8))
    kind = F.when(diff > band, "positive").when(-diff > band, "negative").otherwise("neutral")
    return kind, F.when(diff > band, diff / total).when(-diff > band, -diff / total).otherwise(F.lit(0.0))


def half_open_bins(value: Column, edges: Sequence[int]) -> Column:
    """'a-b' for a <= value < b, 'z+' from the last edge on; null and smaller values give null."""
    out = F.when(value < edges[0], F.lit(None).cast("string"))
    for a, b in zip(edges, edges[1:]):
        out = out.when((value >= a) & (value < b), f"{a}-{b}")
    return out.when(value >= edges[-1], f"{edges[-1]}+")


def clamped(confidence: Column, score: Column, full: float) -> Column:
    """A confidence in proportion to a score up to `full`."""
    return confidence * F.least(score / F.lit(full), F.lit(1.0))


def combined(a: Column, b: Column) -> Column:
    """The mean of two confidences if both are positive, else the greater one."""
    return F.when((a > 0) & (b > 0), (a + b) / 2).otherwise(F.greatest(a, b))


def constrained_arg_max(group: Column, allowed: Mapping[str, Sequence[str]], scores: Mapping[str, Column]) -> Column:
    """The best label among those that the group allows; the first of equal ones."""

    def best(labels: Sequence[str]) -> Column:
        top = F.greatest(*[scores[x] for x in labels]) if len(labels) > 1 else scores[labels[0]]
        return F.coalesce(*[F.when(scores[x] == top, F.lit(x)) for x in labels])

    return F.coalesce(*[F.when(group == g, best(labels)) for g, labels in allowed.items()])


def request_filter(df: DataFrame, equal: Mapping[str, str | None], search: str | None, columns: Sequence[str]) -> DataFrame:
    """Equality on the given columns as far as a value is given, and a text contained in any of some columns."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if search:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.col(c), F.lit(search)), F.lit(False))
        df = df.where(hit)
    return df
