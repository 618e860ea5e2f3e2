"""Sinks: files, upserts, resumable work lists, and an edit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False, mark: bool = True) -> None:
    """CSV with header, quotes doubled; arrays must be flattened before. single: one file, for small results.

    mark: every file begins with a byte-order mark, as spreadsheets expect; it stands before the first column's name.
    """
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def next_version(existing: Sequence[str], base: str) -> str:
    """base/v0001, v0002, ...: a new folder for every write, so that nothing is read while it is overwritten and the last state stays."""
    numbers = [int(x[1:]) for x in existing if x[:1] == "v" and x[1:].isdigit()]
    return f"{base}/v{max(numbers, default=0) + 1:04d}"


def write_version(df: DataFrame, base: str) -> str:
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(conf)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    path = next_version(names, base)
    df.write.mode("error").parquet(path)
    return path


def unfinished(source: DataFrame, done: DataFrame, key: str, result: str) -> DataFrame:
    """Rows of the source without a result that is not blank: what a resumed run has left to do."""
    return source.join(done.where(F.coalesce(F.trim(F.col(result)), F.lit("")) != "").select(key), key, "left_anti")


def to_json_documents(df: DataFrame, key: str) -> DataFrame:
    """key, document: every row as a JSON object."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("document"))


def latest_edits(edits: DataFrame, key: str, field: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, field, value: the last edit of each field by an append-only log; deletes are edits of the field '__deleted'."""
    return edits.groupBy(key, field).agg(F.max_by(value, F.struct(*order)).alias(value))


def apply_edits(base: DataFrame, edits: DataFrame, key: str, field: str, value: str, order: Sequence[str], allowed: Sequence[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """The base with the last edits of allowed fields over it, deleted rows left out, and columns derived from changed ones."""
    last = latest_edits(edits, key, field, value, order)
    wide = last.where(F.col(field).isin(*allowed, "__deleted")).groupBy(key).pivot(field, [*allowed, "__deleted"]).agg(F.first(value))
    renamed = wide.select(key, *[F.col(c).alias(f"__new_{c}") for c in [*allowed, "__deleted"]])
    out = base.join(renamed, key, "left").where(F.coalesce(F.col("__new___deleted"), F.lit("")) != "true")
    types = dict(base.dtypes)
    out = out.select(*[F.coalesce(F.col(f"__new_{c}").try_cast(types[c]), F.col(c)).alias(c) if c in allowed else F.col(c) for c in base.columns])
    return out.withColumns(derived) if derived else out


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row: the greatest whole-number key plus one."""
    return df.agg((F.coalesce(F.max(F.col(key).try_cast("bigint")), F.lit(0)) + 1).alias("next_id"))


def report(df: DataFrame, path: str | None) -> DataFrame:
    """The result itself; it is written only if a path is given."""
    if path:
        df.write.mode("overwrite").parquet(path)
    return df
