"""Event-time aggregates over streams: an extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    zoned = lambda df: df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})  # noqa: E731 - event time needs a zone
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return zoned(reader.parquet(path) if fs.getFileStatus(jpath).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def tumbling(stream: DataFrame, ts: str, by: str, size: str, late: str) -> DataFrame:
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.unix_seconds("window.start").alias("start"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("session_window.start").alias("start"), by, "n")


def deduplicated(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, written exactly once to a table, which is returned."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def for_each_batch(stream: DataFrame, root: str, apply: Callable[[DataFrame, int], None]) -> None:
    """A function of each batch and its number; a repeated batch has the same number."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
