"""Session helpers: opening tables and cutting lineage safely on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Setting by which Spark drops the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started. Elsewhere it is shipped with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only the columns used later reach the scan."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on one machine) a temporary folder is chosen once per session and
    registered as checkpoint folder; on a cluster the setting must name shared storage.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not named:
        known = sc._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="versefold-")
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """For work on whole texts: rows of a scan with fewer partitions than cores (one small file) on all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: the result survives the loss of any executor and has no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stage:
    """Written intermediate tables in the shared folder. They outlive the loss of any executor.

    A result is lazy and may read them until it is written itself, so they stay until `sweep` or the end of the run.
    """

    made: list[Stage] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Stage.made.append(self)

    def write(self, df: DataFrame, name: str, release: bool = False) -> DataFrame:
        """release: shuffle files go when the table is written, not when the driver happens to collect its garbage."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, None)
        if release:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if release:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep() -> None:
    """Drops all intermediate tables made so far. Results that still read them must have been written before."""
    while Stage.made:
        Stage.made.pop().drop()


def default_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("versefold")
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VERSEFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
