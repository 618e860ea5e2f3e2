"""Python data sources: SQLite tables and numpy matrices, read in parallel by ranges of rows."""

from __future__ import annotations

import glob
import os
import sqlite3
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


def _ranges(low: int, high: int, n: int) -> list[_Range]:
    step = max(1, -(-(high - low) // max(1, n)))
    return [_Range(a, min(high, a + step)) for a in range(low, high, step)] or [_Range(0, 0)]


_TYPES = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "BLOB": "binary"}


class SqliteSource(DataSource):
    """format("sqlite"): options path (a file that executors can reach), table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            rows = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{r[1]}` {_TYPES.get((r[2] or '').upper().split('(')[0], 'string')}" for r in rows)

    def reader(self, schema):
        return _SqliteReader(self.options, [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options, columns):
        self.path, self.table, self.n, self.columns = options["path"], options["table"], int(options.get("partitions", "4")), columns

    def _db(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._db() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return _ranges(low or 0, (high or -1) + 1, self.n)

    def read(self, partition):
        cols = ", ".join(f'"{c}"' for c in self.columns)
        with self._db() as db:
            yield from db.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class MatrixSource(DataSource):
    """format("npy"): options path, partitions; columns row BIGINT, vector ARRAY<DOUBLE>. The file is mapped, not loaded."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row bigint, vector array<double>"

    def reader(self, schema):
        return _MatrixReader(self.options)


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n = options["path"], int(options.get("partitions", "4"))

    def partitions(self):
        return _ranges(0, np.load(self.path, mmap_mode="r").shape[0], self.n)

    def read(self, partition):
        m = np.load(self.path, mmap_mode="r")
        for i in range(partition.low, partition.high):
            yield i, [float(x) for x in m[i]]


class ShardSource(DataSource):
    """format("npy_shards"): options path (a folder of `write_shards`), rows of a range at most; columns key, vector ARRAY<DOUBLE>. The files are mapped, not loaded."""

    @classmethod
    def name(cls) -> str:
        return "npy_shards"

    def schema(self) -> str:
        return f"key {self.options['key']}, vector array<double>"

    def reader(self, schema):
        return _ShardReader(self.options)


class _ShardRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _ShardReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", "10000"))

    def partitions(self):
        out = []
        for f in sorted(glob.glob(f"{self.path}/*.keys.npy")):
            n = np.load(f, mmap_mode="r").shape[0]
            if n != np.load(_matrix_of(f), mmap_mode="r").shape[0]:
                raise ValueError(f"as many keys as rows are needed: {f}")
            out += [_ShardRange(f, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
        return out or [_ShardRange("", 0, 0)]

    def read(self, partition):
        if partition.path:
            keys, m = np.load(partition.path, mmap_mode="r"), np.load(_matrix_of(partition.path), mmap_mode="r")
            for i in range(partition.low, partition.high):
                yield keys[i].item(), [float(x) for x in m[i]]


def _matrix_of(keys: str) -> str:
    return keys.removesuffix(".keys.npy") + ".rows.npy"


def _put(path: str, a: np.ndarray) -> None:
    """The file appears whole or not at all; a repeated task writes the same again."""
    with open(part := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        np.save(f, a)
    os.replace(part, path)


def write_shards(df: DataFrame, key: str, vector: str, path: str) -> int:
    """Writes the rows as .npy matrices with .npy keys, from the executors: one pair of files for each Arrow batch. Returns the number of rows.

    path: an existing folder that all executors see. A null key or vector, and vectors of several lengths, are errors.
    """

    def write(batches):
        i, rows = TaskContext.get().partitionId(), 0
        for j, b in enumerate(batches):
            keys, vectors = b.column(0), b.column(1)
            if not b.num_rows:
                continue
            if keys.null_count or vectors.null_count:
                raise ValueError("a matrix has no place for null keys or vectors")
            name = f"{path}/part-{i:05d}-{j:05d}"
            _put(f"{name}.rows.npy", np.array(vectors.to_pylist(), np.float64))
            _put(f"{name}.keys.npy", np.array(keys.to_pylist()))
            rows += b.num_rows
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return df.select(key, vector).mapInArrow(write, "rows bigint").agg(F.sum("rows")).first()[0] or 0


def register(spark: SparkSession) -> None:
    for s in (SqliteSource, MatrixSource, ShardSource):
        spark.dataSource.register(s)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    register(spark)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", str(partitions)).load()


def read_matrix(spark: SparkSession, path: str, keys: list | None = None, partitions: int = 4) -> DataFrame:
    """row or key, vector; keys: the row's ids in order. A length that differs from the matrix is an error."""
    register(spark)
    df = spark.read.format("npy").option("path", path).option("partitions", str(partitions)).load()
    if keys is None:
        return df
    if len(keys) != np.load(path, mmap_mode="r").shape[0]:
        raise ValueError("as many keys as rows are needed")
    ids = spark.createDataFrame(list(enumerate(keys)), f"row bigint, key {'string' if isinstance(keys[0], str) else 'bigint'}")
    return df.join(ids, "row").select("key", "vector")


def read_shards(spark: SparkSession, path: str, key: str = "bigint", rows: int = 10000) -> DataFrame:
    """key, vector of all shards in a folder, read by ranges of at most `rows` rows; key: its type, bigint or string."""
    register(spark)
    return spark.read.format("npy_shards").option("path", path).option("key", key).option("rows", str(rows)).load()
