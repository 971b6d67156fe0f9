"""What the corpus operators share: reading, staging and batch mapping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of the word contracts: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE_CLASS}]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a temporary one where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/lectern-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, path: str, compression: str) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    return write_and_read(df, f"{shared_folder(df.sparkSession)}/{name}", compression)


class Scratch:
    """The staged tables of one computation, which ends by deleting all but those that its result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.tables = spark, shared_folder(spark), {}, {}

    def stage(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        out = write_and_read(df, path, compression)
        self.paths[path] = out
        return out

    def stage_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """The same, in buckets of `column`: a join on it moves only the other side, however often the table is joined."""
        path, table = f"{self.root}/{len(self.paths)}-{name}", f"lectern_{uuid.uuid4().hex}"
        df.write.bucketBy(shuffle_partitions(self.spark), column).sortBy(column).option("path", path).format("parquet").saveAsTable(table)
        self.paths[path], self.tables[path] = self.spark.table(table), table
        return self.paths[path]

    def drop(self, *tables: DataFrame | None) -> None:
        for path in [p for p, held in self.paths.items() if any(held is t for t in tables)]:
            self._delete(path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        for path in [p for p, held in self.paths.items() if not any(held is t for t in tables)]:
            self._delete(path)

    def _delete(self, path: str) -> None:
        self.paths[path] = None
        if path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made and run inside drop their shuffle files as soon as they end, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bytes of a batch that a task takes at a time: what it makes of them in Python is many times as large.
BATCH_BYTES = 4_000_000


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about BATCH_BYTES; a single larger row stays whole."""
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable], schema: str | T.StructType) -> DataFrame:
    """Apply `fn` to each Arrow batch; `fn` returns the output columns in schema order, as lists or Arrow arrays."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            if batch.num_rows:
                columns = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(fn(batch), arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, struct)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator needs, under fixed names; a null text reads as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """Tells rows apart that have one doc_id but different texts; rows that repeat each other have one key."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    return F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit("")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. Python's own keyed hash: PySpark gives all workers one PYTHONHASHSEED; without it they would differ."""
    if os.environ.get("PYTHONHASHSEED", "random") == "random":
        raise RuntimeError("set PYTHONHASHSEED, as PySpark does for its workers")
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each `size` neighbours in `codes`, by position of the first."""
    n = len(codes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out ^= codes[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out
