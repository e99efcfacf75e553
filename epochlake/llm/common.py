"""Small helpers shared by the operators: table access, shared storage, Arrow batches, linked groups."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as spark.checkpoint.dir or setCheckpointDir names it.

    A temporary one is made only in local mode, where driver and executors are one machine; elsewhere none is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it back; the rows and their path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str) -> DataFrame:
    return stored(df, what)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def uri_of(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as pyarrow.fs takes it in a task."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", whole)


def give_back() -> None:
    """Return freed memory to the system: a worker process stays for later tasks, and beside stages that don't need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a kernel makes of one batch stays small beside long texts.

    Freed memory is given back after each batch and at the end.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        del batch
        give_back()


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, None for null; no copy of the whole column."""
    col = batch.column(column)
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    for v in col:
        yield v.as_py()


def ints_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """int64 values of a column, null as the smallest value."""
    return batch.column(column).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest id reachable from each id that stands in an edge: rows (id, component).

    Rounds of contraction: each node points to its smallest neighbour, pointers are doubled until they end
    at a root, edges are renamed to roots and loops dropped. Each round removes every node that isn't a local
    minimum. Only maps and edges that remain are written; nothing is gathered on the driver but a count.
    Null ends are dropped; loops give the node itself; repeated edges count once.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    spark = edges.sparkSession
    now, _ = stored(now.distinct(), "cc-edges")  # the edges may be costly, and the lines below read them, the nodes until the end
    nodes = now.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    now = now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, edges_at = stored(now, "cc-edges")
    maps: list[DataFrame] = []
    while not now.isEmpty():
        up = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p"))
        up, up_at = stored(up, "cc-up")
        while True:
            nxt = up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.id"), "left")
            nxt, nxt_at = stored(nxt.select("x.id", F.coalesce("y.p", "x.p").alias("p"), F.col("y.p").isNotNull().alias("moved")), "cc-up")
            discard(spark, up_at)
            up, up_at = nxt.select("id", "p"), nxt_at
            if nxt.where("moved").isEmpty():
                break
        maps.append(up)
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            now = now.join(up.withColumnRenamed("id", end), end, "left").select(F.coalesce("p", end).alias(end), other)
        now = now.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        now, left_at = stored(now, "cc-edges")
        discard(spark, edges_at)
        edges_at = left_at
    out = nodes.withColumn("component", F.col("id"))
    for up in maps:
        out = out.join(up.select(F.col("id").alias("component"), "p"), "component", "left")
        out = out.select("id", F.coalesce("p", "component").alias("component"))
    return out
