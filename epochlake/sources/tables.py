"""Input tables in the roles that the operators expect, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlake.operators.running import numbered

#: Samples per second and per epoch of the stand-in recordings.
FS = 64
N = 64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def sig1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-channel epochs in long form: epoch_id, channel, t_idx, x."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("epoch_id"), F.lit("c0").alias("channel"), F.posexplode("embedding").alias("t_idx", "x"))
    return v.withColumn("x", F.col("x").cast("double"))


def sig4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-channel epochs of 16 samples: epoch_id, channel, ch_idx, t_idx, x."""
    v = sig1(spark, sf_dir).withColumn("ch_idx", F.floor(F.col("t_idx") / 16).cast("int"))
    return v.select("epoch_id", F.concat(F.lit("c"), F.col("ch_idx").cast("string")).alias("channel"), "ch_idx", (F.col("t_idx") % 16).alias("t_idx"), "x")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch attributes: epoch_id, subject, trial, label."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("epoch_id"), (F.col("vec_id") % 10).alias("subject"), (1 + F.floor(F.col("vec_id") / 10) % 2).alias("trial"), "label")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binary tasks: key, subject, task, y."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("subject"))
    y = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (task, y)"))
    return d.join(y, "key").select("key", "subject", "task", F.col("y").cast("int").alias("y"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two runs on the tasks: run_id, key, subject, task, y, score, pred."""
    n = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "n_chars")
    t = targets(spark, sf_dir).join(n, "key")
    runs = t.select("*", F.expr("stack(2, 'a', (n_chars % 100) / 100D, 'b', ((n_chars + key) % 100) / 100D) AS (run_id, score)"))
    return runs.select("run_id", "key", "subject", "task", "y", "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


def scores_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on order lines: key (four columns), subject, task, y, score, pred."""
    line = read(spark, sf_dir, "lineitem")
    score = F.col("l_discount") * 10
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_suppkey").alias("subject"), F.col("l_linestatus").alias("task"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(score, 6).alias("score"), (F.round(score, 6) >= 0.5).cast("int").alias("pred"))


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes: key, fold, y, pred (0..4), from the event types and a fixed function of the id."""
    e = read(spark, sf_dir, "events")
    names = F.array_sort(F.collect_set("event_type"))
    classes = e.agg(names.alias("names")).select(F.posexplode("names").alias("y", "event_type"))
    own = e.join(F.broadcast(classes), "event_type")
    pred = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).otherwise(F.col("y")).cast("int")
    return own.select(F.col("event_id").alias("key"), (F.col("user_id") % 10).alias("fold"), F.col("y").cast("int").alias("y"), pred.alias("pred"))


def events_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One irregular signal per user: user_id, t_idx, value."""
    e = read(spark, sf_dir, "events").select("user_id", "value", "event_id", "ts")
    return numbered(e, ("user_id",), ("ts", "event_id"), "t_idx").withColumn("t_idx", F.col("t_idx").cast("int"))


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long numeric features of order lines: key, feature, value, y, n rows per key one each."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.expr("stack(4, 'discount', l_discount, 'extendedprice', l_extendedprice, 'quantity', l_quantity, 'tax', l_tax) AS (feature, value)"),
    )


#: SQL of the same roles, by name; with_() puts those that a query names before it.
ROLES = {
    "sig1": "SELECT vec_id AS epoch_id, 'c0' AS channel, CAST(u.i - 1 AS INTEGER) AS t_idx, CAST(u.x AS DOUBLE) AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, i)",
    "sig4": "SELECT vec_id AS epoch_id, 'c' || CAST((u.i - 1) // 16 AS VARCHAR) AS channel, CAST((u.i - 1) // 16 AS INTEGER) AS ch_idx, CAST((u.i - 1) % 16 AS INTEGER) AS t_idx, CAST(u.x AS DOUBLE) AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, i)",
    "epochs": "SELECT vec_id AS epoch_id, vec_id % 10 AS subject, 1 + (vec_id // 10) % 2 AS trial, label FROM embeddings",
    "targets": "SELECT l.doc_id AS key, d.source AS subject, 'quality' AS task, CAST(l.quality AS INTEGER) AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id UNION ALL SELECT l.doc_id, d.source, 'toxic', CAST(l.toxic AS INTEGER) FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "scores0": "SELECT 'a' AS run_id, t.key, t.subject, t.task, t.y, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS score FROM targets t JOIN documents d ON t.key = d.doc_id UNION ALL SELECT 'b', t.key, t.subject, t.task, t.y, CAST((d.n_chars + t.key) % 100 AS DOUBLE) / 100 FROM targets t JOIN documents d ON t.key = d.doc_id",
    "scores": "SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores0",
    "scores_big": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS subject, l_linestatus AS task, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(l_discount * 10, 6) AS score, CASE WHEN round(l_discount * 10, 6) >= 0.5 THEN 1 ELSE 0 END AS pred FROM lineitem",
    "class_names": "SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS y FROM (SELECT DISTINCT event_type FROM events)",
    "class_scores": "SELECT e.event_id AS key, e.user_id % 10 AS fold, c.y, CAST(CASE WHEN e.event_id % 3 = 0 THEN e.event_id % 5 ELSE c.y END AS INTEGER) AS pred FROM events e JOIN class_names c ON e.event_type = c.event_type",
    "events_sig": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t_idx, value, event_id, ts FROM events",
    "part_features": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, '{c}' AS feature, l_{c} AS value FROM lineitem" for c in ("discount", "extendedprice", "quantity", "tax")),
}
NEEDS = {"scores0": ("targets",), "scores": ("targets", "scores0"), "class_scores": ("class_names",)}


def with_(*roles: str, sql: str, more: str = "") -> str:
    """A query with the roles it reads, and further common tables, before it."""
    names = list(dict.fromkeys(x for r in roles for x in (*NEEDS.get(r, ()), r)))
    parts = [f"{n} AS ({ROLES[n]})" for n in names] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
