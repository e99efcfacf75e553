"""Stored epochs and runs: indexes, exclusions, staleness, manifests, append-only scores, validation."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; below a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/epochlake-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that they are computed once and survive lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a label file holds.
LABELS = "blocks array<struct<Exec_Block_Index: long, type: string>>"


def epoch_index(spark: SparkSession, root: str, step: str, files: str = "S_*/Trial_*/labels.json") -> DataFrame:
    """One row per block of the label files below root, in key order; their path holds S_<n>/ and Trial_<n>/.

    A file is one JSON value, which one task reads whole.
    """
    raw = spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/{files}")
    return indexed(raw.select(F.input_file_name().alias("path"), "blocks"), step)


def packed_index(files: DataFrame, step: str) -> DataFrame:
    """The same from label files that are packed as rows of a table: path, value (the JSON text, or a part of its blocks).

    Folders and files cost as much as many rows, so trials that grow with the input are kept in this form.
    """
    return indexed(files.select("path", F.from_json("value", LABELS)["blocks"].alias("blocks")), step)


def indexed(labels: DataFrame, step: str) -> DataFrame:
    rows = labels.select("path", F.explode("blocks").alias("b"))
    number = lambda what: F.regexp_extract("path", rf"{what}_(-?\d+)/", 1).try_cast("long")
    block = F.col("b.Exec_Block_Index").cast("long")
    name = lambda kind: F.concat(F.lit(f"{step}_{kind}_"), block.cast("string"), F.lit(".fif"))
    return rows.select(number("S").alias("subject_id"), number("Trial").alias("trial_number"), block.alias("block_index"), F.col("b.type").alias("type"), name("EEG").alias("eeg_file"), name("EOG").alias("eog_file")).orderBy("subject_id", "trial_number", "block_index")


def exclude(df: DataFrame, what: dict[int, list[int]]) -> DataFrame:
    """Without whole subjects (empty list) or named trials."""
    out = df
    for subject, trials in what.items():
        hit = F.col("subject") == subject
        out = out.where(~(hit & F.col("trial").isin(trials)) if trials else ~hit)
    return out


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def materialize(df: DataFrame, root: str, config: dict) -> DataFrame:
    """Write once under the hash of a configuration and read it back; a stored table is reused."""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{config_hash(config)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def stale(sources: DataFrame, manifest: DataFrame, *signature: str) -> DataFrame:
    """Sources without a manifest row of the same signature."""
    same = [sources[c].eqNullSafe(manifest[c]) for c in signature]
    return sources.join(manifest, same, "left_anti")


def disagreements(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Missing, unexpected, resized and altered files: path, problem."""
    f, m = files.alias("f"), manifest.alias("m")
    j = f.join(m, F.col("f.path") == F.col("m.path"), "full")
    problem = F.when(F.col("f.path").isNull(), "missing").when(F.col("m.path").isNull(), "unexpected").when(F.col("f.size") != F.col("m.size"), "size").when(F.col("f.sha256") != F.col("m.sha256"), "hash")
    return j.select(F.coalesce("f.path", "m.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def file_table(spark: SparkSession, path: str, names: str = "part-*") -> DataFrame:
    """Path, size and sha256 of the data files below path. A file is hashed by one task, which holds it: tables are written
    in files of bounded size (see in_files), and one beyond spark.sql.sources.binaryFile.maxLength is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


#: Bytes of text that one data file holds about.
FILE_BYTES = 32 << 20


def in_files(rows: DataFrame, text: str, key: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows dealt by their key to as many partitions as files of file_bytes of text take."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(1, -(-total // file_bytes)), key)


def folder_table(files: DataFrame, folder: str) -> DataFrame:
    """Path, size and sha256 of whole folders, from a file_table: the digest is that of the set of their files' hashes.

    folder is a regular expression whose group is the folder's path. Which file holds which hash doesn't count.
    """
    own = files.select(F.regexp_extract("path", folder, 1).alias("path"), "size", "sha256")
    digests = set_digests(own, "path", "size", "sha256").where("node = ''").select("path", F.col("digest").alias("sha256"))
    return own.groupBy("path").agg(F.sum("size").alias("size")).join(digests, "path")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table or folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def append_scores(scores: DataFrame, path: str) -> None:
    """Append runs to a table partitioned by run_id; a run that stands there already is an error."""
    spark = scores.sparkSession
    try:
        there = spark.read.parquet(path).select("run_id").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        there = None
    if there is not None and not scores.select("run_id").distinct().join(there, "run_id", "left_semi").isEmpty():
        raise ValueError("a run exists already")
    scores.write.mode("append").partitionBy("run_id").parquet(path)


def run_state(expected: DataFrame, there: DataFrame) -> str:
    """'reuse' if all expected runs stand there, 'run' if none; some are an error."""
    n = expected.select("run_id").distinct().count()
    found = expected.select("run_id").distinct().join(there.select("run_id").distinct(), "run_id", "left_semi").count()
    if 0 < found < n:
        raise ValueError(f"{found} of {n} expected runs are there")
    return "reuse" if found else "run"


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unpaired(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    return a.join(b, list(key), "left_anti")


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def comparison_frame(runs: DataFrame) -> DataFrame:
    """A row for each model and for each contrast of two models over their common subjects: kind, name, n, value, better.

    runs has subject, run_id, ba. value is the mean of a model, or the mean difference of the later named model from
    the earlier; better is the share of subjects with a larger value. Subjects without a value are left out.
    """
    model = runs.groupBy("run_id").agg(F.count("ba").alias("n"), F.round(F.avg("ba"), 6).alias("value"))
    model = model.select(F.lit("model").alias("kind"), F.col("run_id").alias("name"), "n", "value", F.lit(None).cast("double").alias("better"))
    x, y = (runs.where("ba IS NOT NULL").select("subject", F.col("run_id").alias(f"run_{s}"), F.col("ba").alias(f"ba_{s}")) for s in "xy")
    pairs = x.join(y, "subject").where("run_x < run_y").groupBy("run_x", "run_y")
    contrast = pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.col("ba_y") - F.col("ba_x")), 6).alias("value"), F.round(F.avg((F.col("ba_y") > F.col("ba_x")).cast("double")), 6).alias("better"))
    return model.unionByName(contrast.select(F.lit("contrast").alias("kind"), F.concat("run_y", F.lit("-"), "run_x").alias("name"), "n", "value", "better"))


#: 64-bit words of a row's MD5 that are summed, and their modulus: sums don't depend on order or partitioning.
WORDS, MODULUS = 2, "18446744073709551616"


def set_digests(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Digests of each group's set of rows as a tree of 256 leaves and 16 inner nodes: group, node, n, digest.

    A row belongs to the leaf that the first two digits of its MD5 name. A leaf's digest is of the row count and the sums
    of its rows' hashes, so rows are summed where they lie and never gathered; inner nodes (one digit) and the root ('')
    digest their children. Equal sets have equal digests whatever their partitioning, and where sets differ the leaves
    that differ name the rows to look at. Repeated rows count each; nulls count as values.
    """
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))
    md5 = rows.select(group, F.md5(text).alias("h"))
    word = lambda k: F.conv(F.substring("h", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")
    sums = [(F.sum(word(k)) % F.lit(MODULUS).cast("decimal(38,0)")).cast("decimal(20,0)").cast("string").alias(f"s{k}") for k in range(WORDS)]
    leaves = md5.groupBy(group, F.substring("h", 1, 2).alias("node")).agg(F.count("*").alias("n"), *sums)
    leaves = kept(leaves.select(group, "node", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(f"s{k}" for k in range(WORDS))), 256).alias("digest")))
    out, level = leaves, leaves
    for digits in (1, 0):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most sixteen
        up = level.groupBy(group, F.substring("node", 1, digits).alias("up")).agg(F.sum("n").alias("n"), children.alias("c"))
        level = up.select(group, F.col("up").alias("node"), "n", F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["node"], F.lit(":"), x["digest"])), "|"), 256).alias("digest"))
        out = out.unionByName(level)
    return out


def differing(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Leaves of set_digests that two sides don't share: group, node."""
    leaf = F.length("node") == 2
    one, two = (x.where(leaf).select(group, "node", "digest") for x in (a, b))
    return one.exceptAll(two).select(group, "node").union(two.exceptAll(one).select(group, "node")).distinct()
