"""Queries that run the streaming operators over a table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.plans.evaluation import r6
from epochlake.plans.registry import query
from epochlake.operators.store import scratch
from epochlake.streaming import live


@query("l1_stream_windows", "SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS range FROM events GROUP BY user_id, time_bucket(INTERVAL '6 hours', ts)")
def l1(spark, sf):
    e = live.stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = live.windowed(e, "6 hours", "6 hours", "60 days")
    return r6(live.drained(w, "complete", scratch(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")), "mean", "std", "range")


PAST = "past AS (SELECT user_id, value, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t_idx FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 600000), wins AS (SELECT user_id, CAST(unnest(range(0, (count(*) - 20) // 10 + 1)) AS INTEGER) AS win FROM past GROUP BY user_id HAVING count(*) >= 20)"


@query("l1_sample_windows", f"WITH {PAST} SELECT p.user_id, w.win, min(p.ts) AS start, count(p.value) AS n, round(avg(p.value), 6) AS mean, round(stddev_pop(p.value), 6) AS std, round(sqrt(avg(p.value * p.value)), 6) AS rms, round(max(p.value) - min(p.value), 6) AS range FROM past p JOIN wins w ON p.user_id = w.user_id AND p.t_idx >= w.win * 10 AND p.t_idx < w.win * 10 + 20 GROUP BY p.user_id, w.win")
def l1_samples(spark, sf):
    """Windows of 20 samples every 10 of each user, as far as the watermark has come."""
    live.with_state_files(spark)
    e = live.stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = live.drained(live.sample_windows(e, 20, 10), "append", scratch(spark))
    return r6(w.withColumn("start", F.col("start").cast("timestamp_ntz")), "mean", "std", "rms", "range").select("user_id", "win", "start", "n", "mean", "std", "rms", "range")


@query("l2_stream_metrics", "SELECT l_linestatus AS task, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN l_returnflag = 'R' AND l_discount < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN l_returnflag <> 'R' AND l_discount < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN l_returnflag <> 'R' AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS fp FROM lineitem GROUP BY l_linestatus")
def l2(spark, sf):
    s = live.stream_of(spark, sf, "lineitem").select(F.col("l_linestatus").alias("task"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("pred"))
    return live.drained(live.running_confusion(s), "complete", scratch(spark))


@query("l3_stream_dedup_fingerprint", "SELECT sha256(text) AS fp FROM documents GROUP BY sha256(text)")
def l3(spark, sf):
    d = live.stream_of(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("fp"), F.timestamp_seconds(1_600_000_000 + F.col("doc_id") % 1000).alias("ts"))
    return live.drained(live.first_fingerprints(d, "365 days"), "append", scratch(spark)).select("fp")
