"""Queries of epoch shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.operators import shape
from epochlake.plans.registry import query
from epochlake.sources.tables import FS, N, events_sig, read, sig1, with_

R = "round(x, 6) AS x"


@query("w1_crop", with_("sig1", sql="SELECT epoch_id, channel, t_idx, round(x, 6) AS x FROM sig1 WHERE t_idx >= 16 AND t_idx < 48"))
def w1(spark, sf):
    return shape.crop(sig1(spark, sf), 0.25, 0.75, FS).withColumn("x", F.round("x", 6))


@query("w2_window_layout", with_("sig1", sql="SELECT epoch_id, w.win, CAST(w.win * 8 AS INTEGER) AS lo, CAST(w.win * 8 + 16 AS INTEGER) AS hi, count(*) AS n, round(sum(x), 6) AS total FROM sig1 JOIN (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS win) w ON t_idx >= w.win * 8 AND t_idx < w.win * 8 + 16 GROUP BY epoch_id, w.win"))
def w2(spark, sf):
    w = shape.windows(sig1(spark, sf), N, 16, 8).groupBy("epoch_id", "win").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))
    return w.select("epoch_id", "win", (F.col("win") * 8).alias("lo"), (F.col("win") * 8 + 16).alias("hi"), "n", "total")


@query("w2_event_windows", with_("events_sig", more="uw AS (SELECT user_id, CAST(unnest(range(0, (count(*) - 20) // 10 + 1)) AS INTEGER) AS win FROM events_sig GROUP BY user_id HAVING count(*) >= 20)", sql="SELECT e.user_id, w.win, count(*) AS n, round(avg(e.value), 6) AS mean FROM events_sig e JOIN uw w ON e.user_id = w.user_id AND e.t_idx >= w.win * 10 AND e.t_idx < w.win * 10 + 20 GROUP BY e.user_id, w.win"))
def w2_events(spark, sf):
    events = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("events"))
    e = events_sig(spark, sf).join(events, "user_id")
    w = shape.windows(e, F.col("events"), 20, 10)
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("w4_trim_epoch", with_("sig1", sql="SELECT epoch_id, count(*) AS n, CAST(min(t_idx) AS INTEGER) AS first, CAST(max(t_idx) AS INTEGER) AS last, round(sum(x), 6) AS total FROM sig1 WHERE t_idx < 32 GROUP BY epoch_id"))
def w4(spark, sf):
    return shape.crop(sig1(spark, sf), 0.0, 0.5, FS).groupBy("epoch_id").agg(F.count("*").alias("n"), F.min("t_idx").alias("first"), F.max("t_idx").alias("last"), F.round(F.sum("x"), 6).alias("total"))


TAPS = ", ".join(f"({k}, CAST({t!r} AS DOUBLE))" for k, t in enumerate(shape.kaiser_taps(1, 2)))


@query("w5_resample", with_("sig1", more=f"taps(k, h) AS (VALUES {TAPS}), m AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS m)", sql="SELECT epoch_id, channel, m.m AS t_idx, round(sum(x * h), 6) AS x FROM sig1 CROSS JOIN m JOIN taps ON k = 20 + m.m * 2 - t_idx GROUP BY epoch_id, channel, m.m"))
def w5(spark, sf):
    return shape.resample(sig1(spark, sf), N, FS, FS // 2).withColumn("x", F.round("x", 6))


@query("w6_demean", with_("sig1", sql="SELECT epoch_id, channel, t_idx, round(x - avg(x) OVER (PARTITION BY epoch_id, channel), 6) AS x FROM sig1"))
def w6(spark, sf):
    return shape.demean(sig1(spark, sf)).withColumn("x", F.round("x", 6))


@query("w7_trim_and_bin", with_("sig1", sql="SELECT epoch_id, channel, CAST((t_idx - 7) // 7 AS INTEGER) AS bin, round(avg(x), 6) AS x, round((7 + ((t_idx - 7) // 7) * 7 + 3) / 64.0::DOUBLE, 6) AS t FROM sig1 WHERE t_idx >= 7 AND t_idx < 56 GROUP BY epoch_id, channel, (t_idx - 7) // 7"))
def w7(spark, sf):
    return shape.trim_and_bin(sig1(spark, sf), N, 5, 7, FS).withColumn("x", F.round("x", 6)).withColumn("t", F.round("t", 6))


@query("w8_waveform_stride", with_("sig1", sql="SELECT epoch_id, 'waveform:' || channel || ':sample_' || CAST(t_idx AS VARCHAR) AS feature, round(x, 6) AS value FROM sig1 WHERE t_idx % 4 = 0"))
def w8(spark, sf):
    name = F.format_string("waveform:%s:sample_%d", F.col("channel"), F.col("t_idx"))
    return shape.every(sig1(spark, sf), 4).select("epoch_id", name.alias("feature"), F.round("x", 6).alias("value"))


@query("w9_window_means", with_("sig1", more="b(interval, a, z) AS (VALUES (0, 0, 32), (1, 16, 48), (2, 32, 64))", sql="SELECT epoch_id, channel, interval, round(avg(x), 6) AS x FROM sig1 JOIN b ON t_idx >= a AND t_idx < z GROUP BY epoch_id, channel, interval"))
def w9(spark, sf):
    return shape.interval_means(sig1(spark, sf), [(0.0, 0.5), (0.25, 0.75), (0.5, 1.5)], FS, N).withColumn("x", F.round("x", 6))


@query("w10_pad_collate", "WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id), m AS (SELECT max(len(v)) AS m FROM a) SELECT user_id, CAST(len(v) AS BIGINT) AS length, CAST(m AS BIGINT) AS padded, CAST(m - len(v) AS BIGINT) AS zeros, round(list_sum(v), 4) AS total FROM a, m")
def w10(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("v"))
    longest = e.agg(F.max(F.size("v")).alias("longest"))
    p = shape.pad_right(e.crossJoin(F.broadcast(longest)), "v", F.col("longest"))
    total = F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 4)
    zeros = F.size(F.filter("mask", lambda b: ~b)).cast("long")
    return p.select("user_id", "length", F.size("v").cast("long").alias("padded"), zeros.alias("zeros"), total.alias("total"))


BATCHED = "a AS ({arrays}), k AS (SELECT *, length(bin(length)) AS digits FROM a WHERE length > 0), o AS (SELECT *, row_number() OVER (PARTITION BY digits ORDER BY length, {key}) - 1 AS place FROM k), b AS (SELECT *, CAST(place // greatest(1, {cells} // (pow(2, digits)::BIGINT - 1)) AS BIGINT) AS number FROM o) SELECT CAST(digits AS INTEGER) AS digits, number, count(*) AS arrays, CAST(max(length) AS BIGINT) AS padded, CAST(count(*) * max(length) AS BIGINT) AS cells, CAST(sum(length) AS BIGINT) AS samples, CAST(min({key}) AS BIGINT) AS first_key, round(sum(total), 2) AS total FROM b GROUP BY digits, number"


def batch_report(arrays, key, cells):
    b = shape.batches(arrays, "v", key, cells)
    samples = F.sum(F.size(F.filter("mask", lambda x: x))).alias("samples")
    total = F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda x, y: x + y)), 2).alias("total")
    out = b.groupBy("batch").agg(F.count("*").alias("arrays"), F.max("padded").alias("padded"), F.sum(F.size("v")).alias("cells"), samples, F.min(key).alias("first_key"), total)
    return out.select("batch.digits", "batch.number", "arrays", "padded", "cells", "samples", "first_key", "total")


@query("w10_padded_batches", "WITH " + BATCHED.format(arrays="SELECT user_id, count(*) AS length, sum(value) AS total FROM events GROUP BY user_id", key="user_id", cells=1000))
def w10_batches(spark, sf):
    """Users' values in batches of like length with about 1000 cells."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"].cast("double")).alias("v"))
    return batch_report(e, "user_id", 1000)


@query("w11_padded_batches", "WITH " + BATCHED.format(arrays="SELECT o_custkey, count(*) AS length, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey", key="o_custkey", cells=256))
def w11_batches(spark, sf):
    """Customers' orders in batches of like length with about 256 cells."""
    a = read(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"].cast("double")).alias("v"))
    return batch_report(a, "o_custkey", 256)
