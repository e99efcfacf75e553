"""Queries of per-channel features and local patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.operators import features, shape
from epochlake.plans.registry import query
from epochlake.sources.tables import N, epochs, sig1, with_

SAFE = "CASE WHEN {d} > 0 THEN {n} / {d} ELSE 0.0::DOUBLE END"
TIME_CTE = """
d AS (SELECT *, x - lag(x) OVER w AS dx, x - 2 * lag(x) OVER w + lag(x, 2) OVER w AS d2, CASE WHEN (x < 0) <> (lag(x) OVER w < 0) THEN 1.0 WHEN lag(x) OVER w IS NULL THEN NULL ELSE 0.0 END AS crossed FROM sig1 WINDOW w AS (PARTITION BY epoch_id ORDER BY t_idx)),
a AS (SELECT epoch_id, avg(x) AS mean, var_pop(x) AS variance, sqrt(avg(x * x)) AS rms, quantile_cont(x, 0.5) AS median, max(x) - min(x) AS p2p, avg(x) AS mu, avg(abs(dx)) AS ll, avg(CAST(crossed AS DOUBLE)) AS zcr, var_pop(dx) AS v1, var_pop(d2) AS v2 FROM d GROUP BY epoch_id),
m AS (SELECT s.epoch_id, quantile_cont(abs(s.x - a.median), 0.5) AS mad, avg(power(s.x - a.mu, 3)) AS m3, avg(power(s.x - a.mu, 4)) AS m4 FROM sig1 s JOIN a ON s.epoch_id = a.epoch_id GROUP BY s.epoch_id),
f AS (SELECT a.epoch_id, mean, variance, sqrt(variance) AS std, rms, median, mad, p2p AS peak_to_peak, CASE WHEN variance > 0 THEN m3 / power(variance, 1.5) ELSE 0.0 END AS skewness, CASE WHEN variance > 0 THEN m4 / (variance * variance) - 3 ELSE 0.0 END AS kurtosis, ll AS line_length, zcr AS zero_crossing_rate, CASE WHEN variance > 0 THEN sqrt(v1 / variance) ELSE 0.0 END AS mobility, CASE WHEN v1 > 0 AND variance > 0 THEN sqrt(v2 / v1) / sqrt(v1 / variance) ELSE 0.0 END AS complexity FROM a JOIN m ON a.epoch_id = m.epoch_id)"""


@query("t1_time_features", with_("sig1", more=TIME_CTE, sql="SELECT epoch_id, " + ", ".join(f"round({c}, 5) AS {c}" for c in features.TIME_FEATURES) + " FROM f"))
def t1(spark, sf):
    f = features.time_features(sig1(spark, sf), "epoch_id")
    return f.select("epoch_id", *(F.round(c, 5).alias(c) for c in features.TIME_FEATURES))


@query("t1_label_feature_means", with_("sig1", more=TIME_CTE, sql="SELECT e.label, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in features.TIME_FEATURES) + " FROM f JOIN (SELECT vec_id, label FROM embeddings) e ON f.epoch_id = e.vec_id GROUP BY e.label"))
def t1_label(spark, sf):
    f = features.time_features(sig1(spark, sf), "epoch_id").join(epochs(spark, sf), "epoch_id")
    return f.groupBy("label").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in features.TIME_FEATURES))


def code_sql(kind: str, m: int) -> str:
    at = lambda k: f"lead(x, {k}) OVER w" if k else "x"
    near = [k for k in range(m + 1) if k != m // 2]
    gap = {k: f"abs({at(k)} - {at(m // 2)})" for k in near}
    if kind == "lndp":
        bits = [f"{at(k + 1)} >= {at(k)}" for k in range(m)]
    elif kind == "lbp":
        bits = [f"{at(k)} >= {at(m // 2)}" for k in near]
    else:
        mean = "(" + " + ".join(gap.values()) + f") / {m}"
        bits = [f"{gap[k]} >= {mean}" for k in near]
    code = " + ".join(f"CASE WHEN {bit} THEN {2 ** (m - 1 - k)} ELSE 0 END" for k, bit in enumerate(bits))
    return f"SELECT epoch_id, t_idx, CAST({code} AS BIGINT) AS code, {at(m)} AS far FROM sig1 WINDOW w AS (PARTITION BY epoch_id ORDER BY t_idx)"


def _codes(kind):
    def run(spark, sf):
        return features.pattern_codes(sig1(spark, sf), 6, kind, "epoch_id")

    return run


for _name, _kind in (("t5_lndp_codes", "lndp"), ("t6_lgp_codes", "lgp"), ("t7_lbp_codes", "lbp")):
    query(_name, with_("sig1", sql=f"SELECT epoch_id, t_idx, code FROM ({code_sql(_kind, 6)}) WHERE far IS NOT NULL"))(_codes(_kind))

HIST = "SELECT e.epoch_id, b.code, round(coalesce(c.n, 0) / CAST(e.total AS DOUBLE), 6) AS value FROM (SELECT epoch_id, count(*) AS total FROM {t} GROUP BY epoch_id) e CROSS JOIN (SELECT CAST(unnest(range(0, {bins})) AS BIGINT) AS code) b LEFT JOIN (SELECT epoch_id, code, count(*) AS n FROM {t} GROUP BY epoch_id, code) c ON c.epoch_id = e.epoch_id AND c.code = b.code"


@query("t8_code_histogram", with_("sig1", more=f"c4 AS (SELECT epoch_id, code FROM ({code_sql('lbp', 4)}) WHERE far IS NOT NULL)", sql=HIST.format(t="c4", bins=16)))
def t8(spark, sf):
    h = features.code_histogram(features.pattern_codes(sig1(spark, sf), 4, "lbp", "epoch_id"), 4, "epoch_id")
    return h.withColumn("value", F.round("value", 6))


PATTERNS = ", ".join(f"{k} AS (SELECT epoch_id, code FROM ({code_sql(k, 4)}) WHERE far IS NOT NULL)" for k in ("lndp", "lgp", "lbp"))


@query("t9_local_pattern_features", with_("sig1", more=PATTERNS, sql=" UNION ALL ".join(f"SELECT epoch_id, '{k}:code_' || lpad(CAST(code AS VARCHAR), 2, '0') AS feature, value FROM ({HIST.format(t=k, bins=16)})" for k in ("lndp", "lgp", "lbp"))))
def t9(spark, sf):
    return features.local_patterns(sig1(spark, sf), 4, "epoch_id").withColumn("value", F.round("value", 6))


ERP = "SELECT epoch_id, 'waveform:' || channel || ':sample_' || CAST(t_idx AS VARCHAR) AS feature, round(x, 6) AS value FROM sig1 WHERE t_idx % 8 = 0 UNION ALL SELECT epoch_id, 'window_mean:' || channel || ':' || CAST(t_idx // 32 AS VARCHAR), round(avg(x), 6) FROM sig1 GROUP BY epoch_id, channel, t_idx // 32"


@query("t10_erp_matrix", with_("sig1", sql=ERP))
def t10(spark, sf):
    s = sig1(spark, sf)
    wave = shape.every(s, 8).select("epoch_id", F.format_string("waveform:%s:sample_%d", "channel", "t_idx").alias("feature"), F.round("x", 6).alias("value"))
    mean = shape.interval_means(s, [(0.0, 0.5), (0.5, 1.0)], 64, N)
    return wave.unionByName(mean.select("epoch_id", F.format_string("window_mean:%s:%d", "channel", "interval").alias("feature"), F.round("x", 6).alias("value")))


@query("t11_feature_set", with_("sig1", more=TIME_CTE, sql=" UNION ALL ".join(f"SELECT epoch_id, 'time' AS block, '{c}' AS feature, {k} AS ordinal, round({c}, 5) AS value FROM f" for k, c in enumerate(features.TIME_FEATURES))))
def t11(spark, sf):
    f = features.long_form(features.time_features(sig1(spark, sf), "epoch_id"), "epoch_id")
    return f.withColumn("value", F.round("value", 5))


@query("t14_select_blocks", with_("sig1", more=TIME_CTE, sql="SELECT 'time' AS block, 0 AS block_order, count(*) AS n, round(sum(round(mean, 6)), 4) AS total FROM f"))
def t14(spark, sf):
    f = features.long_form(features.time_features(sig1(spark, sf), "epoch_id"), "epoch_id")
    s = features.select_blocks(f, ["time"]).where("feature = 'mean'")
    return s.groupBy("block", "block_order").agg(F.count("*").alias("n"), F.round(F.sum(F.round("value", 6)), 4).alias("total"))


@query("t16_project_matrix", with_("sig1", sql="SELECT epoch_id, CAST(count(*) AS BIGINT) AS width, round(max(x), 6) AS largest, round(min(x), 6) AS smallest FROM sig1 WHERE t_idx % 4 = 0 GROUP BY epoch_id"))
def t16(spark, sf):
    w = shape.every(sig1(spark, sf), 4).select("epoch_id", F.lit("waveform").alias("block"), F.col("t_idx").alias("ordinal"), F.format_string("s%d", "t_idx").alias("feature"), F.col("x").alias("value"))
    m = features.feature_matrix(w, "epoch_id")
    return m.select("epoch_id", F.size("names").cast("long").alias("width"), F.round(F.array_max("features"), 6).alias("largest"), F.round(F.array_min("features"), 6).alias("smallest"))


@query("s6_feature_matrix_export", with_("sig1", more=TIME_CTE, sql="SELECT epoch_id, round(mean, 6) AS mean, round(rms, 6) AS rms, round(std, 6) AS std FROM f"))
def s6(spark, sf):
    f = features.long_form(features.time_features(sig1(spark, sf), "epoch_id"), "epoch_id").where(F.col("feature").isin("mean", "rms", "std"))
    p = f.groupBy("epoch_id").pivot("feature", ["mean", "rms", "std"]).agg(F.first("value"))
    return p.select("epoch_id", *(F.round(c, 6).alias(c) for c in ("mean", "rms", "std")))


WIN = "win AS (SELECT epoch_id, w.win, x FROM sig1 JOIN (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS win) w ON t_idx >= w.win * 16 AND t_idx < w.win * 16 + 32)"


@query("t17_window_vs_full", with_("sig1", more=f"{WIN}, wf AS (SELECT epoch_id, win, avg(x) AS mean, max(x) - min(x) AS p2p FROM win GROUP BY epoch_id, win), ff AS (SELECT epoch_id, avg(x) AS mean, max(x) - min(x) AS p2p FROM sig1 GROUP BY epoch_id)", sql="SELECT ff.epoch_id, round(max(abs(wf.mean - ff.mean)), 6) AS mean_gap, round(max(abs(wf.p2p - ff.p2p)), 6) AS p2p_gap, round(max(wf.mean) - min(wf.mean), 6) AS mean_range FROM wf JOIN ff ON wf.epoch_id = ff.epoch_id GROUP BY ff.epoch_id"))
def t17(spark, sf):
    s = sig1(spark, sf)
    stats = [F.avg("x").alias("mean"), (F.max("x") - F.min("x")).alias("p2p")]
    part = shape.windows(s, N, 32, 16).groupBy("epoch_id", "win").agg(*stats)
    full = s.groupBy("epoch_id").agg(*(c.alias(n) for c, n in zip(stats, ("mean0", "p2p0"), strict=True)))
    j = part.join(full, "epoch_id").groupBy("epoch_id")
    return j.agg(F.round(F.max(F.abs(F.col("mean") - F.col("mean0"))), 6).alias("mean_gap"), F.round(F.max(F.abs(F.col("p2p") - F.col("p2p0"))), 6).alias("p2p_gap"), F.round(F.max("mean") - F.min("mean"), 6).alias("mean_range"))


@query("t19_top_codes", with_("sig1", more=f"c4 AS (SELECT epoch_id, code FROM ({code_sql('lbp', 4)}) WHERE far IS NOT NULL), h AS ({HIST.format(t='c4', bins=16)})", sql="SELECT epoch_id, code, value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY value DESC, code) AS r FROM h) WHERE r <= 3"))
def t19(spark, sf):
    h = features.code_histogram(features.pattern_codes(sig1(spark, sf), 4, "lbp", "epoch_id"), 4, "epoch_id").withColumn("value", F.round("value", 6))
    return features.top_codes(h, 3, "epoch_id")
