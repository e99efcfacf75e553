"""Queries of operators that share a definition with another row of the inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochlake.functions.columns import safe_div
from epochlake.operators import features, metrics, models, shape, targets as op
from epochlake.plans.evaluation import BA, SUMS, r6
from epochlake.plans.experiment import dealt_sql
from epochlake.plans.registry import query
from epochlake.sources.tables import FS, class_scores, epochs, read, scores, sig1, sig4, with_


@query("s5_load_binary_epochs", "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, CAST(row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch_index FROM events")
def s5(spark, sf):
    e = read(spark, sf, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return op.number_within(e, "user_id", "y", order=("ts", "event_id")).select("event_id", "user_id", "y", "epoch_index")


@query("w3_spectral_crop", with_("sig4", sql="SELECT epoch_id, channel, t_idx, round(x, 6) AS x FROM sig4 WHERE t_idx >= 4 AND t_idx < 12"))
def w3(spark, sf):
    return shape.crop(sig4(spark, sf), 0.25, 0.75, 16).select("epoch_id", "channel", "t_idx", F.round("x", 6).alias("x"))


@query("w11_pad_collate_arrays", "WITH a AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey), m AS (SELECT max(len(v)) AS m FROM a) SELECT o_custkey, CAST(len(v) AS BIGINT) AS length, CAST(m AS BIGINT) AS padded, round(list_sum(v), 2) AS total FROM a, m")
def w11(spark, sf):
    a = read(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"].cast("double")).alias("v"))
    p = shape.pad_right(a.crossJoin(F.broadcast(a.agg(F.max(F.size("v")).alias("longest")))), "v", F.col("longest"))
    return p.select("o_custkey", "length", F.size("v").cast("long").alias("padded"), F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 2).alias("total"))


@query("t4_safe_div", "SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END), 4) AS total FROM lineitem GROUP BY l_returnflag")
def t4(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(safe_div(F.col("l_tax"), F.col("l_discount"))), 4).alias("total"))


@query("t12_cropped_features", with_("sig1", sql="SELECT epoch_id, round(avg(x), 6) AS mean, round(sqrt(avg(x * x)), 6) AS rms, round(max(x) - min(x), 6) AS peak_to_peak FROM sig1 WHERE t_idx < 32 GROUP BY epoch_id"))
def t12(spark, sf):
    f = features.time_features(shape.crop(sig1(spark, sf), 0.0, 0.5, FS), "epoch_id")
    return r6(f.select("epoch_id", "mean", "rms", "peak_to_peak"), "mean", "rms", "peak_to_peak")


@query("g7_leave_one_fold_out", with_("class_scores", sql="SELECT d.fold AS direction, CASE WHEN c.fold = d.fold THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM class_scores c CROSS JOIN (SELECT DISTINCT fold FROM class_scores) d GROUP BY d.fold, CASE WHEN c.fold = d.fold THEN 'test' ELSE 'train' END"))
def g7(spark, sf):
    return op.leave_one_out_counts(class_scores(spark, sf), "fold")


@query("g14_train_group_kfold", with_("epochs", sql=f"SELECT e.*, CAST(p.fold AS INTEGER) AS fold FROM epochs e JOIN (VALUES {dealt_sql([s for s in range(10) if s % 3], 3)}) p(subject, fold) ON e.subject = p.subject"))
def g14(spark, sf):
    return op.group_kfold(epochs(spark, sf).where("subject % 3 <> 0"), "subject", 3, 42)


@query("g17_align_candidates", with_("sig1", sql="SELECT s.epoch_id, f.family, count(*) AS n, round(sum(s.x), 6) AS total FROM sig1 s JOIN (SELECT 'early' AS family, 'b0' AS block UNION ALL SELECT 'early', 'b1' UNION ALL SELECT 'late', 'b3') f ON f.block = 'b' || CAST(s.t_idx // 16 AS VARCHAR) GROUP BY s.epoch_id, f.family"))
def g17(spark, sf):
    families = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for x in ("b0", ["early"], "b1", ["early"], "b3", ["late"])))
    block = F.concat(F.lit("b"), F.floor(F.col("t_idx") / 16).cast("string"))
    long = sig1(spark, sf).withColumn("family", F.explode(families[block]))
    return long.groupBy("epoch_id", "family").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


@query("e14_validation_balanced_accuracy", with_("scores", more=f"c AS (SELECT run_id, task, {SUMS} FROM scores WHERE key % 5 = 1 GROUP BY run_id, task)", sql=f"SELECT run_id, round(avg({BA}), 6) AS balanced_accuracy FROM c WHERE tp + fn > 0 AND tn + fp > 0 GROUP BY run_id"))
def e14(spark, sf):
    m = metrics.task_metrics(scores(spark, sf).where("key % 5 = 1"), "run_id", "task").where("balanced_accuracy IS NOT NULL")
    return m.groupBy("run_id").agg(F.round(F.avg("balanced_accuracy"), 6).alias("balanced_accuracy"))


@query("m16_screen_regression", with_("scores", more=f"c AS (SELECT run_id AS family, task, {SUMS}, avg((least(1, greatest(0, 1.4 * score - 0.2)) - y) * (least(1, greatest(0, 1.4 * score - 0.2)) - y)) AS mse FROM scores GROUP BY run_id, task), f AS (SELECT family, round(avg({BA}), 9) AS ba, round(avg(mse), 9) AS mse FROM c GROUP BY family)", sql="SELECT family, round(ba, 6) AS ba, round(mse, 6) AS mse, CAST(row_number() OVER (ORDER BY ba DESC, mse, family) AS INTEGER) AS rank FROM f"))
def m16(spark, sf):
    s = scores(spark, sf).withColumnRenamed("run_id", "family")
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.4 * F.col("score") - 0.2)) - F.col("y")
    loss = s.groupBy("family", "task").agg(F.avg(d * d).alias("mse"))
    f = metrics.task_metrics(s, "family", "task").join(loss, ["family", "task"]).groupBy("family").agg(F.round(F.avg("balanced_accuracy"), 9).alias("ba"), F.round(F.avg("mse"), 9).alias("mse"))
    w = Window.orderBy(F.desc("ba"), "mse", "family")  # one row per family
    return f.select("family", F.round("ba", 6).alias("ba"), F.round("mse", 6).alias("mse"), F.row_number().over(w).alias("rank"))


@query("m14_sgd_hinge")
def m14(spark, sf):
    line = read(spark, sf, "lineitem").select(F.col("l_discount").alias("x1"), (F.col("l_quantity") / 50).alias("x2"), (F.col("l_returnflag") == "R").cast("double").alias("y1"))
    return models.fit_ml(line, ["x1", "x2"], ["y1"], "svm")
