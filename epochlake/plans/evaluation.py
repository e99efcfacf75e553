"""Queries of metrics, calibration, baselines, resampling and comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochlake.functions.columns import flag, logistic
from epochlake.operators import checks, metrics, resample
from epochlake.operators.store import set_digests
from epochlake.plans.registry import query
from epochlake.sources.tables import class_scores, scores, scores_big, with_

SUMS = "sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp"
BA = "(CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2"
F1 = "(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / CAST(2 * tn + fp + fn AS DOUBLE) ELSE 0 END) / 2"
CONF = "c AS (SELECT run_id, task, " + SUMS + " FROM scores GROUP BY run_id, task)"


def r6(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query("e1_task_balanced_accuracy", with_("scores", more=CONF, sql=f"SELECT run_id, task, round({BA}, 6) AS balanced_accuracy FROM c"))
def e1(spark, sf):
    return r6(metrics.task_metrics(scores(spark, sf), "run_id", "task").drop("macro_f1"), "balanced_accuracy")


@query("e2_task_macro_f1", with_("scores", more=CONF, sql=f"SELECT run_id, task, round({F1}, 6) AS macro_f1 FROM c"))
def e2(spark, sf):
    return r6(metrics.task_metrics(scores(spark, sf), "run_id", "task").drop("balanced_accuracy"), "macro_f1")


@query("e1_big_balanced_accuracy", with_("scores_big", more=f"c AS (SELECT task, {SUMS} FROM scores_big GROUP BY task)", sql=f"SELECT task, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round({BA}, 6) END AS balanced_accuracy FROM c"))
def e1_big(spark, sf):
    return r6(metrics.task_metrics(scores_big(spark, sf), "task").drop("macro_f1"), "balanced_accuracy")


@query("e3_brier", with_("scores", sql="SELECT run_id, round(avg((score - y) * (score - y)), 6) AS brier FROM scores GROUP BY run_id"))
def e3(spark, sf):
    return r6(metrics.brier(scores(spark, sf), "run_id"), "brier")


SAMPLE = "p AS (SELECT run_id, key, sum(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS i, sum(CASE WHEN y = 1 OR pred = 1 THEN 1 ELSE 0 END) AS u, sum(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS wrong, count(*) AS n FROM scores GROUP BY run_id, key)"


@query("e4_iou", with_("scores", more=SAMPLE, sql="SELECT run_id, round(avg(CASE WHEN u = 0 THEN 1.0 ELSE CAST(i AS DOUBLE) / u END), 6) AS sample_iou, round(CAST(sum(i) AS DOUBLE) / sum(u), 6) AS micro_iou FROM p GROUP BY run_id"))
def e4(spark, sf):
    return r6(metrics.sample_metrics(scores(spark, sf), "key", "run_id").select("run_id", "sample_iou", "micro_iou"), "sample_iou", "micro_iou")


@query("e5_bits", with_("scores", more=SAMPLE, sql="SELECT run_id, round(1 - CAST(sum(wrong) AS DOUBLE) / sum(n), 6) AS bit_accuracy, round(CAST(sum(wrong) AS DOUBLE) / sum(n), 6) AS hamming_loss, round(avg(CAST(wrong AS DOUBLE)), 6) AS hamming_distance, round(avg(CASE WHEN wrong = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM p GROUP BY run_id"))
def e5(spark, sf):
    names = ("bit_accuracy", "hamming_loss", "hamming_distance", "exact_match")
    return r6(metrics.sample_metrics(scores(spark, sf), "key", "run_id").select("run_id", *names), *names)


def multi(fold: str) -> str:
    k, g = (f"{fold}, ", f" GROUP BY {fold}") if fold else ("", "")
    on = f"AND a.{fold} = b.{fold}" if fold else ""
    sel = f"a.{fold} AS {fold}, " if fold else ""
    return f"t AS (SELECT {k}y AS c, count(*) AS n_real, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS tp FROM class_scores GROUP BY {k}y), s AS (SELECT {k}pred AS c, count(*) AS n_said FROM class_scores GROUP BY {k}pred), m AS (SELECT {sel}a.c, n_real, tp, coalesce(n_said, 0) AS n_said FROM t a LEFT JOIN s b ON a.c = b.c {on}), r AS (SELECT {k}round(CAST(sum(tp) AS DOUBLE) / sum(n_real), 6) AS accuracy, round(avg(CAST(tp AS DOUBLE) / n_real), 6) AS balanced_accuracy, round(sum(2.0 * tp / CAST(n_real + n_said AS DOUBLE)) / 5, 6) AS macro_f1 FROM m{g})"


@query("e6_multiclass_metrics", with_("class_scores", more=multi("fold"), sql="SELECT * FROM r"))
def e6(spark, sf):
    return r6(metrics.class_metrics(class_scores(spark, sf), 5, "fold"), "accuracy", "balanced_accuracy", "macro_f1")


@query("e6_confusion_matrix", with_("class_scores", sql="SELECT a.y, b.pred, coalesce(c.n, 0) AS n FROM (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS y) a CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS pred) b LEFT JOIN (SELECT y, pred, count(*) AS n FROM class_scores GROUP BY y, pred) c ON a.y = c.y AND b.pred = c.pred"))
def e6_matrix(spark, sf):
    return metrics.class_grid(class_scores(spark, sf).withColumn("all", F.lit(0)), 5, "all").drop("all")


@query("e7_binary_metrics", with_("scores", more=CONF, sql=f"SELECT run_id, task, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS target_recall, round(CAST(tn AS DOUBLE) / (tn + fp), 6) AS other_recall, round(CAST(tp + tn AS DOUBLE) / (tp + fn + tn + fp), 6) AS accuracy FROM c"))
def e7(spark, sf):
    c = metrics.confusion(scores(spark, sf), "run_id", "task")
    total = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    return r6(c.select("run_id", "task", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("target_recall"), (F.col("tn") / (F.col("tn") + F.col("fp"))).alias("other_recall"), ((F.col("tp") + F.col("tn")) / total).alias("accuracy")), "target_recall", "other_recall", "accuracy")


AUC = "s AS (SELECT {k}, score, sum(y) AS pos, sum(1 - y) AS neg FROM {t} GROUP BY {k}, score), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)"


@query("e8_roc_auc", with_("scores", more=AUC.format(k="run_id, task", t="scores"), sql="SELECT run_id, task, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM b GROUP BY run_id, task"))
def e8(spark, sf):
    return r6(metrics.roc_auc(scores(spark, sf), "run_id", "task"), "roc_auc")


@query("e8_big_roc_auc", with_("scores_big", more=AUC.format(k="task", t="scores_big"), sql="SELECT task, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) END AS roc_auc FROM b GROUP BY task"))
def e8_big(spark, sf):
    return r6(metrics.roc_auc(scores_big(spark, sf), "task"), "roc_auc")


@query("e9_average_precision", with_("scores", more="s AS (SELECT run_id, task, score, sum(y) AS pos, count(*) AS n FROM scores GROUP BY run_id, task, score), r AS (SELECT run_id, task, pos, CAST(sum(pos) OVER w AS DOUBLE) / sum(n) OVER w AS prec FROM s WINDOW w AS (PARTITION BY run_id, task ORDER BY score DESC))", sql="SELECT run_id, task, round(sum(pos * prec) / sum(pos), 6) AS average_precision FROM r GROUP BY run_id, task"))
def e9(spark, sf):
    return r6(metrics.average_precision(scores(spark, sf), "run_id", "task"), "average_precision")


@query("e10_fold_summary", with_("class_scores", more=multi("fold"), sql="SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM r"))
def e10(spark, sf):
    m = metrics.class_metrics(class_scores(spark, sf), 5, "fold").withColumn("accuracy", F.round("accuracy", 6))
    return m.agg(F.count("*").alias("folds"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_pop("accuracy"), 6).alias("std"))


@query("e11_row_normalized_confusion", with_("class_scores", sql="SELECT y, pred, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM class_scores GROUP BY y, pred"))
def e11(spark, sf):
    c = class_scores(spark, sf).groupBy("y", "pred").count()
    return c.select("y", "pred", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("y")), 6).alias("share"))


BIN = "edge AS (SELECT CAST(k AS INTEGER) AS k, CAST(k AS DOUBLE) / 10 AS e FROM unnest(range(0, 11)) AS g(k)), bn AS (SELECT run_id, score, y, least(9, (SELECT max(k) FROM edge WHERE e <= score)) AS bin FROM scores)"


@query("e12_calibration_bins", with_("scores", more=BIN, sql="SELECT run_id, bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM bn GROUP BY run_id, bin"))
def e12(spark, sf):
    return r6(metrics.calibration_bins(scores(spark, sf), 10, "run_id"), "mean_score", "rate")


@query("e12_calibration_error", with_("scores", more=BIN, sql="SELECT run_id, round(sum(n * abs(ms - rate)) / sum(n), 6) AS ece FROM (SELECT run_id, bin, count(*) AS n, avg(score) AS ms, avg(y) AS rate FROM bn GROUP BY run_id, bin) GROUP BY run_id"))
def e12_ece(spark, sf):
    return r6(metrics.calibration_error(scores(spark, sf), 10, "run_id"), "ece")


@query("e13_stored_vs_recomputed", with_("scores", more=CONF, sql=f"SELECT run_id, task, round({BA}, 6) AS recomputed, round({BA} + CASE WHEN run_id = 'b' THEN 0.01 ELSE 0 END, 6) AS stored FROM c WHERE run_id = 'b'"))
def e13(spark, sf):
    now = metrics.task_metrics(scores(spark, sf), "run_id", "task").select("run_id", "task", F.col("balanced_accuracy").alias("recomputed"))
    stored = now.select("run_id", "task", (F.col("recomputed") + F.when(F.col("run_id") == "b", 0.01).otherwise(0.0)).alias("stored"))
    return r6(now.join(stored, ["run_id", "task"]).where(F.abs(F.col("recomputed") - F.col("stored")) > 1e-12), "recomputed", "stored")


@query("e15_member_spread", with_("scores", more=CONF, sql=f"SELECT task, round(min({BA}), 6) AS low, round(max({BA}), 6) AS high, round(stddev_pop({BA}), 6) AS std FROM c GROUP BY task"))
def e15(spark, sf):
    m = metrics.task_metrics(scores(spark, sf), "run_id", "task").groupBy("task")
    return r6(m.agg(F.min("balanced_accuracy").alias("low"), F.max("balanced_accuracy").alias("high"), F.stddev_pop("balanced_accuracy").alias("std")), "low", "high", "std")


@query("e16_combine_directions", with_("scores", more=f"u AS (SELECT * FROM scores WHERE run_id = 'a' AND key % 2 = 0 UNION ALL SELECT * FROM scores WHERE run_id = 'b' AND key % 2 = 1), c AS (SELECT task, {SUMS} FROM u GROUP BY task)", sql=f"SELECT task, round({BA}, 6) AS balanced_accuracy, round({F1}, 6) AS macro_f1 FROM c"))
def e16(spark, sf):
    s = scores(spark, sf)
    both = s.where("run_id = 'a' AND key % 2 = 0").unionByName(s.where("run_id = 'b' AND key % 2 = 1"))
    return r6(metrics.task_metrics(both, "task"), "balanced_accuracy", "macro_f1")


# --- baselines ---


@query("b1_global_majority", with_("scores", sql="SELECT s.run_id, s.task, s.key, round(g.f, 6) AS score FROM scores s CROSS JOIN (SELECT avg(y) AS f FROM scores WHERE key % 5 <> 0) g WHERE s.key % 5 = 0"))
def b1(spark, sf):
    s = scores(spark, sf)
    return r6(checks.rate_scores(s.where("key % 5 <> 0"), s.where("key % 5 = 0")).select("run_id", "task", "key", "score"), "score")


@query("b2_task_frequency", with_("scores", sql="SELECT s.run_id, s.task, s.key, round(g.f, 6) AS score FROM scores s JOIN (SELECT task, avg(y) AS f FROM scores WHERE key % 5 <> 0 GROUP BY task) g ON s.task = g.task WHERE s.key % 5 = 0"))
def b2(spark, sf):
    s = scores(spark, sf)
    return r6(checks.rate_scores(s.where("key % 5 <> 0"), s.where("key % 5 = 0"), "task").select("run_id", "task", "key", "score"), "score")


@query("b3_seeded_bernoulli", with_("scores", sql="SELECT s.run_id, s.task, s.key, CASE WHEN CAST(('0x' || substr(md5('42|' || s.key || '|' || s.task), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < g.f THEN 1 ELSE 0 END AS pred FROM scores s JOIN (SELECT task, avg(y) AS f FROM scores WHERE key % 5 <> 0 GROUP BY task) g ON s.task = g.task WHERE s.key % 5 = 0"))
def b3(spark, sf):
    """Draws of each key and task with the task's frequency, from the MD5 of seed, key and task."""
    s = scores(spark, sf)
    scored = checks.rate_scores(s.where("key % 5 <> 0"), s.where("key % 5 = 0"), "task")
    return checks.drawn_predictions(scored, 42, "key", "task").select("run_id", "task", "key", "pred")


# --- resampling; the draws come from a checksum, so SQL can repeat them ---

STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
STATS = "st AS (SELECT run_id, subject, task, " + SUMS + " FROM scores GROUP BY run_id, subject, task)"


MULT = " + ".join(f"CAST(u >= CAST({s!r} AS DOUBLE) AS BIGINT)" for s in resample.POISSON_STEPS)


def draw_sql(name: str, reps: int) -> str:
    """The uniform number behind each draw, from the MD5 of seed, replicate and subject."""
    return f"{name} AS (SELECT r.rep, s.subject, CAST(('0x' || substr(md5('42|' || r.rep || '|' || s.subject), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM (SELECT DISTINCT subject FROM scores) s CROSS JOIN (SELECT CAST(unnest(range(0, {reps})) AS INTEGER) AS rep) r)"


DRAWS = f"{draw_sql('du', 200)}, dr AS (SELECT rep, subject, {MULT} AS mult FROM du)"
REPS = f"bs AS (SELECT st.run_id, dr.rep, st.task, sum(tp * mult) AS tp, sum(fn * mult) AS fn, sum(tn * mult) AS tn, sum(fp * mult) AS fp FROM st JOIN dr ON st.subject = dr.subject WHERE mult > 0 GROUP BY st.run_id, dr.rep, st.task), rp AS (SELECT run_id, rep, avg({BA}) AS value FROM bs GROUP BY run_id, rep HAVING min(tp + fn) > 0 AND min(tn + fp) > 0)"


def replicates(spark, sf, run):
    c = metrics.confusion(scores(spark, sf).where(F.col("run_id") == run), "subject", "task")
    return resample.bootstrap(c, resample.hashed_draws(c, 200, 42))


def both_runs(spark, sf):
    return replicates(spark, sf, "a").withColumn("run_id", F.lit("a")).unionByName(replicates(spark, sf, "b").withColumn("run_id", F.lit("b")))


@query("u2_bootstrap_replicates", with_("scores", more=f"{STATS}, {DRAWS}, {REPS}", sql="SELECT run_id, rep, round(value, 6) AS value FROM rp"))
def u2(spark, sf):
    return r6(both_runs(spark, sf), "value")


@query("u3_percentile_interval", with_("scores", more=f"{STATS}, {DRAWS}, {REPS}", sql="SELECT run_id, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM rp GROUP BY run_id"))
def u3(spark, sf):
    return r6(resample.percentile_interval(both_runs(spark, sf), F.col("value"), 0.05, "run_id"), "low", "high")


PAIR = "pd AS (SELECT a.rep, b.value - a.value AS diff FROM rp a JOIN rp b ON a.rep = b.rep AND a.run_id = 'a' AND b.run_id = 'b')"


def paired(spark, sf):
    a, b = replicates(spark, sf, "a"), replicates(spark, sf, "b").withColumnRenamed("value", "other")
    return a.join(b, "rep").select("rep", (F.col("other") - F.col("value")).alias("diff"))


@query("u4_paired_difference", with_("scores", more=f"{STATS}, {DRAWS}, {REPS}, {PAIR}", sql="SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM pd"))
def u4(spark, sf):
    return r6(paired(spark, sf).agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.percentile("diff", 0.025).alias("low"), F.percentile("diff", 0.975).alias("high")), "mean", "low", "high")


@query("u5_sign_p", with_("scores", more=f"{STATS}, {DRAWS}, {REPS}, {PAIR}", sql="SELECT round(least(1.0, 2 * least(avg(CASE WHEN diff <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN diff >= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p FROM pd"))
def u5(spark, sf):
    return r6(paired(spark, sf).agg(resample.sign_p(F.col("diff")).alias("p")), "p")


@query("u6_holm_adjust", with_("scores", more="p AS (SELECT run_id, subject, avg(abs(score - y)) / 20 AS p FROM scores GROUP BY run_id, subject), s AS (SELECT *, (count(*) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY p, subject) + 1) * p AS step, row_number() OVER (PARTITION BY run_id ORDER BY p, subject) AS r FROM p)", sql="SELECT run_id, subject, round(least(1.0, max(step) OVER (PARTITION BY run_id ORDER BY r)), 6) AS adjusted FROM s"))
def u6(spark, sf):
    p = scores(spark, sf).groupBy("run_id", "subject").agg((F.avg(F.abs(F.col("score") - F.col("y"))) / 20).alias("p"))
    return resample.holm(p, "p", ("subject",), "run_id").select("run_id", "subject", F.round("adjusted", 6).alias("adjusted"))


@query("u7_compatible_runs", with_("scores", sql="SELECT count(*) AS shared, CAST(sum(CASE WHEN a.y <> b.y OR a.subject <> b.subject THEN 1 ELSE 0 END) AS BIGINT) AS differing, CAST(sum(CASE WHEN a.key IS NULL OR b.key IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM (SELECT * FROM scores WHERE run_id = 'a') a FULL OUTER JOIN (SELECT * FROM scores WHERE run_id = 'b' AND key % 7 <> 0) b ON a.key = b.key AND a.task = b.task"))
def u7(spark, sf):
    s = scores(spark, sf)
    a = s.where("run_id = 'a'").select("key", "task", F.col("y").alias("ya"), F.col("subject").alias("sa"))
    b = s.where("run_id = 'b' AND key % 7 <> 0").select("key", "task", F.col("y").alias("yb"), F.col("subject").alias("sb"))
    j = a.join(b, ["key", "task"], "full")
    return j.agg(F.count("*").alias("shared"), F.sum(flag(F.coalesce((F.col("ya") != F.col("yb")) | (F.col("sa") != F.col("sb")), F.lit(False)))).alias("differing"), F.sum(flag(F.col("ya").isNull() | F.col("yb").isNull())).alias("unmatched"))


@query("u8_order_directions", with_("scores", sql="SELECT key, CAST(count(DISTINCT run_id) AS BIGINT) AS directions, count(DISTINCT run_id) = 2 AND count(*) = 4 AS complete FROM scores GROUP BY key"))
def u8(spark, sf):
    g = scores(spark, sf).groupBy("key").agg(F.countDistinct("run_id").alias("directions"), F.count("*").alias("n"))
    return g.select("key", "directions", ((F.col("directions") == 2) & (F.col("n") == 4)).alias("complete"))


@query("u9_weighted_fraction", with_("scores_big", sql="SELECT task, round(sum(score * l_linenumber) / sum(l_linenumber), 6) AS fraction FROM scores_big GROUP BY task"))
def u9(spark, sf):
    return scores_big(spark, sf).groupBy("task").agg(F.round(F.sum(F.col("score") * F.col("l_linenumber")) / F.sum("l_linenumber"), 6).alias("fraction"))


@query("u10_protocol_comparison", with_("scores", more=f"{CONF}, {STATS}, {DRAWS}, {REPS}", sql=f"SELECT x.run_id, round(x.ba, 6) AS balanced_accuracy, round(y.low, 6) AS low, round(y.high, 6) AS high, round(z.brier, 6) AS brier FROM (SELECT run_id, avg({BA}) AS ba FROM c GROUP BY run_id) x JOIN (SELECT run_id, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM rp GROUP BY run_id) y ON x.run_id = y.run_id JOIN (SELECT run_id, avg((score - y) * (score - y)) AS brier FROM scores GROUP BY run_id) z ON x.run_id = z.run_id"))
def u10(spark, sf):
    s = scores(spark, sf)
    d = F.col("score") - F.col("y")
    m = metrics.task_metrics(s, "run_id", "task").groupBy("run_id").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"))
    i = resample.percentile_interval(both_runs(spark, sf), F.col("value"), 0.05, "run_id")
    return r6(m.join(i, "run_id").join(s.groupBy("run_id").agg(F.avg(d * d).alias("brier")), "run_id"), "balanced_accuracy", "low", "high", "brier")


SUBJECT = f"sb AS (SELECT run_id, subject, {SUMS} FROM scores GROUP BY run_id, subject), sm AS (SELECT run_id, subject, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN {BA} END AS ba FROM sb)"


@query("u11_sweep_summary", with_("scores", more=SUBJECT, sql="SELECT run_id, count(*) AS planned, CAST(sum(CASE WHEN ba IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed, round(max(ba), 6) AS best, round(avg(ba), 6) AS mean FROM sm GROUP BY run_id"))
def u11(spark, sf):
    m = metrics.task_metrics(scores(spark, sf), "run_id", "subject")
    return r6(m.groupBy("run_id").agg(F.count("*").alias("planned"), F.sum(flag(F.col("balanced_accuracy").isNull())).alias("failed"), F.max("balanced_accuracy").alias("best"), F.avg("balanced_accuracy").alias("mean")), "best", "mean")


@query("u12_compare_runs", with_("scores", more=SUBJECT, sql="SELECT subject, run_id, round(ba - first_value(ba) OVER (PARTITION BY subject ORDER BY run_id), 6) AS delta FROM sm"))
def u12(spark, sf):
    m = metrics.task_metrics(scores(spark, sf), "run_id", "subject")
    first = F.first("balanced_accuracy").over(Window.partitionBy("subject").orderBy("run_id"))
    return m.select("subject", "run_id", F.round(F.col("balanced_accuracy") - first, 6).alias("delta"))


@query("u13_delta_vs_best", with_("scores", more=SUBJECT, sql="SELECT subject, run_id, round(ba - max(ba) OVER (PARTITION BY run_id), 6) AS delta FROM sm WHERE ba IS NOT NULL"))
def u13(spark, sf):
    m = metrics.task_metrics(scores(spark, sf), "run_id", "subject").where("balanced_accuracy IS NOT NULL")
    return m.select("subject", "run_id", F.round(F.col("balanced_accuracy") - F.max("balanced_accuracy").over(Window.partitionBy("run_id")), 6).alias("delta"))


@query("u14_split_alignment", with_("scores", sql="SELECT subject, sha256(string_agg(CAST(key AS VARCHAR) || ':' || task, ',' ORDER BY key, task)) AS rows_hash, count(*) AS n FROM scores WHERE run_id = 'a' GROUP BY subject"))
def u14(spark, sf):
    s = scores(spark, sf).where("run_id = 'a'").groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("key", "task"))).alias("k"), F.count("*").alias("n"))
    return s.select("subject", F.sha2(F.array_join(F.transform("k", lambda r: F.concat(r["key"].cast("string"), F.lit(":"), r["task"])), ","), 256).alias("rows_hash"), "n")


TREE = (
    "h AS (SELECT run_id, md5(strlen(CAST(key AS VARCHAR)) || ':' || key || '|' || length(task) || ':' || task) AS h FROM scores), "
    "l AS (SELECT run_id, substr(h, 1, 2) AS node, count(*) AS n, sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS s0, sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) % 18446744073709551616 AS s1 FROM h GROUP BY ALL), "
    "t2 AS (SELECT run_id, node, n, sha256(n || '|' || s0 || '|' || s1) AS digest FROM l), "
    "t1 AS (SELECT run_id, substr(node, 1, 1) AS up, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, '|' ORDER BY node)) AS digest FROM t2 GROUP BY ALL), "
    "t0 AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(up || ':' || digest, '|' ORDER BY up)) AS digest FROM t1 GROUP BY ALL)"
)


@query("u14_split_digests", with_("scores", more=TREE, sql="SELECT run_id, node, n, digest FROM t2 UNION ALL SELECT run_id, up, n, digest FROM t1 UNION ALL SELECT run_id, '', n, digest FROM t0"))
def u14_digests(spark, sf):
    """Digests of the rows (key, task) of each run as a tree that doesn't depend on their order."""
    return set_digests(scores(spark, sf), "run_id", "key", "task")


@query("u1_cluster_bootstrap")
def u1(spark, sf):
    c = metrics.confusion(scores_big(spark, sf), "subject", "task")
    reps = resample.complete_bootstrap(c, REPLICATES, 42)
    return r6(resample.percentile_interval(reps.withColumn("all", F.lit("all")), F.col("value"), 0.05, "all"), "low", "high")


# --- the same of all four metrics, with hashed draws; the SQL tries twice as many replicates as it keeps ---

REPLICATES = 2000
METRICS = ("balanced_accuracy", "score_mse", "sample_iou", "hamming_loss")
HASHED = (
    f"{draw_sql('hu', 2 * REPLICATES)}, "
    f"hm AS (SELECT rep, subject, {MULT} AS mult FROM hu), "
    f"hc AS (SELECT run_id, subject, task, {SUMS}, CAST(sum(CAST(round(100 * (score - y)) AS BIGINT) * CAST(round(100 * (score - y)) AS BIGINT)) AS BIGINT) AS sq FROM scores GROUP BY run_id, subject, task), "
    "ht AS (SELECT run_id, rep, task, sum(tp * mult) AS tp, sum(fn * mult) AS fn, sum(tn * mult) AS tn, sum(fp * mult) AS fp, sum(sq * mult) AS sq FROM hc JOIN hm ON hc.subject = hm.subject WHERE mult > 0 GROUP BY run_id, rep, task), "
    f"hr AS (SELECT run_id, rep, avg({BA}) AS balanced_accuracy, CAST(sum(sq) AS DOUBLE) / (10000 * sum(tp + fn + tn + fp)) AS score_mse, CAST(sum(fn + fp) AS DOUBLE) / sum(tp + fn + tn + fp) AS hamming_loss, CAST(sum(tp + fn + tn + fp) AS BIGINT) AS n, CAST(sum(fn + fp) AS BIGINT) AS wrong, CAST(sum(sq) AS BIGINT) AS squared FROM ht GROUP BY run_id, rep HAVING min(tp + fn) > 0 AND min(tn + fp) > 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY rep) <= {REPLICATES}), "
    "hk AS (SELECT run_id, subject, key, sum(y * pred) AS i, sum(greatest(y, pred)) AS n FROM scores GROUP BY run_id, subject, key), "
    "hs AS (SELECT run_id, subject, sum(CASE WHEN n = 0 THEN 1.0 ELSE CAST(i AS DOUBLE) / n END) AS iou, count(*) AS n FROM hk GROUP BY run_id, subject), "
    "hi AS (SELECT run_id, rep, sum(CAST(iou AS DOUBLE) * mult) / sum(n * mult) AS sample_iou FROM hs JOIN hm ON hs.subject = hm.subject WHERE mult > 0 GROUP BY run_id, rep), "
    "hb AS (SELECT hr.run_id, hr.rep, balanced_accuracy, score_mse, sample_iou, hamming_loss, n, wrong, squared FROM hr JOIN hi ON hr.run_id = hi.run_id AND hr.rep = hi.rep), "
    "hl AS (" + " UNION ALL ".join(f"SELECT run_id, rep, '{m}' AS metric, {m} AS value FROM hb" for m in METRICS) + ")"
)


def hashed_metrics(spark, sf):
    s = scores(spark, sf)
    c = metrics.confusion(s.where("run_id = 'a'"), "subject", "task")
    return resample.bootstrap_metrics(s, resample.complete_draws(c, REPLICATES, 42), "key", "run_id", decimals=2)


def hashed_long(spark, sf):
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return hashed_metrics(spark, sf).select("run_id", "rep", F.explode(each).alias("m")).select("run_id", "rep", "m.metric", "m.value")


#: Ratios of whole numbers to six places, half up, without a double that stands on a tie.
EXACT = {"score_mse": "(200 * squared + n) {div} (2 * n) / 1e6", "hamming_loss": "(2000000 * wrong + n) {div} (2 * n) / 1e6"}


@query("u2_bootstrap_metrics", with_("scores", more=HASHED, sql=f"SELECT run_id, rep, {', '.join(EXACT[m].format(div='//') + f' AS {m}' if m in EXACT else f'round({m}, 6) AS {m}' for m in METRICS)} FROM hb"))
def u2_metrics(spark, sf):
    found = hashed_metrics(spark, sf)
    return found.select("run_id", "rep", *(F.expr(EXACT[m].format(div="div")).alias(m) if m in EXACT else F.round(m, 6).alias(m) for m in METRICS))


@query("u3_metric_intervals", with_("scores", more=HASHED, sql="SELECT run_id, metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM hl GROUP BY run_id, metric"))
def u3_metrics(spark, sf):
    return r6(resample.percentile_interval(hashed_long(spark, sf), F.col("value"), 0.05, "run_id", "metric"), "low", "high")


HASHED_PAIR = "hp AS (SELECT a.rep, a.metric, b.value - a.value AS diff FROM hl a JOIN hl b ON a.rep = b.rep AND a.metric = b.metric AND a.run_id = 'a' AND b.run_id = 'b')"


@query("u4_metric_differences", with_("scores", more=f"{HASHED}, {HASHED_PAIR}", sql="SELECT metric, count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, round(least(1.0, 2 * least(avg(CASE WHEN diff <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN diff >= 0 THEN 1.0 ELSE 0.0 END))), 6) AS p FROM hp GROUP BY metric"))
def u4_metrics(spark, sf):
    a = F.max(F.when(F.col("run_id") == "a", F.col("value")))
    b = F.max(F.when(F.col("run_id") == "b", F.col("value")))
    d = hashed_long(spark, sf).groupBy("rep", "metric").agg((b - a).alias("diff")).where("diff IS NOT NULL")
    out = d.groupBy("metric").agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.percentile("diff", 0.025).alias("low"), F.percentile("diff", 0.975).alias("high"), resample.sign_p(F.col("diff")).alias("p"))
    return r6(out, "mean", "low", "high", "p")


@query("m7_apply_platt", with_("scores", sql="SELECT run_id, key, task, round(1 / (1 + exp(-(2.5 * score - 1.25))), 6) AS score FROM scores"))
def m7(spark, sf):
    return scores(spark, sf).select("run_id", "key", "task", F.round(logistic(2.5 * F.col("score") - 1.25), 6).alias("score"))
