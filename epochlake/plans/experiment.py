"""Queries of targets, splits, audits, selection and many small models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from epochlake.functions.columns import flag
from epochlake.operators import checks, metrics, models, select, targets as op
from epochlake.plans.evaluation import BA, SUMS, r6
from epochlake.plans.grids import long_weights
from epochlake.plans.registry import query
from epochlake.sources.tables import N, class_scores, epochs, part_features, read, scores, sig1, targets, with_

SIDE = "CASE WHEN subject % 3 = 0 THEN 'test' ELSE 'train' END"


def images(spark, sf):
    e = read(spark, sf, "embeddings")
    bits = F.transform("embedding", lambda v: (v > 0).cast("int"))
    return e.withColumn("bits", bits).select(F.col("vec_id").alias("epoch_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("bits", r * 8 + 1, 8)).alias("img"))


@query("g1_build_targets", with_("sig1", sql="SELECT epoch_id, 'pixel_r' || CAST(t_idx // 8 AS VARCHAR) || '_c' || CAST(t_idx % 8 AS VARCHAR) AS task, CASE WHEN x > 0 THEN 1 ELSE 0 END AS y FROM sig1"))
def g1(spark, sf):
    return op.pixel_targets(images(spark, sf), "epoch_id")


@query("g2_fingerprint", "SELECT doc_id, sha256(text) AS fp FROM documents")
def g2(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fp"))


def literal(pairs) -> str:
    return ", ".join(f"({a}, {b!r})" for a, b in pairs)


#: The ten subjects' sides and folds by the same seeded permutations.
SHUFFLED = literal((int(g), "test" if n < 2 else "train") for n, g in enumerate(np.random.RandomState(42).permutation(10)))


def dealt_sql(subjects: list[int], k: int) -> str:
    parts = np.array_split(np.random.RandomState(42).permutation(len(subjects)), k)
    return literal((subjects[i], n) for n, part in enumerate(parts) for i in part)


@query("g3_group_shuffle_split", with_("epochs", sql=f"SELECT e.*, p.side FROM epochs e JOIN (VALUES {SHUFFLED}) p(subject, side) ON e.subject = p.subject"))
def g3(spark, sf):
    return op.group_shuffle_split(epochs(spark, sf), "subject", 0.2, 42)


@query("g4_cross_subject", with_("epochs", sql=f"SELECT epoch_id, 'cross' AS direction, {SIDE} AS side FROM epochs"))
def g4(spark, sf):
    return epochs(spark, sf).select("epoch_id", F.lit("cross").alias("direction"), F.when(F.col("subject") % 3 == 0, "test").otherwise("train").alias("side"))


@query("g5_within_subject", with_("epochs", more="own AS (SELECT * FROM epochs WHERE subject IN (SELECT subject FROM epochs WHERE trial IN (1, 2) GROUP BY subject HAVING count(DISTINCT trial) = 2))", sql="SELECT epoch_id, subject, trial, '1->2' AS direction, CASE WHEN trial = 1 THEN 'train' ELSE 'test' END AS side FROM own UNION ALL SELECT epoch_id, subject, trial, '2->1', CASE WHEN trial = 2 THEN 'train' ELSE 'test' END FROM own"))
def g5(spark, sf):
    return op.within_subject(epochs(spark, sf).drop("label"), "subject", "trial")


@query("g6_leave_one_subject_out", with_("epochs", sql="SELECT epoch_id, d.subject AS direction, CASE WHEN e.subject = d.subject THEN 'test' ELSE 'train' END AS side FROM epochs e CROSS JOIN (SELECT DISTINCT subject FROM epochs) d"))
def g6(spark, sf):
    return op.leave_one_out(epochs(spark, sf), "subject").select("epoch_id", "direction", "side")


def doc_split(spark, sf):
    d = read(spark, sf, "documents").withColumn("fp", F.sha2(F.col("text").cast("binary"), 256))
    side = F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")
    return d.select("doc_id", "source", "lang", "fp", F.lit("cross").alias("direction"), side.alias("side"))


AUDIT = "d AS (SELECT doc_id, source, lang, sha256(text) AS fp, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS side FROM documents), o AS (" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, CAST({a} AS VARCHAR) AS value, count(DISTINCT side) AS sides FROM d WHERE {a} IS NOT NULL GROUP BY CAST({a} AS VARCHAR)" for a in ("doc_id", "source", "lang", "fp")) + ")"


@query("g8_leakage_audit", f"WITH {AUDIT} SELECT 'cross' AS direction, attribute, CAST(sum(CASE WHEN sides = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM o GROUP BY attribute")
def g8(spark, sf):
    return op.overlaps(doc_split(spark, sf), ["doc_id", "source", "lang", "fp"])


@query("g9_direction_audit", f"WITH {AUDIT} SELECT 'cross' AS direction, bool_or(attribute = 'doc_id' AND sides = 2) AS key_leak, bool_or(attribute = 'fp' AND sides = 2) AS fingerprint_leak, NOT bool_or(attribute IN ('doc_id', 'fp') AND sides = 2) AS clean FROM o")
def g9(spark, sf):
    o = op.overlaps(doc_split(spark, sf), ["doc_id", "source", "lang", "fp"])
    leak = lambda *a: F.bool_or(F.col("attribute").isin(*a) & (F.col("n") > 0))
    return o.groupBy("direction").agg(leak("doc_id").alias("key_leak"), leak("fp").alias("fingerprint_leak"), (~leak("doc_id", "fp")).alias("clean"))


TSPLIT = "ts AS (SELECT *, 'cross' AS direction, CASE WHEN key % 4 = 0 THEN 'test' ELSE 'train' END AS side FROM targets)"


@query("g10_split_audit", with_("targets", more=TSPLIT, sql="SELECT direction, side, task, CAST(sum(y) AS BIGINT) AS positives, count(*) AS n, sum(y) > 0 AND sum(y) < count(*) AS both_classes FROM ts GROUP BY direction, side, task"))
def g10(spark, sf):
    t = targets(spark, sf).withColumn("direction", F.lit("cross")).withColumn("side", F.when(F.col("key") % 4 == 0, "test").otherwise("train"))
    return op.positives(t)


@query("g11_corpus_audit", "SELECT count(*) AS n_rows, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total FROM documents")
def g11(spark, sf):
    d = read(spark, sf, "documents").withColumn("fp", F.sha2(F.col("text").cast("binary"), 256))
    return d.agg(F.count("*").alias("n_rows"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.countDistinct("fp").alias("texts"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("total"))


@query("g12_stratified_group_kfold")
def g12(spark, sf):
    return op.stratified_group_kfold(targets(spark, sf), "subject", 3, 42)


@query("g13_group_kfold", with_("epochs", sql=f"SELECT e.*, CAST(p.fold AS INTEGER) AS fold FROM epochs e JOIN (VALUES {dealt_sql(list(range(10)), 5)}) p(subject, fold) ON e.subject = p.subject"))
def g13(spark, sf):
    return op.group_kfold(epochs(spark, sf), "subject", 5, 42)


@query("g15_lowest_subject_validation", with_("epochs", sql="SELECT epoch_id, CASE WHEN subject = (SELECT min(subject) FROM epochs WHERE subject <> 0) THEN 'validation' ELSE 'train' END AS side FROM epochs WHERE subject <> 0"))
def g15(spark, sf):
    e = epochs(spark, sf).where("subject <> 0")
    low = e.agg(F.min("subject").alias("low"))
    return e.crossJoin(F.broadcast(low)).select("epoch_id", F.when(F.col("subject") == F.col("low"), "validation").otherwise("train").alias("side"))


@query("g16_align", with_("targets", sql="SELECT t.key, d.n_chars, max(CASE WHEN task = 'quality' THEN y END) AS quality, max(CASE WHEN task = 'toxic' THEN y END) AS toxic FROM targets t JOIN documents d ON t.key = d.doc_id GROUP BY t.key, d.n_chars"))
def g16(spark, sf):
    wide = targets(spark, sf).groupBy("key").pivot("task", ["quality", "toxic"]).agg(F.max("y"))
    return op.align(read(spark, sf, "documents").select(F.col("doc_id").alias("key"), "n_chars"), wide, "key")


@query("g18_target_payload_check", with_("sig1", sql="SELECT count(*) AS tasks, CAST(sum(CASE WHEN y <> CASE WHEN x > 0 THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM (SELECT *, CASE WHEN x > 0 THEN 1 ELSE 0 END AS y FROM sig1)"))
def g18(spark, sf):
    t = op.pixel_targets(images(spark, sf), "epoch_id")
    s = sig1(spark, sf).select("epoch_id", F.format_string("pixel_r%d_c%d", F.floor(F.col("t_idx") / 8), F.col("t_idx") % 8).alias("task"), (F.col("x") > 0).cast("int").alias("source_y"))
    return t.join(s, ["epoch_id", "task"]).agg(F.count("*").alias("tasks"), F.sum(flag(F.col("y") != F.col("source_y"))).alias("wrong"))


@query("s4_load_epochs", "SELECT event_id, user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch_index FROM events")
def s4(spark, sf):
    e = read(spark, sf, "events")
    return op.number_within(e, "user_id", "event_type", order=("ts", "event_id")).select("event_id", "user_id", "event_type", "epoch_index")


@query("s2_exclude", with_("epochs", sql="SELECT epoch_id, subject, trial, label FROM epochs WHERE subject <> 3 AND NOT (subject = 5 AND trial = 1)"))
def s2(spark, sf):
    from epochlake.operators.store import exclude

    return exclude(epochs(spark, sf), {3: [], 5: [1]})


@query("s3_filter_pattern", "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_type = 'click'")
def s3(spark, sf):
    return checks.of_pattern(read(spark, sf, "events"), "event_type", "click").select("event_id", "event_type", F.round("value", 6).alias("value"))


# --- selection ---


@query("a1_variance_threshold", with_("part_features", sql="SELECT feature, round(var_pop(value), 5) AS variance FROM part_features GROUP BY feature HAVING var_pop(value) > 0.001"))
def a1(spark, sf):
    return select.above_variance(part_features(spark, sf), 0.001).withColumn("variance", F.round("variance", 5))


FSCORE = "g AS (SELECT {by}feature, y, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM {t} GROUP BY {by}feature, y), h AS (SELECT {by}feature, sum(n) AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM g GROUP BY {by}feature), f AS (SELECT {by}feature, ((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)) AS f FROM h)"


@query("a2_f_score", with_("part_features", more=FSCORE.format(by="", t="part_features"), sql="SELECT feature, round(f, 4) AS f FROM f"))
def a2(spark, sf):
    return select.f_score(part_features(spark, sf)).withColumn("f", F.round("f", 4))


@query("a3_select_k_best", with_("part_features", more=FSCORE.format(by="", t="part_features"), sql="SELECT feature, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INTEGER) AS rank FROM f QUALIFY rank <= 2"))
def a3(spark, sf):
    return select.best_k(select.f_score(part_features(spark, sf)), 2).select("feature", "rank")


EPOCH_ROWS = "er AS (SELECT s.epoch_id, t.task, 's' || CAST(s.t_idx AS VARCHAR) AS feature, s.x AS value, CASE WHEN t.task = 'even' THEN CASE WHEN e.label % 2 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN e.label >= 5 THEN 1 ELSE 0 END END AS y FROM sig1 s JOIN epochs e ON s.epoch_id = e.epoch_id CROSS JOIN (SELECT 'even' AS task UNION ALL SELECT 'high') t)"


def epoch_rows(spark, sf):
    s = sig1(spark, sf).join(epochs(spark, sf), "epoch_id")
    tasks = F.array(F.struct(F.lit("even").alias("task"), (F.col("label") % 2 == 0).cast("int").alias("y")), F.struct(F.lit("high").alias("task"), (F.col("label") >= 5).cast("int").alias("y")))
    return s.select("epoch_id", F.format_string("s%d", "t_idx").alias("feature"), F.col("x").alias("value"), F.explode(tasks).alias("t")).select("epoch_id", "feature", "value", "t.task", "t.y")


@query("a4_multi_target_select", with_("sig1", "epochs", more=f"{EPOCH_ROWS}, {FSCORE.format(by='task, ', t='er')}, p AS (SELECT task, feature, 1 - CAST(row_number() OVER (PARTITION BY task ORDER BY f DESC, feature) - 1 AS DOUBLE) / (count(*) OVER (PARTITION BY task) - 1) AS pct FROM f)", sql="SELECT feature, round(f, 6) AS f, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INTEGER) AS rank FROM (SELECT feature, avg(pct) AS f FROM p GROUP BY feature) QUALIFY rank <= 4"))
def a4(spark, sf):
    return select.multi_target_best(select.f_score(epoch_rows(spark, sf), "task"), 4).select("feature", F.round("f", 6).alias("f"), "rank")


@query("a5_standard_scale", with_("sig1", more="f AS (SELECT t_idx, avg(x) AS mu, stddev_pop(x) AS sd FROM sig1 WHERE epoch_id % 10 <> 0 GROUP BY t_idx)", sql="SELECT epoch_id, 's' || CAST(s.t_idx AS VARCHAR) AS feature, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM sig1 s JOIN f ON s.t_idx = f.t_idx"))
def a5(spark, sf):
    s = sig1(spark, sf).select("epoch_id", F.format_string("s%d", "t_idx").alias("feature"), F.col("x").alias("value"))
    return select.standard_scale(s.where("epoch_id % 10 <> 0"), s).select("epoch_id", "feature", F.round("z", 5).alias("z"))


@query("a6_pos_weight", with_("targets", sql="SELECT task, round(CAST(sum(1 - y) AS DOUBLE) / sum(y), 6) AS weight FROM targets GROUP BY task"))
def a6(spark, sf):
    return targets(spark, sf).groupBy("task").agg(F.round(F.sum(1 - F.col("y")) / F.sum("y"), 6).alias("weight"))


@query("a7_class_weight_balanced", with_("class_scores", sql="SELECT y, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight FROM class_scores GROUP BY y"))
def a7(spark, sf):
    c = class_scores(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(total)).select("y", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query("a8_feature_usage", with_("sig1", "epochs", more=f"{EPOCH_ROWS}, {FSCORE.format(by='task, ', t='er')}, b AS (SELECT task, 'wave:c' || CAST(CAST(substr(feature, 2) AS INTEGER) % 4 AS VARCHAR) || ':' || feature AS name, f, row_number() OVER (PARTITION BY task ORDER BY f DESC, feature) AS r FROM f)", sql="SELECT split_part(name, ':', 2) AS channel, count(*) AS uses, count(DISTINCT task) AS tasks, round(avg(abs(f)), 5) AS mean_weight FROM b WHERE r <= 8 GROUP BY split_part(name, ':', 2)"))
def a8(spark, sf):
    b = select.best_k(select.f_score(epoch_rows(spark, sf), "task"), 8, "task")
    name = F.concat(F.lit("wave:c"), (F.substring("feature", 2, 9).cast("int") % 4).cast("string"), F.lit(":"), F.col("feature"))
    return b.withColumn("channel", F.split(name, ":")[1]).groupBy("channel").agg(F.count("*").alias("uses"), F.countDistinct("task").alias("tasks"), F.round(F.avg(F.abs("f")), 5).alias("mean_weight"))


# --- models ---

FAMILY = f"fs AS (SELECT run_id AS family, task, key % 3 AS fold, {SUMS} FROM scores GROUP BY run_id, task, key % 3), fb AS (SELECT family, task, fold, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN {BA} END AS ba FROM fs), ft AS (SELECT family, task, avg(ba) AS ba FROM fb GROUP BY family, task), ff AS (SELECT family, avg(ba) AS ba FROM ft GROUP BY family)"


def family_folds(spark, sf):
    return metrics.task_metrics(scores(spark, sf).withColumn("fold", F.col("key") % 3).withColumnRenamed("run_id", "family"), "family", "task", "fold")


@query("m3_screen_families", with_("scores", more=FAMILY, sql="SELECT family, round(ba, 6) AS ba, CAST(row_number() OVER (ORDER BY ba DESC, family) AS INTEGER) AS rank FROM ff"))
def m3(spark, sf):
    t = family_folds(spark, sf).groupBy("family", "task").agg(F.avg("balanced_accuracy").alias("ba")).groupBy("family").agg(F.avg("ba").alias("ba"))
    return t.select("family", F.round("ba", 6).alias("ba"), F.row_number().over(Window.orderBy(F.desc("ba"), "family")).alias("rank"))


@query("m17_select_grid_candidate", with_("scores", more=f"{FAMILY}, e AS (SELECT run_id AS family, avg((score - y) * (score - y)) AS mse FROM scores GROUP BY run_id)", sql="SELECT ff.family, CAST(row_number() OVER (ORDER BY -ff.ba, e.mse, ff.family) AS INTEGER) AS rank FROM ff JOIN e ON ff.family = e.family"))
def m17(spark, sf):
    t = family_folds(spark, sf).groupBy("family", "task").agg(F.avg("balanced_accuracy").alias("ba")).groupBy("family").agg(F.avg("ba").alias("ba"))
    d = F.col("score") - F.col("y")
    e = scores(spark, sf).groupBy(F.col("run_id").alias("family")).agg(F.avg(d * d).alias("mse"))
    return t.join(e, "family").select("family", F.row_number().over(Window.orderBy(-F.col("ba"), "mse", "family")).alias("rank"))


@query("m18_clip_scores", with_("scores", sql="SELECT run_id, round(avg(CASE WHEN 1.4 * score - 0.2 < 0 THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(CASE WHEN 1.4 * score - 0.2 > 1 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(least(1, greatest(0, 1.4 * score - 0.2))), 6) AS mean FROM scores GROUP BY run_id"))
def m18(spark, sf):
    raw = 1.4 * F.col("score") - 0.2
    return r6(models.clip_report(scores(spark, sf).withColumn("raw", raw), "run_id"), "below", "above", "mean")


@query("m19_ensemble_mean", with_("scores", sql="SELECT key, task, round(avg(score), 6) AS score, CASE WHEN round(avg(score), 6) >= 0.5 THEN 1 ELSE 0 END AS pred FROM scores GROUP BY key, task"))
def m19(spark, sf):
    m = scores(spark, sf).groupBy("key", "task").agg(F.round(F.avg("score"), 6).alias("score"))
    return m.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query("m20_epoch_select", with_("scores", more=f"c AS (SELECT key % 3 AS fold, CAST(key // 3 % 5 AS INTEGER) AS epoch, {SUMS}, avg((score - y) * (score - y)) AS loss FROM scores GROUP BY key % 3, CAST(key // 3 % 5 AS INTEGER)), r AS (SELECT fold, epoch, row_number() OVER (PARTITION BY fold ORDER BY round({BA}, 9) DESC, round(loss, 9), epoch) AS r FROM c)", sql="SELECT CAST(floor(quantile_cont(epoch, 0.5)) AS BIGINT) AS epochs FROM r WHERE r = 1"))
def m20(spark, sf):
    s = scores(spark, sf).withColumn("fold", F.col("key") % 3).withColumn("epoch", (F.floor(F.col("key") / 3) % 5).cast("int"))
    d = F.col("score") - F.col("y")
    loss = s.groupBy("fold", "epoch").agg(F.avg(d * d).alias("loss"))
    m = metrics.task_metrics(s, "fold", "epoch").join(loss, ["fold", "epoch"])
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("balanced_accuracy", 9)), F.round("loss", 9), "epoch")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").agg(F.floor(F.percentile("epoch", 0.5)).alias("epochs"))


@query("m21_target_score", with_("scores", sql="SELECT run_id, key, task, round(CASE WHEN run_id = 'a' THEN 1 - score ELSE score END, 6) AS score FROM scores"))
def m21(spark, sf):
    return scores(spark, sf).select("run_id", "key", "task", F.round(F.when(F.col("run_id") == "a", 1 - F.col("score")).otherwise(F.col("score")), 6).alias("score"))


@query("m22_matrix_plan", "SELECT m.model, f.family, p.protocol, sha256(m.model || '|' || f.family || '|' || p.protocol) AS cell FROM (SELECT DISTINCT source AS model FROM documents) m CROSS JOIN (SELECT DISTINCT lang AS family FROM documents) f CROSS JOIN (SELECT 'cross' AS protocol UNION ALL SELECT 'within') p")
def m22(spark, sf):
    d = read(spark, sf, "documents")
    return models.matrix_plan(d.select(F.col("source").alias("model")).distinct(), d.select(F.col("lang").alias("family")).distinct(), ["cross", "within"])


@query("m15_dummy_prior", with_("class_scores", sql="SELECT y, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS prior, count(*) = max(count(*)) OVER () AS majority FROM class_scores GROUP BY y"))
def m15(spark, sf):
    c = class_scores(spark, sf).groupBy("y").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return c.crossJoin(F.broadcast(t)).select("y", F.round(F.col("n") / F.col("total"), 6).alias("prior"), (F.col("n") == F.col("top")).alias("majority"))


GRAM = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(l_{a} * l_{b}), 1) AS g FROM lineitem" for a in ("discount", "quantity", "tax") for b in ("discount", "quantity", "tax"))


@query("m8_ridge_gram", GRAM)
def m8_gram(spark, sf):
    line = read(spark, sf, "lineitem")
    return models.gram(line, ["l_discount", "l_quantity", "l_tax"]).select(F.regexp_replace("a", "^l_", "").alias("a"), F.regexp_replace("b", "^l_", "").alias("b"), F.round("g", 1).alias("g"))


def line_table(spark, sf):
    line = read(spark, sf, "lineitem")
    return line.select(F.col("l_discount").alias("x1"), (F.col("l_quantity") / 50).alias("x2"), F.col("l_tax").alias("x3"), (F.col("l_returnflag") == "R").cast("double").alias("y1"), (F.col("l_linestatus") == "O").cast("double").alias("y2"), F.col("l_suppkey").alias("subject"))


X = ["x1", "x2", "x3"]


@query("m8_ridge", long_weights(1.0, "1.0 ELSE 0.0 END AS y1", "0, 1"))
def m8(spark, sf):
    return models.fit_ridge(line_table(spark, sf), X, ["y1", "y2"], 1.0).withColumn("weight", F.round("weight", 5))


@query("m5_ridge_classifier", long_weights(1.0, "1.0 ELSE -1.0 END AS y1", "0"))
def m5(spark, sf):
    t = line_table(spark, sf)
    return models.fit_ridge(t.withColumn("y1", 2 * F.col("y1") - 1), X, ["y1"], 1.0).withColumn("weight", F.round("weight", 5))


@query("m1_logistic")
def m1(spark, sf):
    return models.fit_ml(line_table(spark, sf), X, ["y1", "y2"], "logistic")


@query("m2_predict_logistic")
def m2(spark, sf):
    return models.predict_logistic(line_table(spark, sf), X, "y1")


@query("m4_linear_svm")
def m4(spark, sf):
    return models.fit_ml(line_table(spark, sf), X, ["y1", "y2"], "svm")


@query("m6_platt")
def m6(spark, sf):
    t = line_table(spark, sf).withColumn("score", F.col("x1") * 10 - 0.5).withColumn("y", F.col("y1"))
    return models.platt(t)


@query("m9_elastic_net")
def m9(spark, sf):
    return models.fit_ml(line_table(spark, sf), X, ["y1", "y2"], "elastic")


@query("m10_random_forest")
def m10(spark, sf):
    return models.fit_ml(line_table(spark, sf), X, ["y1"], "forest")


@query("m11_pls")
def m11(spark, sf):
    return models.fit_pls(line_table(spark, sf), X, ["y1", "y2"], 2)


@query("m12_lda")
def m12(spark, sf):
    return models.fit_lda(line_table(spark, sf).withColumn("y", F.col("y1").cast("int")), X, 0.1)


@query("m13_ovr_logistic")
def m13(spark, sf):
    e = read(spark, sf, "embeddings").select(*(F.col("embedding")[k].cast("double").alias(f"x{k + 1}") for k in range(N)), F.col("label").cast("double").alias("y"))
    return models.one_vs_rest(e, [f"x{k + 1}" for k in range(N)], 10)


GRID = [{"k": k, "c": c, "l1": l1, "balanced": balanced} for k in (2, 3) for c in (0.01, 1.0) for l1 in (0.0, 1.0) for balanced in (False, True)]


@query("m1_logistic_grid")
def m1_grid(spark, sf):
    t = line_table(spark, sf).withColumn("fold", F.col("subject") % 3)
    candidates, _ = models.fit_logistic_grid(t, X, "y1", "fold", GRID)
    return candidates


@query("m1_logistic_refit")
def m1_refit(spark, sf):
    t = line_table(spark, sf).withColumn("fold", F.col("subject") % 3)
    _, weights = models.fit_logistic_grid(t, X, "y1", "fold", [g for g in GRID if g["balanced"]])
    return weights


@query("m6_out_of_fold_platt")
def m6_oof(spark, sf):
    t = line_table(spark, sf).withColumn("fold", (F.col("subject") % 5).cast("int"))
    oof = models.out_of_fold(t, X, "y1", "fold", 5).select("score", F.col("y1").alias("y"))
    return models.platt(oof)


@query("m12_lda_auto_shrinkage")
def m12_auto(spark, sf):
    return models.fit_lda(line_table(spark, sf).withColumn("y", F.col("y1").cast("int")), X, None)


@query("m12_lda_svd")
def m12_svd(spark, sf):
    return models.fit_lda(line_table(spark, sf).withColumn("y", F.col("y1").cast("int")), X, 0.0)


@query("m14_hinge_subgradient")
def m14_hinge(spark, sf):
    return models.fit_hinge(line_table(spark, sf), X, "y1", 0.01)
