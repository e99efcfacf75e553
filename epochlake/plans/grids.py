"""Queries of grids over folds: families, penalties and component counts from one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlake.operators import folds, forest, logits
from epochlake.operators.folds import Candidate
from epochlake.operators.logits import Logit
from epochlake.plans.evaluation import r6
from epochlake.plans.registry import query
from epochlake.sources.tables import read

NAMES = ("x1", "x2", "x3")
FAMILIES = ((0,), (0, 1), (0, 1, 2))
LINES = "lt AS (SELECT l_discount AS x1, l_quantity / 50.0 AS x2, l_tax AS x3, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y1, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS y2, CAST(l_suppkey % 3 AS INTEGER) AS fold FROM lineitem)"


def line_rows(spark, sf):
    """Order lines with three features, two targets and three folds of suppliers."""
    line = read(spark, sf, "lineitem")
    x = F.array(F.col("l_discount").cast("double"), F.col("l_quantity") / 50, F.col("l_tax").cast("double"))
    y = F.array((F.col("l_returnflag") == "R").cast("double"), (F.col("l_linestatus") == "O").cast("double"))
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select((F.col("l_suppkey") % 3).cast("int").alias("fold"), x.alias("x"), y.alias("y"), key.alias("key"))


def solved_sql(held: str, scaled: bool, cells: str) -> str:
    """Tables of ridge weights by Cramer's rule: m (moments by training set), s (system of each cell and target), w.

    cells gives candidate, alpha, f1, f2, f3 (1 where the family has the feature); held joins training sets to rows.
    """
    pairs = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j]
    sd = (lambda i: f"sqrt(v{i})") if scaled else (lambda i: "1.0")
    moments = ", ".join([f"avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}" for i in (1, 2, 3)] + [f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i, j in pairs if i < j] + [f"avg(y{t}) AS my{t}, " + ", ".join(f"covar_pop(x{i}, y{t}) AS d{i}{t}" for i in (1, 2, 3)) for t in (1, 2)])
    a = ", ".join(f"n * (CASE WHEN f{i} * f{j} = 1 THEN {f'v{i}' if i == j else f'c{i}{j}'} / ({sd(i)} * {sd(j)}) ELSE 0 END)" + (" + alpha" if i == j else "") + f" AS a{i}{j}" for i, j in pairs)
    systems = " UNION ALL ".join(f"SELECT held, candidate, {t - 1} AS task, my{t} AS my, m1, m2, m3, {', '.join(f'{sd(i)} AS s{i}' for i in (1, 2, 3))}, {a}, {', '.join(f'f{i} * n * d{i}{t} / {sd(i)} AS b{i}' for i in (1, 2, 3))} FROM m CROSS JOIN cells" for t in (1, 2))
    det = "(a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13))"
    w1 = "(b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3))"
    w2 = "(a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13))"
    w3 = "(a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13))"
    return (
        f"m AS (SELECT h.held, count(*) AS n, {moments} FROM lt JOIN {held} GROUP BY h.held), cells(candidate, alpha, f1, f2, f3) AS (VALUES {cells}), s AS ({systems}), "
        f"w0 AS (SELECT *, {w1} / {det} / s1 AS w1, {w2} / {det} / s2 AS w2, {w3} / {det} / s3 AS w3 FROM s), w AS (SELECT *, my - w1 * m1 - w2 * m2 - w3 * m3 AS w0 FROM w0)"
    )


def cells_of(grid: list[Candidate]) -> str:
    return ", ".join(f"({g}, {c.alpha!r}, {', '.join(str(int(c.features is None or i in c.features)) for i in range(3))})" for g, c in enumerate(grid))


def ranked_sql(grid: list[Candidate]) -> str:
    """Candidates by fold-wise scores of rows that the fits haven't seen."""
    held = "(SELECT DISTINCT fold AS held FROM lt) h ON lt.fold <> h.held"
    return (
        f"WITH {LINES}, {solved_sql(held, True, cells_of(grid))}, "
        "p AS (SELECT held, candidate, task, CASE WHEN task = 0 THEN y1 ELSE y2 END AS y, least(1, greatest(0, w0 + w1 * x1 + w2 * x2 + w3 * x3)) AS p FROM w JOIN lt ON lt.fold = w.held), "
        "e AS (SELECT candidate, (avg(CASE WHEN y = 1 THEN CAST(p >= 0.5 AS INTEGER) END) + avg(CASE WHEN y = 0 THEN CAST(p < 0.5 AS INTEGER) END)) / 2 AS ba, avg((p - y) * (p - y)) AS mse FROM p GROUP BY held, candidate, task), "
        "f AS (SELECT candidate, avg(ba) AS ba, avg(mse) AS mse FROM e GROUP BY candidate) "
        "SELECT candidate, round(ba, 6) AS balanced_accuracy, round(mse, 6) AS clipped_mse, CAST(row_number() OVER (ORDER BY round(ba, 9) DESC, round(mse, 9), candidate) AS INTEGER) AS rank FROM f"
    )


def search(spark, sf, grid):
    return folds.search(line_rows(spark, sf), 3, 2, grid)


SCREENING = [Candidate("ridge", 3, f, alpha=1.0) for f in FAMILIES]
RIDGES = [Candidate("ridge", 3, alpha=a, together=True) for a in (0.1, 100.0, 10_000.0, 1_000_000.0)]
OTHERS = [Candidate("pls", 3, components=n, together=True) for n in (1, 2, 3)] + [Candidate("elastic", k, alpha=a, l1=x) for k in (2, 3) for a in (0.001, 0.01) for x in (0.5, 1.0)]


@query("m16_fold_screening", ranked_sql(SCREENING))
def m16_folds(spark, sf):
    """Feature families by the folds' balanced accuracy and clipped error, each fitted without the fold."""
    return r6(search(spark, sf, SCREENING)[1], "balanced_accuracy", "clipped_mse")


@query("m8_ridge_grid", ranked_sql(RIDGES))
def m8_grid(spark, sf):
    return r6(search(spark, sf, RIDGES)[1], "balanced_accuracy", "clipped_mse")


@query("m8_ridge_refit", f"WITH {LINES}, {solved_sql('(SELECT -1 AS held) h ON true', True, cells_of(RIDGES))} SELECT candidate, CAST(task AS INTEGER) AS task, round(w0, 5) AS intercept, round(w1, 5) AS x1, round(w2, 5) AS x2, round(w3, 5) AS x3 FROM w")
def m8_refit(spark, sf):
    """Weights of every penalty on all rows."""
    w = search(spark, sf, RIDGES)[2].where(f"held = {folds.ALL}")
    return w.select("candidate", "task", F.round("intercept", 5).alias("intercept"), *(F.round(F.col("weights")[k], 5).alias(c) for k, c in enumerate(NAMES)))


@query("m11_pls_and_elastic_grid")
def m11_grid(spark, sf):
    """Component counts of partial least squares and elastic nets in one grid."""
    return r6(search(spark, sf, OTHERS)[1], "balanced_accuracy", "clipped_mse")


@query("m3_fold_screening")
def m3_folds(spark, sf):
    """Feature families by the folds' balanced accuracy of logistic models of both targets."""
    return r6(logits.search(line_rows(spark, sf), 3, 2, [Logit(3, balanced=True, features=f) for f in FAMILIES], refit=False)[1], "balanced_accuracy", "clipped_mse")


@query("m1_logistic_tasks")
def m1_tasks(spark, sf):
    """Kinds of penalty, penalties and class weights for both targets at once."""
    grid = [Logit(k, c, l1, b) for k in (2, 3) for c in (0.01, 1.0) for l1 in (0.0, 1.0) for b in (False, True)]
    return r6(logits.search(line_rows(spark, sf), 3, 2, grid)[1], "balanced_accuracy", "clipped_mse")


GAINS = " UNION ALL ".join(f"SELECT {k} AS feature, x{k + 1} AS threshold, sum(count(*)) OVER w AS n, sum(sum(y1)) OVER w AS s1, sum(sum(y2)) OVER w AS s2 FROM lt GROUP BY x{k + 1} WINDOW w AS (ORDER BY x{k + 1})" for k in range(3))
STUMP = (
    f"WITH {LINES}, a AS (SELECT count(*) AS n, sum(y1) AS s1, sum(y2) AS s2 FROM lt), g AS ({GAINS}), "
    "b AS (SELECT g.*, a.n - g.n AS rn, a.s1 - g.s1 AS r1, a.s2 - g.s2 AS r2, (g.s1 * g.s1 + g.s2 * g.s2) / g.n + ((a.s1 - g.s1) * (a.s1 - g.s1) + (a.s2 - g.s2) * (a.s2 - g.s2)) / (a.n - g.n) - (a.s1 * a.s1 + a.s2 * a.s2) / a.n AS gain FROM g, a WHERE g.n < a.n) "
    "SELECT CAST(feature AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, round(s1 / n, 6) AS left_1, round(s2 / n, 6) AS left_2, round(r1 / rn, 6) AS right_1, round(r2 / rn, 6) AS right_2 FROM b ORDER BY round(gain, 9) DESC, feature, threshold LIMIT 1"
)


@query("m10_forest_stump", STUMP)
def m10_stump(spark, sf):
    """The first split of a tree of both targets over all rows, with its leaves."""
    tree = forest.fit(line_rows(spark, sf), 3, 2, trees=1, depth=1, bins=256, bootstrap=False).trees[0]
    left, right = (tree[tree[0][c]]["value"] for c in ("left", "right"))
    row = (tree[0]["feature"], round(tree[0]["threshold"], 6), round(tree[0]["gain"], 4), *(round(float(v), 6) for v in (*left, *right)))
    return spark.createDataFrame([row], "feature int, threshold double, gain double, left_1 double, left_2 double, right_1 double, right_2 double")


@query("m10_forest_multioutput")
def m10_forest(spark, sf):
    """Importance of each feature in a forest whose trees predict both targets, beside the mean predictions."""
    rows = line_rows(spark, sf)
    model = forest.fit(rows, 3, 2, trees=10, depth=4, least=5, share=0.67)
    means = forest.predict(rows, model, 3).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col("p")[t]), 6).alias(f"mean_{t + 1}") for t in range(2)))
    shares = spark.createDataFrame([(c, round(float(v), 6)) for c, v in zip(NAMES, model.importances(3), strict=True)], "feature string, importance double")
    return shares.crossJoin(F.broadcast(means))  # three rows and one


def long_weights(sql_alpha: float, shift: str, tasks: str) -> str:
    """SQL of unscaled ridge weights on all rows, one row for each target and feature."""
    lines = LINES.replace("1.0 ELSE 0.0 END AS y1", shift)
    each = " UNION ALL ".join(f"SELECT CASE WHEN task = 0 THEN 'y1' ELSE 'y2' END AS task, '{f}' AS feature, round({c}, 5) AS weight FROM w WHERE task IN ({tasks})" for f, c in (("x1", "w1"), ("x2", "w2"), ("x3", "w3"), ("(intercept)", "w0")))
    return f"WITH {lines}, {solved_sql('(SELECT -1 AS held) h ON true', False, f'(0, {sql_alpha!r}, 1, 1, 1)')} {each}"
