"""Many small linear models: sums made in Spark, solutions of the size of the features made here; Spark ML elsewhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlake.operators import logits
from epochlake.operators.folds import ALL, Moments, collected, merged, pls_weights

def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of products of all column pairs in one pass: a, b, g."""
    n, mean, c = collected(df, columns).get(0, nothing(len(columns)))
    g = c + n * np.outer(mean, mean)
    rows = [(a, b, float(g[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, g double")


def nothing(k: int) -> Moments:
    return 0, np.zeros(k), np.zeros((k, k))


def coefficients(df: DataFrame, names: list[str], targets: list[str], weights: np.ndarray, intercept: np.ndarray) -> DataFrame:
    rows = [(t, f, float(w)) for k, t in enumerate(targets) for f, w in [*zip(names, weights[:, k], strict=True), ("(intercept)", intercept[k])]]
    return df.sparkSession.createDataFrame(rows, "task string, feature string, weight double")


def fit_ridge(df: DataFrame, x: list[str], y: list[str], alpha: float) -> DataFrame:
    """Ridge weights of all targets from one pass: task, feature, weight. The intercept isn't penalised."""
    w, b = ridge_of(collected(df, [*x, *y]).get(0, nothing(len(x) + len(y))), len(x), alpha)
    return coefficients(df, x, y, w, b)


def ridge_of(moments: Moments, k: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    _, mean, g = moments
    w = np.linalg.solve(g[:k, :k] + alpha * np.eye(k), g[:k, k:])
    return w, mean[k:] - mean[:k] @ w


def fit_pls(df: DataFrame, x: list[str], y: list[str], components: int) -> DataFrame:
    """Partial least squares weights from sums of products alone (kernel form)."""
    _, mean, g = collected(df, [*x, *y]).get(0, nothing(len(x) + len(y)))
    k = len(x)
    w = pls_weights(g[:k, :k], g[:k, k:], components)[-1]
    return coefficients(df, x, y, w, mean[k:] - mean[:k] @ w)


def fit_lda(df: DataFrame, x: list[str], shrinkage: float | None) -> DataFrame:
    """Two-class discriminant weights from class means and pooled covariance.

    shrinkage None: each class's covariance is shrunk by the Ledoit-Wolf amount of its standardised features; 0: none,
    and directions without variance are left out (the form by singular values).
    """
    held = collected(df.where("y IN (0, 1)"), x, "y")
    grams = {c: held.get(c, nothing(len(x))) for c in (0, 1)}
    n = sum(g[0] for g in grams.values())
    if shrinkage is None:
        shrunk = _ledoit_wolf(df.select(*x, "y").dropna(), x, grams)
        s = sum(shrunk[c] * grams[c][0] for c in (0, 1)) / max(n, 1)
    else:
        s = sum(g[2] for g in grams.values()) / max(n, 1)
        s = (1 - shrinkage) * s + shrinkage * np.trace(s) / len(x) * np.eye(len(x))
    apart = grams[1][1] - grams[0][1]
    w = np.linalg.pinv(s, hermitian=True) @ apart if shrinkage == 0 else np.linalg.solve(s, apart)
    b = -(grams[1][1] + grams[0][1]) @ w / 2 + np.log(max(grams[1][0], 1) / max(grams[0][0], 1))
    return coefficients(df, x, ["y"], w[:, None], np.array([b]))


def _ledoit_wolf(rows: DataFrame, x: list[str], grams: dict[int, Moments]) -> dict[int, np.ndarray]:
    """Each class's covariance of standardised columns shrunk to its mean variance, in the columns' own scale.

    Besides the products of columns it takes one sum over rows for each class, of their squared lengths squared, all in
    one pass.
    """
    scales = {c: np.sqrt(np.diag(g) / max(n, 1)) for c, (n, _, g) in grams.items()}
    for s in scales.values():
        s[s == 0] = 1.0
    square = lambda c: sum(F.pow((F.col(f) - float(m)) / float(d), 2) for f, m, d in zip(x, grams[c][1], scales[c], strict=True))
    beta = rows.agg(*(F.sum(F.when(F.col("y") == c, F.pow(square(c), 2))) for c in grams)).first()
    out = {}
    for b, (c, (n, _, g)) in zip(beta, grams.items(), strict=True):
        if not n:
            out[c] = np.zeros_like(g)
            continue
        s = g / n / np.outer(scales[c], scales[c])
        p, mu, norm = len(x), np.trace(s) / len(x), float((s * s).sum())
        delta = (norm - p * mu * mu) / p
        by = min((b / n - norm) / (p * n), delta)
        amount = by / delta if delta > 0 else 0.0
        out[c] = ((1 - amount) * s + amount * mu * np.eye(p)) * np.outer(scales[c], scales[c])
    return out


def fit_logistic_grid(df: DataFrame, x: list[str], task: str, fold: str, grid: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Candidates of a logistic model by mean balanced accuracy over folds, and the weights of the best refitted.

    A candidate has k (features with the largest F score of the training rows), c (inverse penalty, as 1 / (c * n)),
    l1 (share of the absolute penalty) and balanced (classes weighted to equal shares). All candidates and folds move
    together, a pass a round (see logits). Returns (candidate, k, c, l1, balanced, score, rank) and (task, feature,
    weight), features not selected with weight 0.
    """
    rows = df.select(F.col(fold).alias("fold"), F.array(*(F.col(c).cast("double") for c in x)).alias("x"), F.array(F.col(task).cast("double")).alias("y"))
    logit = [logits.Logit(g["k"], g["c"], float(g["l1"]), bool(g["balanced"]), scaled=False) for g in grid]
    _, ranks, weights = logits.search(rows, len(x), 1, logit)
    held = {r["candidate"]: r for r in ranks.collect()}
    table = [(k, g["k"], float(g["c"]), float(g["l1"]), bool(g["balanced"]), held[k]["balanced_accuracy"], held[k]["rank"]) for k, g in enumerate(grid)]
    best = min(held, key=lambda k: held[k]["rank"])
    w = weights.where((F.col("held") == ALL) & (F.col("candidate") == best)).first()
    spark = df.sparkSession
    return spark.createDataFrame(table, "candidate int, k int, c double, l1 double, balanced boolean, score double, rank int"), spark.createDataFrame([*((task, c, v) for c, v in zip(x, w["weights"], strict=True)), (task, "(intercept)", w["intercept"])], "task string, feature string, weight double")


def out_of_fold(df: DataFrame, x: list[str], y: str, fold: str, folds: int, alpha: float = 1.0) -> DataFrame:
    """Rows with score: the decision value of a ridge classifier that was fitted on the other folds (0 to folds - 1).

    Sums of products by fold are made in one pass, and each fold's model is solved from those of the rest; the scores are
    one expression over all rows, and a row whose fold isn't among them is an error, so that every row is covered once.
    """
    if not df.where(F.col(fold).isNull() | ~F.col(fold).between(0, folds - 1)).isEmpty():
        raise ValueError("rows outside the folds")
    cases = []
    held = collected(df.withColumn("sign", 2.0 * F.col(y) - 1.0), [*x, "sign"], fold)
    for f in range(folds):
        rest: Moments = nothing(len(x) + 1)
        for g, m in held.items():
            rest = rest if g == f else merged(rest, m)
        w, b = ridge_of(rest, len(x), alpha)
        cases.append(F.when(F.col(fold) == f, F.lit(float(b[0])) + sum(F.col(c) * float(v) for c, v in zip(x, w[:, 0], strict=True))))
    return df.withColumn("score", F.coalesce(*cases))


def fit_hinge(df: DataFrame, x: list[str], y: str, penalty: float, rounds: int = 60) -> DataFrame:
    """Hinge-loss weights by subgradient steps of size 1 / (penalty * t), averaged over the second half of the steps.

    Each step is one aggregation over the cached rows; the intercept isn't penalised.
    """
    rows = df.select(*x, y).dropna().withColumn("sign", 2.0 * F.col(y) - 1.0).cache()
    n = float(rows.count() or 1)
    w, total, taken = np.zeros(len(x) + 1), np.zeros(len(x) + 1), 0
    for t in range(1, rounds + 1):
        margin = F.col("sign") * (F.lit(float(w[-1])) + sum(F.col(c) * float(v) for c, v in zip(x, w, strict=False)))
        short = F.when(margin < 1, F.col("sign")).otherwise(0.0)
        g = np.array(rows.agg(*(F.sum(short * F.col(c)) for c in x), F.sum(short)).first(), dtype=float) / n
        step = 1 / (penalty * (t + 10))
        w = w + step * (g - penalty * np.append(w[:-1], 0.0))
        if t > rounds // 2:
            total, taken = total + w, taken + 1
    rows.unpersist()
    w = total / max(taken, 1)
    return coefficients(df, x, [y], w[:-1, None], np.array([w[-1]]))


def assembled(df: DataFrame, x: list[str], y: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=[*x, y]).withColumnRenamed(y, "label")
    return VectorAssembler(inputCols=x, outputCol="features").transform(rows)


def fit_ml(df: DataFrame, x: list[str], y: list[str], kind: str) -> DataFrame:
    """Weights (or importances) per task by Spark ML: logistic, svm, elastic, forest."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    make = {"logistic": lambda: LogisticRegression(regParam=0.01, elasticNetParam=0.0), "svm": lambda: LinearSVC(regParam=0.01, maxIter=30), "elastic": lambda: LinearRegression(regParam=0.01, elasticNetParam=0.5), "forest": lambda: RandomForestRegressor(numTrees=10, maxDepth=4, seed=42)}[kind]
    rows = []
    table = df.select(*x, *y).cache()
    for t in y:
        model = make().fit(assembled(table, x, t))
        weights = model.featureImportances if kind == "forest" else model.coefficients
        rows += [(t, f, float(w)) for f, w in zip(x, weights.toArray(), strict=True)]
    table.unpersist()
    return df.sparkSession.createDataFrame(rows, "task string, feature string, weight double")


def predict_logistic(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """Positive probability of each row by a logistic model fitted on rows of other subjects than every fifth."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = assembled(df, x, y)
    model = LogisticRegression(regParam=0.01).fit(rows.where(F.col("subject") % 5 != 0))
    out = model.transform(rows.where(F.col("subject") % 5 == 0)).withColumn("score", vector_to_array("probability")[1])
    return out.select("subject", F.col("label").alias("y"), "score", (F.col("score") >= 0.5).cast("int").alias("pred"))


def one_vs_rest(df: DataFrame, x: list[str], classes: int) -> DataFrame:
    """Logistic weights of each class against the others, all classes in the same passes: class, feature, weight."""
    rows = df.select(F.array(*(F.col(c) for c in x)).alias("x"), "y")
    c = 100.0 / max(rows.count(), 1)  # a penalty of 0.01 on the mean loss
    found = logits.one_vs_rest(rows, len(x), classes, logits.Logit(len(x), c)).collect()
    out = [(r["task"], f, float(w)) for r in found for f, w in zip(x, r["weights"], strict=True)]
    return df.sparkSession.createDataFrame(out, "class int, feature string, weight double")


def platt(df: DataFrame, rounds: int = 12) -> DataFrame:
    """Slope and offset of a one-feature logistic by Newton steps; each step is one aggregation of the kept scores."""
    a, b = 1.0, 0.0
    rows = df.select("score", "y").cache()
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.col("score") * a + b)))
        e, v, s = p - F.col("y"), p * (1 - p), F.col("score")
        r = rows.agg(F.sum(e * s), F.sum(e), F.sum(v * s * s), F.sum(v * s), F.sum(v)).first()
        h = np.array([[r[2] + 1e-9, r[3]], [r[3], r[4] + 1e-9]])
        step = np.linalg.solve(h, [r[0], r[1]])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-10:
            break
    rows.unpersist()
    return df.sparkSession.createDataFrame([(float(a), float(b))], "a double, b double")


def clip_report(df: DataFrame, *key: str) -> DataFrame:
    """Fractions of raw scores outside [0, 1] and the mean of the clipped ones."""
    raw = F.col("raw")
    return df.groupBy(*key).agg(F.avg((raw < 0).cast("double")).alias("below"), F.avg((raw > 1).cast("double")).alias("above"), F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).alias("mean"))


def matrix_plan(models: DataFrame, families: DataFrame, protocols: list[str]) -> DataFrame:
    """All cells of a model by family by protocol grid with a hash as id; three small lists."""
    cells = models.crossJoin(F.broadcast(families)).withColumn("protocol", F.explode(F.array(*map(F.lit, protocols))))
    return cells.withColumn("cell", F.sha2(F.concat_ws("|", "model", "family", "protocol"), 256))
