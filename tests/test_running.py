"""Running sums of one group that holds all rows, of many groups, ties, nulls and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlake.operators import metrics, running


def plain(rows, inclusive):
    out, held = [], {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        before = held.get(g, 0)
        held[g] = before + (v or 0)
        out.append((g, o, held[g] if inclusive else before))
    return sorted(out, key=repr)


@pytest.mark.parametrize("inclusive", [False, True])
def test_equals_plain_sums(spark, inclusive):
    rng = np.random.default_rng(1)
    rows = [(None if k % 9 == 0 else f"g{rng.integers(0, 5)}" if k % 3 else "hot", k * 7919 % 5003, int(rng.integers(-3, 9)) if k % 10 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    out = running.running_sums(df, ("g",), ("o",), {"total": F.col("v")}, inclusive)
    assert out.columns == ["g", "o", "v", "total"]
    assert sorted(((r.g, r.o, r.total) for r in out.collect()), key=repr) == plain(rows, inclusive)


def test_one_group_is_spread(spark):
    """The largest range of a table with a single key has at most twice the rows of the median."""
    df = spark.range(40_000).select(F.lit("only").alias("g"), F.xxhash64("id").alias("o"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = running.numbered(df, ("g",), ("o",), "k")
    assert out.agg(F.count_distinct("k"), F.min("k"), F.max("k")).first()[:] == (40_000, 0, 39_999)
    sizes = sorted(r["count"] for r in df.repartitionByRange(n, "g", "o").groupBy(F.spark_partition_id()).count().collect())
    assert len(sizes) == n and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    order = out.orderBy("o").select("k").limit(50).collect()
    assert [r.k for r in order] == list(range(50))


def test_descending_order_and_no_group(spark):
    df = spark.createDataFrame([(k, 1.0) for k in (5, 1, 3)], "o long, v double")
    assert {(r.o, r.s) for r in running.running_sums(df, (), (F.desc("o"),), {"s": F.col("v")}, True).collect()} == {(5, 1.0), (3, 2.0), (1, 3.0)}
    assert running.numbered(df.where("false"), (), ("o",), "k").count() == 0


def test_ranking_metrics_of_one_key(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 4000), np.round(rng.random(4000), 2)
    df = spark.createDataFrame([("t", int(a), float(b)) for a, b in zip(y, s, strict=True)], "task string, y int, score double").repartition(4)
    wins = sum((s[y == 1][:, None] > s[y == 0][None, :]).sum(axis=1) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).sum(axis=1))
    assert metrics.roc_auc(df, "task").first().roc_auc == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()))
    ap, last = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        said = s >= t
        recall = (y[said] == 1).sum() / (y == 1).sum()
        ap, last = ap + (recall - last) * (y[said] == 1).mean(), recall
    assert metrics.average_precision(df, "task").first().average_precision == pytest.approx(ap)
