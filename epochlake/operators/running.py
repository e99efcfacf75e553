"""Running sums and numbers within groups of any size: no group has to be sorted by one task.

Rows are dealt to ranges of (group, order), so that a group of all rows is spread like many small ones. Sums within a
range, and the totals of the ranges before it, give each row's sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlake.operators.store import kept

PLACE = (1 << 33) - 1


def running_sums(df: DataFrame, group: tuple[str, ...], order: tuple[Column | str, ...], sums: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """Rows with the sums, by name, of the rows before them in their group, and of themselves if inclusive.

    A null is a group like any other. Rows that tie in the order follow each other in some order. The totals of ranges
    are as many as ranges and groups; a group's offsets are a window over its ranges.
    """
    names = {f"_sum_{k}": c for k, c in enumerate(sums.values())}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in group), *(F.col(o) if isinstance(o, str) else o for o in order)]
    rows = df.select("*", *(F.coalesce(c, F.lit(0)).alias(k) for k, c in names.items()))
    rows = kept(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))

    of = [F.col(c).alias(f"_of_{k}") for k, c in enumerate(group)]
    totals = rows.groupBy(F.col("_range").alias("_in"), *of).agg(*(F.sum(k).alias(f"{k}_total") for k in names))
    before = Window.partitionBy(*(f"_of_{k}" for k in range(len(group)))).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_in", *(f"_of_{k}" for k in range(len(group))), *(F.coalesce(F.sum(f"{k}_total").over(before), F.lit(0)).alias(f"{k}_before") for k in names))

    inside = Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.select("*", *(F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_inside") for k in names))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(group)), F.col("_range") == F.col("_in"))
    out = rows.join(offsets, same)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in sums), *((F.col(f"{k}_inside") + F.col(f"{k}_before")).alias(name) for k, name in zip(names, sums, strict=True)))


def numbered(df: DataFrame, group: tuple[str, ...], order: tuple[Column | str, ...], name: str) -> DataFrame:
    """Rows with their number, from 0, within their group in the given order."""
    return running_sums(df, group, order, {name: F.lit(1)})
