"""Column expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(n: Column, d: Column) -> Column:
    """n / d, and 0 unless d > 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def samples(seconds: float, fs: float) -> int:
    """Seconds as a whole number of samples; an error if they are none within 1e-12."""
    n = round(seconds * fs)
    if abs(n - seconds * fs) > 1e-12:
        raise ValueError(f"{seconds} s at {fs} Hz are no whole number of samples")
    return n


def flag(c: Column) -> Column:
    return c.cast("long")


def balanced(tp: Column, fn: Column, tn: Column, fp: Column) -> Column:
    return (tp / (tp + fn) + tn / (tn + fp)) / 2


def macro_f1(tp: Column, fn: Column, tn: Column, fp: Column) -> Column:
    return (safe_div(2.0 * tp, 2 * tp + fp + fn) + safe_div(2.0 * tn, 2 * tn + fp + fn)) / 2


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
