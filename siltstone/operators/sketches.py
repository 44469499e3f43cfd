"""Frequency sketches and their exact counterparts, differential privacy, and fits over rank frequencies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_min(df: DataFrame, x: str, depth: int = 4, width: int = 1024) -> DataFrame:
    """Cells (row, cell, n) of a count-min sketch: a map of depth x width counts, merged map-side."""
    cell = lambda i: F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), x), F.lit(width)).alias("cell"))
    return df.select(F.explode(F.array(*[cell(i) for i in range(depth)])).alias("c")).groupBy("c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))


def estimate(keys: DataFrame, x: str, sketch: DataFrame, depth: int = 4, width: int = 1024) -> DataFrame:
    """For each key its estimate, the least of its cells. The sketch has depth x width rows at most and is broadcast."""
    cell = lambda i: F.struct(F.lit(i).alias("row"), F.pmod(F.xxhash64(F.lit(i), x), F.lit(width)).alias("cell"))
    asked = keys.select(x, F.explode(F.array(*[cell(i) for i in range(depth)])).alias("c")).select(x, "c.row", "c.cell")
    return asked.join(F.broadcast(sketch), ["row", "cell"]).groupBy(x).agg(F.min("n").alias("estimate"))


def second_moment(df: DataFrame, x: str) -> DataFrame:
    """Exact F2: the sum of squared frequencies."""
    return df.groupBy(x).count().agg(F.sum(F.col("count") * F.col("count")).alias("f2"))


def ams(df: DataFrame, x: str, rows: int = 32) -> DataFrame:
    """Estimated F2 from sums of random signs."""
    sign = lambda i: F.when(F.xxhash64(F.lit(i), x).bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)
    sums = df.agg(*[F.sum(sign(i)).alias(f"s{i}") for i in range(rows)])
    return sums.select((sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(rows)), F.lit(0)) / rows).alias("f2"))


def heavy_hitters(df: DataFrame, x: str, k: int) -> DataFrame:
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), x).limit(k)


def histogram(x: Column, low: float, high: float, buckets: int) -> Column:
    """The bucket of a value, 0 below and buckets + 1 above."""
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(buckets))


def zipf_exponent(counts: DataFrame, n: str, most: int = 10_000) -> float:
    """Least squares of log frequency on log rank, over the most frequent ranks."""
    rows = [r[0] for r in counts.orderBy(F.desc(n)).limit(most).select(n).collect()]
    points = [(math.log(i + 1), math.log(v)) for i, v in enumerate(rows) if v > 0]
    mx, my = (sum(p[i] for p in points) / len(points) for i in (0, 1))
    return -sum((a - mx) * (b - my) for a, b in points) / max(1e-12, sum((a - mx) ** 2 for a, _ in points))


class Budget:
    """Spends epsilon over queries; refuses what goes beyond."""

    def __init__(self, epsilon: float):
        self.left = epsilon

    def spend(self, epsilon: float) -> float:
        if epsilon <= 0 or epsilon > self.left + 1e-12:
            raise ValueError("the privacy budget is spent")
        self.left -= epsilon
        return epsilon


def laplace(x: Column, sensitivity: float, epsilon: float, seed: int | None = None) -> Column:
    """Adds Laplace noise of scale sensitivity / epsilon; after aggregation, so one draw a group."""
    u = F.rand(seed) - 0.5
    return x - F.lit(sensitivity / epsilon) * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def gaussian(x: Column, sensitivity: float, epsilon: float, delta: float, seed: int | None = None) -> Column:
    return x + F.randn(seed) * (sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon)
