"""Relational operators that take more than one Spark operator: compound queries from left to right, recursion with
UNION, range joins by bins, multiway joins, as-of joins."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import scratch


def compound(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    """Set operators of equal precedence, from left to right; all but UNION ALL give distinct rows."""
    out = first
    for op, df in rest:
        out = {"union": lambda a, b: a.union(b).distinct(), "union all": DataFrame.union, "intersect": DataFrame.intersect, "except": DataFrame.subtract}[op.lower()](out, df)
    return out


def limit(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """A negative limit is none, a negative offset 0."""
    df = df.offset(skip) if skip > 0 else df
    return df.limit(n) if n >= 0 else df


def recursive(base: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows not seen before feed the next round. Each round is a table in the checkpoint
    folder, so plans stay small and a lost executor repeats one round at most."""
    spark = base.sparkSession
    folder = scratch(spark, "recursion")

    def kept(df: DataFrame, i: int) -> DataFrame:
        df.write.parquet(f"{folder}/{i}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{i}")

    fresh = kept(base.distinct(), 0)
    seen = fresh
    for i in range(1, most):
        if fresh.isEmpty():
            return seen
        fresh = kept(step(fresh).distinct().subtract(seen), i)
        seen = seen.union(fresh)
    raise RecursionError(f"not finished after {most} rounds")


def range_join(left: DataFrame, right: DataFrame, x: str, low: str, high: str, width: float) -> DataFrame:
    """left rows whose x lies in [low, high] of a right row. Intervals are spread over bins of the width, so it is an
    equi-join with a filter and not a nested loop over both sides."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.filter(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    return left.withColumn("_bin", F.floor(F.col(x) / width)).join(spread, "_bin").filter(F.col(x).between(F.col(low), F.col(high))).drop("_bin")


#: Strips at most in a dimension, the candidate pairs that cost as much as one replica of a box, and those for a task.
STRIPS, REPLICA, PAIRS = 1024, 30, 20_000_000


def overlap_pairs(boxes: DataFrame, key: str, *sides: tuple[str, str]) -> DataFrame:
    """The pairs of boxes of a table that overlap in two dimensions, sides being (low, high) of each: a < b, their keys.

    In each dimension boxes are ordered by their low side and cut into strips of equal numbers. Two boxes can only meet in
    the strip where the later of the two begins, so a pair has one cell: either one box is the later in both dimensions,
    and the other is replicated over the cells that it covers, or each is the later in one, and both are replicated over
    the strips that they cover in the other. Candidates are the pairs that overlap and a rim of a strip's width. Many equal
    low sides fill several strips, over which a hash of the key spreads them, so no cell gets a large share. Strips are
    chosen, from the count and percentiles, so that replicas and rim together cost least."""
    (x0, x1), (y0, y1) = sides
    df = boxes.select(*[F.col(c).alias(n) for c, n in ((key, "id"), (x0, "x0"), (x1, "x1"), (y0, "y0"), (y1, "y1"))])
    for name in df.columns:
        df = df.filter(F.col(name).isNotNull())
    at = [i / STRIPS for i in range(1, STRIPS)]
    n, *found = df.agg(F.count(F.lit(1)), *[F.percentile_approx(c, at) for c in ("x0", "x1", "y0", "y1")]).first()
    low_x, high_x, low_y, high_y = (sorted(v for v in q or [] if v == v) for q in found)  # NaN is above all bounds
    of = lambda low, high: sum(bisect_right(low, v) - i for i, v in enumerate(high)) / STRIPS**2
    wide, tall = max(0.0, of(low_x, high_x)), max(0.0, of(low_y, high_y))  # the share of all low sides that a box covers
    pairs = lambda k: 2 * n * n * (wide + 1 / k) * (tall + 1 / k)
    k = min((1 << i for i in range(STRIPS.bit_length())), key=lambda k: REPLICA * n * (1 + wide * k) * (1 + tall * k) + pairs(k))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(pairs(k) / PAIRS))  # by pairs, as bytes tell little of the work
    for d, low in (("x", low_x), ("y", low_y)):
        bounds = low[STRIPS // k - 1 :: STRIPS // k]
        below, upto = _rank(F.col(f"{d}0"), bounds, False), _rank(F.col(f"{d}0"), bounds, True)
        df = df.withColumn(f"s{d}", below + F.pmod(F.xxhash64("id", F.lit(d)), upto - below + 1).cast("int")).withColumn(f"e{d}", _rank(F.col(f"{d}1"), bounds, True))
    strips = lambda d: F.explode(F.sequence(f"s{d}", F.greatest(f"s{d}", f"e{d}")))

    def placed(t: str, *spread: str) -> DataFrame:
        out = df
        for d in "xy":
            out = out.withColumn(f"_{d}", strips(d) if d in spread else F.col(f"s{d}"))
        return out.select("_x", "_y", *[F.col(c).alias(f"{t}_{c}") for c in ("id", "x0", "x1", "y0", "y1", "sx", "sy")]).repartition(tasks, "_x", "_y")

    def later(i: str, j: str, d: str) -> Column:
        """i begins after j in dimension d, in this strip, and they overlap there."""
        a, b, cell, strip = F.col(f"{i}_{d}0"), F.col(f"{j}_{d}0"), F.col(f"_{d}"), F.col(f"{j}_s{d}")
        after = (cell > strip) | ((cell == strip) & ((a > b) | ((a == b) & (F.col(f"{i}_id") > F.col(f"{j}_id")))))
        return (a <= F.col(f"{j}_{d}1")) & after & (b <= F.col(f"{i}_{d}1"))

    def met(left: DataFrame, right: DataFrame, *conditions: Column) -> DataFrame:
        both = left.hint("merge").join(right.hint("merge"), ["_x", "_y"])  # Spark sizes a table as before its explode, and would broadcast it
        for c in (*conditions, F.col("i_id") != F.col("j_id")):
            both = both.filter(c)
        return both.select(F.least("i_id", "j_id").alias("a"), F.greatest("i_id", "j_id").alias("b"))

    one = met(placed("j", "x", "y"), placed("i"), later("i", "j", "x"), later("i", "j", "y"))
    return one.union(met(placed("j", "x"), placed("i", "y"), later("i", "j", "x"), later("j", "i", "y")))


def _rank(v: Column, bounds: list[float], equal: bool) -> Column:
    """How many of the sorted bounds are below v (or equal to it), by blocks of 32."""
    if not bounds:
        return F.lit(0)
    under = lambda b: b <= v if equal else b < v
    array = lambda values: F.array(*[F.lit(x) for x in values])
    if len(bounds) <= 32:
        return F.size(F.filter(array(bounds), under))
    block = F.size(F.filter(array(bounds[31::32]), under))
    return block * 32 + F.size(F.filter(F.slice(array(bounds), block * 32 + 1, F.lit(32)), under))


def multiway(*relations: DataFrame, on: list[str]) -> DataFrame:
    """Natural multiway join on shared keys with multiplicities. All relations are partitioned by the same keys, so each is
    shuffled once; counts are multiplied rather than rows where a relation has nothing but keys."""
    out = None
    for i, r in enumerate(relations):
        r = r.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_n{i}")) if set(r.columns) == set(on) else r
        out = r if out is None else out.join(r, on)
    counts = [c for c in out.columns if c.startswith("_n")]
    product = F.lit(1).cast("long")
    for c in counts:
        product = product * F.col(c)
    return out.withColumn("multiplicity", product).drop(*counts)


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: str, out: str) -> DataFrame:
    """For each left row the value of the last right row of the same key at or before its time; one sort of the union."""
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(F.col(on), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_v", True).over(w))
    return both.filter("_side = 1").drop("_t", "_side", "_v")


def series(start: Column, stop: Column, step: Column | int = 1) -> Column:
    """generate_series for each row: inclusive, empty if it can't get there."""
    step = step if isinstance(step, Column) else F.lit(step)
    reaches = F.when(step > 0, start <= stop).when(step < 0, start >= stop)
    return F.when(reaches, F.sequence(start, stop, step)).otherwise(F.array().cast("array<bigint>"))
