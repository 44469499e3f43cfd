"""Aggregates beyond Spark's own spelling, and window frames that it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """A REAL sum, 0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, sep: str = ",") -> Column:
    return F.listagg(x.cast("string"), F.lit(sep))


def group_concat_by(x: Column, order: Column, sep: str = ",") -> Column:
    cells = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("string").alias("v")))))
    return F.array_join(F.transform(cells, lambda s: s["v"]), sep)


def percentile(x: Column, p: float) -> Column:
    """p from 0 to 100, with linear interpolation."""
    return F.percentile(x, F.lit(p / 100))


def percentile_cont(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def percentile_disc(df: DataFrame, keys: list[str], x: str, p: float, out: str) -> DataFrame:
    """Per group the value at place ceil(p n), from 1, as a REAL. Values are counted first, so what meets in a window is
    the distinct values of a group and not its rows."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    at = F.greatest(F.lit(1), F.ceil(F.sum("_n").over(own) * p))
    upto = F.sum("_n").over(own.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_past", upto >= at).filter("_past").groupBy(*keys).agg(F.min(x).cast("double").alias(out))


def numbered_groups(df: DataFrame, partition: list[str], order: list, name: str = "g") -> DataFrame:
    """Adds the number of each row's peer group: RANGE frames over it are GROUPS frames over the order."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))


def groups_frame(partition: list[str], start: int, end: int, name: str = "g"):
    return Window.partitionBy(*partition).orderBy(name).rangeBetween(start, end)


def sum_excluding(df: DataFrame, x: str, partition: list[str], order: list, exclude: str, out: str) -> DataFrame:
    """Running sum and count up to the current row's peers, but for: 'current row', 'group' or 'ties'."""
    df = numbered_groups(df, partition, order, "_g")
    upto = Window.partitionBy(*partition).orderBy("_g").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*partition).orderBy("_g").rangeBetween(Window.unboundedPreceding, -1)
    if exclude == "current row":
        value = F.sum(x).over(upto) - F.col(x)
        n = F.count(x).over(upto) - F.col(x).isNotNull().cast("int")
    else:
        own = F.coalesce(F.col(x), F.lit(0)) if exclude == "ties" else F.lit(0)
        value = F.coalesce(F.sum(x).over(before), F.lit(0)) + own
        n = F.count(x).over(before) + (F.col(x).isNotNull().cast("int") if exclude == "ties" else 0)
    return df.withColumn(out, F.when(n > 0, value)).drop("_g")
