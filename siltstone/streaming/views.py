"""Streams of events: windows with watermarks, deduplication, and views kept up to date from a stream of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.tables import scratch


def source(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that there is and returns its rows. In update mode a batch's folder is overwritten if it
    runs again, and of each key the caller takes the row of the last batch (column batch)."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
    return spark.read.schema(StructType(stream.schema.fields).add("batch", "integer")).parquet(out)


def windowed(events: DataFrame, time: str, size: str, slide: str | None, late: str, keys: list[str], **aggs: Column) -> DataFrame:
    """Tumbling windows, or sliding ones with a slide."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("w.start").alias("ws"), *keys, *aggs)


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str], **aggs: Column) -> DataFrame:
    got = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return got.select(F.col("w.start").alias("ws"), F.col("w.end").alias("we"), *keys, *aggs)


def distinct_within(events: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def last_updates(updates: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


class IncrementalView:
    """Counts and sums by key over a stream of signed rows (sign +1 or -1): a batch's deltas are aggregated and merged into
    the view, which is a table of its own version per batch. Suspended views skip nothing: they catch up on resuming."""

    def __init__(self, spark: SparkSession, keys: list[str], sums: list[str]):
        self.spark, self.keys, self.sums, self.path, self.version = spark, keys, sums, scratch(spark, "view"), -1

    def deltas(self, changes: DataFrame) -> DataFrame:
        return changes.groupBy(*self.keys).agg(F.sum("sign").alias("n"), *[F.sum(F.col(s) * F.col("sign")).alias(s) for s in self.sums])

    def merge(self, batch: DataFrame, i: int) -> None:
        if i <= self.version:
            return  # this batch is in the view already
        new = self.deltas(batch)
        if self.version >= 0:
            new = self.stored().unionByName(new).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in ("n", *self.sums)])
        new.write.mode("overwrite").parquet(f"{self.path}/{i}")
        self.version = i

    def stored(self) -> DataFrame:
        """All keys ever seen: one whose rows cancel out now may come back in a later batch."""
        return self.spark.read.parquet(f"{self.path}/{self.version}")

    def read(self) -> DataFrame:
        return self.stored().filter("n <> 0")

    def follow(self, changes: DataFrame) -> None:
        """Takes in all that there is of a stream."""
        state = f"{self.path}/_state"
        changes.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(self.merge).start().awaitTermination()
