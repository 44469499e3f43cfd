"""Exact deduplication by a stateful stream.

Each row's normalised text is digested; a stream reads the keys (digest, length, identifier, locator) and keeps for
every digest, in state on disk (RocksDB) that never expires, the number of rows, the largest identifier and the content
locator of that row. Its updates go to a table in the shared folder, one folder per batch, so a batch that runs again
overwrites itself. Digests seen more than once are hits: for these the full texts are grouped, which compares every
byte, and a digest shared by different texts falls apart into its texts.

Scale: the stream aggregates before it shuffles, so a third of all rows under one digest is one row per task; hits are
grouped by digest and text with the same pre-aggregation; a bitmap of a fixed size tells which texts can be hits, so others
are never shuffled. Looking the results up again would be skewed by such groups:
those of more than a thousandth of all rows are at most a thousand, and are broadcast; the others are joined by shuffle.

Defined cases: null counts as empty; of rows with equal texts and the same largest doc_id the last one in the scan
(largest locator) stays; a null doc_id is smaller than any other; empty tables give empty tables; other columns are
never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.llm.common import ascii_lower, parted, scratch, written

#: Bytes of keys (some 50 a row) in a batch of the stream.
BATCH = 16 << 30
#: A group of more rows than the rows over this is looked up by broadcast; there are HEAVY of these at most.
HEAVY = 1000
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def located(docs: DataFrame) -> DataFrame:
    """Each row of docs as `row`, with `locator`, its file and place there. Rows that are not read from files are first
    written to the shared folder."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("locator")
    return docs.select(row, at) if is_scan(docs) else written(docs.select(row), "documents").select("row", at)


def is_scan(docs: DataFrame) -> bool:
    if "_metadata" in docs.columns:  # hides what Spark knows of the files
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() in ("UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
            return False
        raise
    return True


def streamed(keys: DataFrame, path: str, batch: int = BATCH) -> DataFrame:
    """What the stream's state holds after all files of path: one row for each digest and length."""
    spark = keys.sparkSession
    out, state = scratch(spark, "updates"), scratch(spark, "state")
    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(keys.schema).option("maxBytesPerTrigger", batch).parquet(path)
        groups = source.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
        sink = groups.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        sink.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start().awaitTermination()
        kinds = StructType(groups.schema.fields).add("batch", "integer")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    updates = written(spark.createDataFrame([], kinds), "none") if keys.isEmpty() else spark.read.schema(kinds).parquet(out)
    return updates.groupBy("digest", "n_bytes").agg(F.max_by(F.struct("n", "last"), "batch").alias("s")).select("digest", "n_bytes", "s.n", "s.last")


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """Per row: doc_id, locator, digest (of the normalised text), keep_id, keep_locator and group_size."""
    return of_located(located(docs), id_col, text_col, batch, digest)


def of_located(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """duplicates() of the rows of located()."""
    on, spark = ["digest", "n_bytes"], rows.sparkSession
    text = normalised(F.col(f"row.`{text_col}`"))
    full = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), "locator", digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("content"))
    path = scratch(spark, "keys")
    full.drop("content").write.parquet(path)
    keys = spark.read.schema(full.drop("content").schema).parquet(path)
    groups = written(streamed(keys, path, batch), "groups")

    # Hits: the bytes themselves are the grouping key; the digest alone decides nothing. Texts of no hit stay where they are,
    # and equal texts of a task become one before any of them is shuffled.
    hits = groups.filter("n > 1").select(*on, F.xxhash64("digest").alias("h"))
    seen = parted(full.withColumn("h", F.xxhash64("digest")), hits)[0].drop("h")
    texts = seen.groupBy(*on, "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("last"))
    checked = written(texts.drop("content"), "checked")
    clash = checked.groupBy(on).count().filter("count > 1").select(on)
    single = groups.filter("n = 1").unionByName(checked.join(hits.drop("h"), on, "left_semi"))  # checked has false hits of the bitmap, too
    same = single.join(clash, on, "left_anti")

    rows = groups.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(groups.filter(F.col("n") * HEAVY > rows).select(on))
    cols = ["doc_id", "locator", "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("keep_locator"), F.col("n").alias("group_size")]
    found = keys.join(F.broadcast(same.join(heavy, on, "left_semi")), on).select(*cols)
    found = found.unionByName(keys.join(heavy, on, "left_anti").join(same, on).select(*cols))
    if not clash.isEmpty():  # different texts of one digest: their rows are looked up by the text
        apart = full.join(clash, on, "left_semi")
        found = found.unionByName(apart.join(texts.join(clash, on, "left_semi"), [*on, "content"]).select(*cols))
    return found


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))


def keep_last(docs: DataFrame) -> DataFrame:
    """The documents less those with the text of another that stays."""
    rows = located(docs)
    h = F.xxhash64("locator").alias("h")
    gone = written(of_located(rows).filter(~kept()).select("locator", h), "gone")
    maybe, rest = parted(rows.select("row", "locator", h), gone)
    return maybe.join(gone.select("locator").hint("shuffle_hash"), "locator", "left_anti").unionByName(rest.select(maybe.columns)).select("row.*")
