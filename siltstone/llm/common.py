"""What the operators share: scratch tables, table loading, ASCII lower-casing, the split into training and held-out rows."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import scratch

#: The white space of the contracts: space and \t \n \v \f \r.
SPACE = "[\\x20\\x09-\\x0D]"
#: Rows in an Arrow batch. Texts reach some 100 kB, so the default of 10,000 rows would not fit a worker.
ARROW_ROWS = 256
#: Bits of the map that tells which rows may have a key: 2 MB, of 262,144 longs.
BITS = 1 << 24


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds what a Python worker holds of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df, to be broadcast if it has so few rows (counted here); for rows of a few bounded fields only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parted(rows: DataFrame, keys: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash (column h) may be among those of keys, and the rest, for which it isn't. Only the former need to be
    shuffled to meet the keys. What is broadcast is a bitmap of a fixed size, whatever the size of keys."""
    at = F.pmod(F.col("h"), F.lit(bits))
    bit = (at % 64).cast("int")
    words = keys.groupBy(F.floor(at / 64).cast("int").alias("bit_at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bit_word"))
    met = rows.join(F.broadcast(written(words, "bitmap")), F.floor(at / 64).cast("int") == F.col("bit_at"), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("bit_word"), bit).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return tuple(met.filter(x).drop("bit_at", "bit_word") for x in (hit, ~hit))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does the same, and is faster, where no other character can have a lower case."""
    plain = ~text.rlike("[^\\x00-\\xBF\\xDF-\\xF6\\xF8-\\xFF\\u2010-\\u2040]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out of all training. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return bucket(doc_id) == 2
