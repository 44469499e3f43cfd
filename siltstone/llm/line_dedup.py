"""Line deduplication: hashes of lines, range-partitioned with a secondary sort, give keep bitmaps instead of texts.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of enough characters that enough
documents hold lose all their lines but those in the largest doc_id that holds them. Only DataFrame functions are used.

Texts are split once, into a table of the places of long lines and their keys' 128-bit hashes. These are range-partitioned by
hash and sorted within each partition by hash, document (the largest first) and position. As the rows stream by, the document
of a hash's first occurrence is the one that keeps it, and the documents are counted where a new one begins. The positions of
the others become one bitmap per document, 64 lines to a long, 1 for a line that stays. It is compressed: only longs with a
line to drop are there, each with the number of longs left out before it; documents that keep everything have none.

Scale: equal hashes lie in one range, so those of more than a thousandth of all lines (and HEAVY lines) are taken out first;
there are a thousand at most. Their documents are counted and their largest found by aggregates that begin in each
task, and are broadcast. Bitmaps meet their texts by shuffle at any size, but texts that have none are told by a bitmap of a
fixed size and stay where they are.

Defined cases: a null or empty text is one empty line; a document is a row, so repeated rows count separately, and all
rows with the largest doc_id keep the line; a null doc_id is smaller than any other; empty tables give empty tables;
other columns are never read. Rows of equal doc_id are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import ascii_lower, parted, written

LENGTH, DOCUMENTS = 40, 5
HEAVY = 10_000
ENDS = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(k: Column) -> list[Column]:
    return [F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")]


def long_lines(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where lines with a long key stand: doc_id, text_id, row (a number for each row of docs), pos from 0, h1 and h2."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_id"), F.monotonically_increasing_id().alias("row"))
    at = rows.select("doc_id", "text_id", "row", F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    at = at.withColumn("line", F.btrim("line", F.lit(ENDS))).filter(F.length("line") >= length)
    return at.select("doc_id", "text_id", "row", "pos", *hashes(ascii_lower(F.col("line"))))


def streamed(at: DataFrame, documents: int) -> DataFrame:
    """The lines to drop, told while ranges of hashes, sorted by document and position, stream by."""
    order = [F.col("doc_id").desc(), F.col("row"), F.col("pos")]
    ranged = at.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    run, of = Window.partitionBy("h1", "h2").orderBy(*order), Window.partitionBy("h1", "h2")
    first = F.first("doc_id").over(run)
    new = F.when(F.col("row") == F.lag("row").over(run), 0).otherwise(1)
    told = ranged.withColumns({"first": first, "new": new}).withColumn("n_docs", F.sum("new").over(of))
    return told.filter((F.col("n_docs") >= documents) & ~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text_id", "pos")


def drops(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS, heavy: int = HEAVY) -> DataFrame:
    """The lines to drop: doc_id, text_id and position from 0."""
    on = ["h1", "h2"]
    at = written(long_lines(docs, length), "lines")  # finding the ranges reads the rows twice; texts are split once
    counts = at.groupBy(on).count().filter(F.col("count") > F.lit(max(heavy, at.count() // 1000)))
    hot = F.broadcast(written(counts.select(on), "hot"))
    of_hot = at.join(hot, on)
    last = of_hot.select(*on, "doc_id", "row").distinct().groupBy(on).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))
    last = F.broadcast(last.filter(F.col("n_docs") >= documents))
    spread = of_hot.join(last, on).filter(~F.col("doc_id").eqNullSafe(F.col("last"))).select("doc_id", "text_id", "pos")
    return streamed(at.join(hot, on, "left_anti"), documents).unionByName(spread)


def bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, documents: int = DOCUMENTS, heavy: int = HEAVY) -> DataFrame:
    """For each document that loses lines: doc_id, text_id (xxhash64 of its text), n_dropped and keep, an array of structs: gap,
    the longs left out as all their lines stay, and bits."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = drops(docs, length, documents, heavy).groupBy("doc_id", "text_id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    rows = words.groupBy("doc_id", "text_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    gap = lambda x, i: x["word"] - F.when(i > 0, F.get("words", i - 1)["word"]).otherwise(-1) - 1
    keep = F.transform("words", lambda x, i: F.struct(gap(x, i).alias("gap"), F.bitwise_not(x["bits"]).alias("bits")))
    return rows.select("doc_id", "text_id", "n_dropped", keep.alias("keep"))


def opened(keep: Column) -> Column:
    """A bitmap as an array of all its longs."""
    return F.flatten(F.transform(keep, lambda x: F.concat(F.array_repeat(F.lit(-1).cast("long"), x["gap"]), F.array(x["bits"]))))


def stays(longs: Column, i: Column) -> Column:
    """Whether line i stays; lines beyond the end do."""
    bits = F.get(longs, F.floor(i / 64).cast("int"))
    return F.coalesce(F.call_function("shiftrightunsigned", bits, (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(True))


def apply_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, n_lines, n_dropped and kept_text. maps is read more than once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_id"))
    maybe, rest = parted(rows.withColumn("h", F.xxhash64("doc_id", "text_id")), maps.select(F.xxhash64("doc_id", "text_id").alias("h")))
    maps = maps.withColumnsRenamed({"doc_id": "id", "text_id": "of"}).hint("shuffle_hash")
    found = maybe.join(maps, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left")
    # Under a lambda the longs are a variable, so they are made once a row and not once a line.
    some = F.transform(F.array(opened(F.col("keep"))), lambda longs: F.array_join(F.filter(lines(F.col("text")), lambda x, i: stays(longs, i)), "\n"))
    kept = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.get(some, F.lit(0)))
    n_lines = F.size(lines(F.col("text"))).cast("long").alias("n_lines")
    lost = found.select("doc_id", "text", n_lines, F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), kept.alias("kept_text"))
    return lost.unionByName(rest.select("doc_id", "text", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, documents: int = DOCUMENTS, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, text, n_lines, n_dropped and kept_text, the text without the lines that its bitmap drops."""
    return apply_bitmaps(docs, written(bitmaps(docs, id_col, text_col, length, documents, heavy), "bitmaps"), id_col, text_col)
