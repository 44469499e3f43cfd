"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's bytes (lower-cased A-Z, runs of ASCII white space as one space, so that line breaks do
not hide a copy); a chunk ends where its low bits are zero, not before LEAST and at MOST bytes at the latest. Cuts depend
on the last 32 bytes alone, so after an insertion the chunks soon fall into step again. Chunks are digested to 64 bits;
of the documents that hold a digest the smallest doc_id keeps the chunk, and in all others, and where a document repeats
itself after the first time, it is a repeat. Texts are cut with FINE_LEAST and FINE_MASK, chunks of 31 bytes on average, so
a passage of 50 words (some 300 bytes) holds several whole chunks; a document counts as repeating when the repeats in one
run make up at least RUN bytes, which is more than what texts share by chance. Among the 3 * 10^12 chunks of 100 TB a few hundred
thousand pairs of different ones may share a digest; RUN takes two chunks or more, so such a pair alone marks no document.

Scale: texts go through Python once, and a document's chunks are one row of two arrays, 10 bytes a chunk. Digests alone are counted,
with partial aggregates before the shuffle; then a chunk's digest, document and place, each packed into a long, meet the
digests of several documents. Of these, the ones in more than a thousandth of all chunks are a
thousand at most and are broadcast; the others are joined by shuffle. What a document repeats of itself needs neither.

Defined cases: a null text counts as empty and has no chunk; a text shorter than FINE_LEAST is one chunk; a document is a row
known by its doc_id (of any type) and text, so an identical row with the same doc_id is the same document, and rows of one
doc_id with different texts keep each other's chunks; a null doc_id keeps no chunk that another document holds; texts are read
whole; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches, written

LEAST, MOST, MASK = 24, 256, 31
#: What texts are cut with: finer than the defaults of cuts(), so that a copied passage of 51 words seldom has less than RUN bytes of chunks.
FINE_LEAST, FINE_MASK = 16, 15
#: Bytes of repeats in a row that make a document a repeating one.
RUN = 80
HEAVY = 1000
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]+")


def cuts(raw: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Where the chunks end."""
    n = len(raw)
    h = GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < 32:  # h[i] is the sum of GEAR[raw[i - k]] << k for k below span
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, span * 2
    # Bit b of a hash sees the last b + 1 bytes, so the highest five see 28 and more.
    out, start = [], 0
    for i in (np.flatnonzero((h >> np.uint32(27)) & np.uint32(mask) == 0) + 1).tolist():
        while i - start > most:
            start += most
            out.append(start)
        if i - start >= least:
            out.append(i)
            start = i
    while n - start > most:
        start += most
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Digests (signed), starts and lengths of a text's chunks, in bytes of its normalised form."""
    raw = BLANK.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip()
    ends = cuts(raw, FINE_LEAST, MOST, FINE_MASK) if raw else []
    starts = [0, *ends][: len(ends)]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))
    return digests.view(np.int64).tolist(), starts, [b - a for a, b in zip(starts, ends, strict=True)]


def chunked(text: Column) -> Column:
    """The chunks of a text: the digests and places of those that it has not had before, and the places of the others. A
    place is start * 512 + length."""

    @F.arrow_udf("struct<digests: array<long>, places: array<long>, again: array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            digests, places, again, ends, stops = [], [], [], [0], [0]
            for t in texts:
                d, a, n = chunks(t.as_py())
                seen: set[int] = set()
                for x, at, size in zip(d, a, n, strict=True):
                    if x in seen:
                        again.append(at << 9 | size)
                    else:
                        seen.add(x)
                        digests.append(x)
                        places.append(at << 9 | size)
                ends.append(len(digests))
                stops.append(len(again))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, pa.int64())) for e, v in ((ends, digests), (ends, places), (stops, again))]
            yield pa.StructArray.from_arrays(lists, ["digests", "places", "again"])

    return run(text)


def longest_run() -> Column:
    """Bytes of the longest row of adjoining repeats in `repeats`, sorted structs of start and size."""
    step = lambda s, x: F.struct(
        F.when(x["start"] == s["end"], s["run"] + x["size"]).otherwise(x["size"]).alias("run"),
        (x["start"] + x["size"]).alias("end"),
        F.greatest(s["best"], F.when(x["start"] == s["end"], s["run"] + x["size"]).otherwise(x["size"])).alias("best"),
    )
    zero = F.struct(F.lit(0).alias("run"), F.lit(-1).alias("end"), F.lit(0).alias("best"))
    return F.aggregate("repeats", zero, step, lambda s: s["best"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document (doc_id and text_id, xxhash64 of its text) with repeats: `repeats`, their starts, sizes and the
    doc_id that keeps the chunk (its own where it repeats itself), in order of place."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_id"), chunked(text).alias("c"))
    rows = written(found.select("doc_id", "text_id", "c.*").withColumn("row", F.monotonically_increasing_id()), "chunks")
    each = rows.select("doc_id", F.explode("digests").alias("digest"))
    shared = written(each.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    total = rows.agg(F.sum(F.size("digests"))).first()[0] or 0
    heavy = F.broadcast(shared.filter(F.col("n") * HEAVY > total))
    at = rows.select("row", F.explode(F.arrays_zip("digests", "places")).alias("c")).select("c.digests", "c.places", "row").toDF("digest", "place", "row")
    light = at.join(heavy, "digest", "left_anti").join(shared, "digest")
    met = at.join(heavy, "digest").unionByName(light).select("row", F.struct("place", "owner").alias("c"))
    # Of a document, all chunks that others keep are one row, by the number of its row, which needs no id of a certain type.
    met = met.groupBy("row").agg(F.collect_list("c").alias("met"))
    own = rows.select("row", "doc_id", "text_id", F.transform("again", lambda p: F.struct(p.alias("place"), F.col("doc_id").alias("owner"))).alias("own"))
    both = own.join(met, "row", "left")
    kept = F.filter(F.coalesce("met", F.array().cast(both.schema["met"].dataType)), lambda x: ~x["owner"].eqNullSafe(F.col("doc_id")))
    spans = F.transform(F.concat(kept, "own"), lambda x: F.struct(F.shiftright(x["place"], 9).cast("int").alias("start"), (x["place"] % 512).cast("int").alias("size"), x["owner"].alias("owner")))
    out = both.select("doc_id", "text_id", F.array_sort(spans).alias("repeats")).filter(F.size("repeats") > 0)
    return out.groupBy("doc_id", "text_id").agg(F.first("repeats").alias("repeats"))


def without(text: Column, gone: Column) -> Column:
    """The normalised text without the stretches in gone (array of structs of start and size, in bytes, sorted)."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                raw = BLANK.sub(b" ", (t or "").encode("utf-8", "surrogatepass").lower()).strip()
                at, kept = 0, []
                for x in s or []:
                    kept.append(raw[at : x["start"]])
                    at = x["start"] + x["size"]
                out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.array(out, pa.string())

    return run(text, gone)


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """Per row: doc_id, text, n_repeats, repeat_bytes, longest_run, repeating (longest_run reaches run), owners (the
    doc_ids that keep the repeated chunks, but its own) and repeats."""
    found = repeats(docs, id_col, text_col).withColumnsRenamed({"doc_id": "id", "text_id": "of"})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_id"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left")
    both = both.withColumn("repeats", F.coalesce("repeats", F.array().cast(found.schema["repeats"].dataType)))
    owners = F.array_sort(F.array_distinct(F.filter(F.transform("repeats", lambda x: x["owner"]), lambda x: ~x.eqNullSafe(F.col("doc_id")))))
    out = both.select("doc_id", "text", F.size("repeats").cast("long").alias("n_repeats"), F.aggregate("repeats", F.lit(0).cast("long"), lambda s, x: s + x["size"]).alias("repeat_bytes"), longest_run().alias("longest_run"), owners.alias("owners"), "repeats")
    return out.withColumn("repeating", F.col("longest_run") >= run)
