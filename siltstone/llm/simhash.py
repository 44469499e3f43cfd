"""SimHash near-duplicates by anchor points of a covering code, and their connected components.

A fingerprint of 64 bits is read as two halves of 32. Of fingerprints that differ in at most 3 bits, one half differs in
at most 1. Each half has a covering code as its anchors: the Hamming code of length 31 over its low bits, its high bit
free; every point lies within the covering radius 1 of exactly one anchor. A fingerprint is replicated to every anchor
within the radius plus the threshold of a half, 1 + 1 (17 anchors at most), and meets there those whose own nearest
anchor it is. So every linked pair meets at an anchor: none is lost, and only exact distances of 3 or less are kept.

Scale: copies of a fingerprint are one row from the start, so a group of equal texts costs one fingerprint. A pair has
one row per anchor that it meets at, no set of links is ever gathered in a task, and components come from label
hooking and pointer jumping over tables in the shared folder. Anchors that more than CROWD fingerprints are nearest to
are split by blocks of 8 bits of the other half: that half differs in 3 bits at most, so one of its 4 blocks is equal.

Defined cases: a null or empty text has fingerprint zero and links like any other; texts of one or two words are one
shingle; repeated rows and ids give repeated rows; a null doc_id is never the smallest of its component unless
all are null; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import parted, small_batches, written

WORDS, SEED, BITS = 3, 42, 3
#: Fingerprints at an anchor beyond which it is split.
CROWD = 2000
#: A key of more rows than the rows over this is looked up by broadcast; there are HEAVY of these at most.
HEAVY = 1000
#: Shingles counted at a time.
AT_ONCE = 1 << 16


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned; a bit is 1 if it is set in over half of the shingles' hashes."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(1, len(w) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        ones += np.unpackbits(hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The 64 bits as a signed long."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.fromiter((simhash(t.as_py(), words) for t in texts), np.uint64, len(texts))
            yield pa.array(found.view(np.int64))

    return run(text)


def nearest(half: Column) -> Column:
    """The anchor of a half (a long of 32 bits): its low 31 bits with the one that their syndrome names flipped."""
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        syndrome = syndrome + (F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << j)
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), syndrome - 1)
    return F.when(syndrome > 0, half.bitwiseXOR(flip)).otherwise(half)


def halves(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.call_function("shiftrightunsigned", fp, F.lit(32))]


def keyed(fps: DataFrame, reach: int) -> DataFrame:
    """One row for each half and anchor: the nearest one, or with a reach of 1 all within 2."""
    low, high = halves(F.col("fp"))
    near = lambda half: F.array(nearest(half)) if not reach else F.array_distinct(F.transform(F.array_insert(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), 1, half), nearest))
    at = lambda k, half, other: F.transform(near(half), lambda a: F.struct(F.lit(k).alias("half"), a.alias("anchor"), other.alias("other")))
    both = fps.select("fp", F.explode(F.concat(at(0, low, high), at(1, high, low))).alias("k"))
    return both.select("fp", "k.half", "k.anchor", "k.other")


def close(own: DataFrame, probe: DataFrame, on: list[str], bits: int) -> DataFrame:
    """The pairs that meet. Always by shuffle: Spark sizes a table as before its explode, and would broadcast 34 replicas a fingerprint."""
    met = own.withColumnRenamed("fp", "a").hint("merge").join(probe.withColumnRenamed("fp", "b").hint("merge"), on)
    return met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """The pairs a < b of distinct fingerprints (column fp) at a distance of 1 to bits (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("halves of radius 1 cover up to 3 bits")
    on = ["half", "anchor"]
    own, probe = keyed(fps, 0), keyed(fps, 1)
    counts = own.groupBy(on).count().filter(F.col("count") > crowd)
    hot = written(counts.select(on), "anchors")
    if hot.isEmpty():
        return close(own.drop("other"), probe.drop("other"), on, bits).distinct()
    block = lambda df: df.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("i"), F.call_function("shiftright", F.col("other"), i * 8).bitwiseAND(F.lit(255)).alias("v"))))).drop("other")
    cold = close(own.join(hot, on, "left_anti").drop("other"), probe.join(hot, on, "left_anti").drop("other"), on, bits)
    crowded = close(block(own.join(hot, on, "left_semi")), block(probe.join(hot, on, "left_semi")), [*on, "block"], bits)
    return cold.union(crowded).distinct()


def star(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): each with m, the smallest v of its u. A hub, a node of more than a thousandth of all edges, would put all
    of them into one task; there are a thousand at most, so theirs are broadcast."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    hubs = F.broadcast(least.filter(F.col("n") * HEAVY > total).drop("n"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs.select("u"), "u", "left_anti").join(least.drop("n"), "u"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Of pairs (a, b): for each node its root, the smallest node that it reaches. Alternates large and small stars:
    a large star links a node's larger neighbours to its smallest one, a small star its smaller ones; both keep the
    components, and they end when every edge points at a root."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    digest = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % (1 << 31))).first()
    before = digest(edges)
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(star(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        small = star(large).select(F.inline(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))))
        edges = written(small.distinct(), "edges")
        after = digest(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components have not settled in {most} rounds")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, text_id (xxhash64 of its text), fp (long), component_id, the smallest doc_id that is reachable over
    links, and first, the doc_id and text_id of the component's first row: by doc_id, null last, then text_id."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_id"), fingerprint(F.col(text_col), words).alias("fp"))
    found = written(found, "fingerprints")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id"))
    least = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), order.alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(least.select("fp"), bits, crowd))
    classes = written(least.join(roots, least.fp == roots.node, "left").select("fp", "least", "first", "n", F.coalesce("root", "fp").alias("root")), "classes")
    # A component of more than a thousandth of all fingerprints is looked up by broadcast, like a fingerprint of as many rows below.
    smallest = written(classes.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"), F.count(F.lit(1)).alias("size")), "smallest")
    total, rows = classes.count(), classes.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(smallest.filter(F.col("size") * HEAVY > total).drop("size"))
    of = classes.drop("first", "least")
    of = of.join(large, "root").unionByName(of.join(large.select("root"), "root", "left_anti").join(smallest.drop("size"), "root")).drop("root")
    heavy = F.broadcast(of.filter(F.col("n") * HEAVY > rows).drop("n"))
    out = found.join(heavy, "fp").unionByName(found.join(heavy.select("fp"), "fp", "left_anti").join(of.drop("n"), "fp"))
    return out.select("doc_id", "text_id", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Per row: doc_id, fp (long) and component_id, the smallest doc_id that is reachable over links."""
    return grouped(docs, id_col, text_col, words, bits, crowd).select("doc_id", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents less all but one of each component: its first row stays, by doc_id (null last), then by its text's hash.
    Rows are told apart by doc_id and text, so one id on two texts is two rows, and rows equal to the first one stay."""
    gone = grouped(docs).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))))
    gone = written(gone.select(F.col("doc_id").alias("id"), F.col("text_id").alias("of"), F.xxhash64("doc_id", "text_id").alias("h")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("text_id"))
    maybe, rest = parted(rows.withColumn("h", F.xxhash64("row.doc_id", "text_id")), gone)
    kept = maybe.join(gone.drop("h").hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left_anti")
    return kept.unionByName(rest).select("row.*")
