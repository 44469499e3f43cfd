"""Best-fit packing of documents into sequences of several permitted lengths.

Documents, measured in words, longer than the longest sequence are cut into full pieces and a rest. Pieces go longest first
into the open bin that they fill best. A sequence costs a fixed part, its length, and its length squared over SQUARE, as
attention does, so no length is best for all pieces. If no bin has room, one is opened in the size that costs least for each
word that it can be expected to hold: its piece and those still to come that fit beside it, from a histogram of their sizes. The
lengths are optimised jointly: each shard is also packed with bins of at least each permitted length, and the cheapest of
these packings is taken. At the end each bin shrinks to the shortest permitted length that holds its contents.

Scale: pieces, which carry no text, are spread over shards by a hash; a shard has SHARD pieces in expectation and is
packed in runs of LIMIT at most, so memory is bounded whatever repeats. Bins are the same on any cluster, as shards are
sorted and no bin spans two.

Defined cases: a null or empty text, or one without words, is a piece of no words and still in a bin; repeated rows are
packed as often as they are there; a doc_id may be of any type, and a null one stays null in its bin; empty tables give no
bins; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

LENGTHS, FIXED, SQUARE = (512, 1024, 2048, 4096, 8192), 64, 8192
SHARD, LIMIT = 20_000, 60_000
WORDS = "[^\\x20\\x09-\\x0D]+"
BIN = "bin_id long, capacity int, used int, pieces array<struct<doc_id: {}, piece: int, start: long, n: int, at: int>>"


def cost(c: int, fixed: int = FIXED) -> float:
    return fixed + c + c * c / SQUARE


def opened(n: int, rest: np.ndarray, lengths: tuple[int, ...], fixed: int) -> int:
    """The size of a new bin for a piece of n words: least cost per word that it can hold. rest: words to come by size of their pieces."""
    return min((c for c in lengths if c >= n), key=lambda c: (cost(c, fixed) / max(1, n + min(c - n, int(rest[: c - n + 1].sum()))), c))


def packed(sizes: list[int], order: list[int], lengths: tuple[int, ...], fixed: int, least: int) -> tuple[list[list[int]], list[int]]:
    """A best-fit packing whose bins are opened in the size of least cost, or if least is given, in the shortest that
    is no shorter; the bins and their final lengths."""
    rest = np.bincount(sizes, minlength=max(lengths) + 1) * np.arange(max(max(sizes), max(lengths)) + 1)
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}  # from room left to the bins with it; mask has a bit for each such room
    mask = 0
    for i in order:
        n = sizes[i]
        rest[n] -= n
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room = min(c for c in lengths if c >= max(n, least)) if least else opened(n, rest, lengths, fixed)
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        free.setdefault(room - n, []).append(b)
        mask |= 1 << room - n
    return bins, [min(c for c in lengths if c >= sum(sizes[i] for i in b)) for b in bins]


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, fixed: int = FIXED) -> tuple[list[list[int]], list[int]]:
    """Of pieces, none over the longest length: the bins, as lists of positions in sizes, and their lengths."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    if not sizes:
        return [], []
    ways = (packed(sizes, order, lengths, fixed, least) for least in (0, *lengths))
    return min(ways, key=lambda x: sum(cost(c, fixed) for c in x[1]))


def pieces(docs: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...]) -> DataFrame:
    """doc_id, text_id, piece, start (a word) and n."""
    most = max(lengths)
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_id"), n.alias("words"))
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / most).cast("int"), F.lit(1)) - 1)))
    start = F.col("piece").cast("long") * most
    return cut.select("doc_id", "text_id", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(most)).cast("int").alias("n"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, fixed: int = FIXED, shard: int = SHARD, limit: int = LIMIT) -> DataFrame:
    """Per bin: bin_id, capacity, used, doc_ids and pieces (doc_id, piece, start, n and the place in the bin, `at`)."""
    lengths = tuple(sorted(lengths))
    rows = written(pieces(docs, id_col, text_col, lengths), "pieces")
    shards = max(1, -(-rows.count() // shard))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_id", "piece"), F.lit(shards)))
    spread = spread.repartition("shard").sortWithinPartitions("shard", "doc_id", "text_id", "piece").select("shard", "doc_id", "piece", "start", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, part = None, 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.column("n").to_pylist()
            bins, caps = best_fit(n, lengths, fixed)
            for k in range(0, len(bins), 2000):
                some = bins[k : k + 2000]
                rows = table.take(pa.array([i for b in some for i in b], pa.int64()))
                places, used = [], []
                for b in some:
                    place = 0
                    for i in b:
                        places.append(place)
                        place += n[i]
                    used.append(place)
                ends = np.cumsum([0, *map(len, some)])
                cols = [*(rows.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "n")), pa.array(places, pa.int32())]
                items = pa.StructArray.from_arrays(cols, ["doc_id", "piece", "start", "n", "at"])
                ids = np.int64(at << 40) + np.int64(part << 20) + np.arange(k, k + len(some))  # LIMIT bounds a part's bins
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(caps[k : k + 2000], pa.int32()), pa.array(used, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["bin_id", "capacity", "used", "pieces"])

        for batch in batches:
            shard_of = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and (shard_of[a] != at or sum(map(len, held)) + b - a > limit):
                    yield from out()
                    part = part + 1 if shard_of[a] == at else 0
                    held = []
                at = int(shard_of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return spread.mapInArrow(run, BIN.format(kind)).select("bin_id", "capacity", "used", F.transform("pieces", lambda x: x["doc_id"]).alias("doc_ids"), "pieces")
