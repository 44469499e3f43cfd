"""Toxicity by lexicon induction: random walks from labelled seed words over a graph of words whose edges are positive
pointwise mutual information give each word a polarity, and documents are scored by their words' polarities.

Words are whole words in lower case. Seeds are the words whose odds in toxic documents of a bounded labelled sample
(LABELLED rows) differ surely from those in the other ones. The graph has the words of FEW documents or more and of the
share COMMON of all documents at most; its edges join words within SPAN of each other, PAIRS times or more, and none
need be a seed. Counts of words and pairs cover every document. The walks restart at the seeds of their side. Three figures
of a document, the sums of its words' positive and negative polarities and the largest, go through a logistic curve that
is fitted on the same labelled sample.

Scale: counts are aggregated in each task before they are shuffled. Pairs travel as hashes of 64 bits, all those of a task with
the same lesser hash in one row; those of a word of more than HUB documents are spread over 64 tasks. Shuffle files are dropped
as soon as the table that needed them is written. What is sent to the workers is bounded: words of more than a share COMMON of the documents are at most the words of a document over
that share; rare words are told by a bitmap of BITS bits, in which a false hit costs a row of the shuffle and changes nothing, as
the graph is joined with exact counts. Seeds stand in LABELLED documents, and as a side's shares add up to one, words of
a polarity of LEAST are some sixteen times the seeds at most: that bounds the lexicon without a cap.

Labels are only taken of rows that are not held out; language, source and id are no input of a score.

Defined cases: a null or empty text has no words and gets the score of such texts; texts are read whole; of several labels
of a document any 1 counts; a null label is none; without labels of both kinds every score is 0; repeated rows give
repeated results; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import held_out, small_batches
from siltstone.llm.common import written as kept

SPAN, FEW, COMMON = 1, 5, 0.05
LABELLED = 40_000
#: How sure a seed is (signed root of its log-likelihood ratio; 4.5 leaves no chance findings among a million words), and
#: of which share of its labelled documents must be toxic.
SURE, MOSTLY = 4.5, 0.6
#: Bits of the map of words that aren't rare.
BITS = 1 << 24
#: Documents beyond which the pairs of a word are too many for one task.
HUB = 1_000_000
#: Pairs seen less often say nothing; chance that a step of a walk goes back to its seeds; steps.
PAIRS, RESTART, STEPS = 3, 0.3, 4
#: Polarities below this are left out.
LEAST = 0.3
THRESHOLD = 0.3
#: Entries of counts that a worker holds before it passes them on.
HELD = 200_000
#: Drops the shuffle files of a query as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = re.compile(r"[^\W\d_]+")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, of which no shuffle file is left."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return kept(df, name)
    finally:
        conf.set(CLEANUP, was)


def terms(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def sample(labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """Up to rows labels (doc_id, toxic) of rows that are not held out: all, or a share by a hash of the id."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("label"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    return written(known.filter(draw < share).limit(2 * rows), "labelled")


def counted(docs: DataFrame) -> DataFrame:
    """Of docs (text, toxic or null): term, uses, documents, toxic and clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in range(4)]

        def out() -> pa.RecordBatch:
            keys = list(held[0])
            cols = [pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in held]]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["term", "uses", "docs", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = terms(text)
                held[0].update(found)
                once = set(found)
                held[1].update(once)
                if toxic is not None:
                    held[2 if toxic else 3].update(once)
            if len(held[0]) > HELD:
                yield out()
        yield out()

    some = docs.select("text", "toxic").mapInArrow(run, "term string, uses long, docs long, toxic long, clean long")
    return some.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("uses", "docs", "toxic", "clean")])


def seeds(counts: DataFrame, toxic: int, clean: int) -> DataFrame:
    """The words of toxic documents, and of the other ones: term, bad and good, its log odds on its side or 0."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda x, n: F.when(x > 0, x * F.log(x / ((a + b) * n / (toxic + clean)))).otherwise(0.0)
    rest = lambda x, n: F.when(n - x > 0, (n - x) * F.log((n - x) / ((toxic + clean - a - b) * n / (toxic + clean)))).otherwise(0.0)
    ratio = 2 * (part(a, toxic) + part(b, clean) + rest(a, F.lit(toxic)) + rest(b, F.lit(clean)))
    sure = F.sqrt(F.greatest(ratio, F.lit(0.0))) * F.when(a * clean > b * toxic, 1).otherwise(-1)
    odds = F.abs(F.log((a + 0.5) / (toxic - a + 0.5)) - F.log((b + 0.5) / (clean - b + 0.5)))
    scored = counts.filter((F.col("toxic") > 0) | (F.col("clean") > 0)).select("term", sure.alias("sure"), odds.alias("odds"), (a / (a + b)).alias("share"))
    bad, good = (F.col("sure") >= SURE) & (F.col("share") >= MOSTLY), F.col("sure") <= -SURE
    of = lambda side: F.when(side, F.col("odds")).otherwise(0.0)
    return scored.filter(bad | good).select("term", of(bad).alias("bad"), of(good).alias("good"))


def hashed(term: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def nodes(counts: DataFrame, docs: int) -> DataFrame:
    """The words of the graph: h, term and uses."""
    return counts.filter((F.col("docs") >= FEW) & (F.col("docs") <= max(FEW, COMMON * docs))).select(F.xxhash64("term").alias("h"), "term", "uses")


def bitmap(of: DataFrame, bits: int = BITS) -> bytes:
    """One bit for each hash modulo bits."""
    at = F.pmod("h", F.lit(bits))
    words = of.groupBy(F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("w")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in words:
        out[r.i] = r.w
    return out.tobytes()


class Pairs:
    """Counts of pairs of words within SPAN of each other, of the texts since the last rows(). A pair is a number made of the
    places of its words in `hashes`; what is pending is sorted and merged into the counts now and then."""

    def __init__(self, rare: np.ndarray, common: frozenset[str], hubs: np.ndarray) -> None:
        self.rare, self.common, self.hubs = rare, common, hubs
        self.words: dict[str, int] = {}
        self.hashes: list[int] = []
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def place(self, word: str) -> int:
        i = self.words.get(word)
        if i is None:
            h = hashed(word)
            at = h % (len(self.rare) * 64)
            if word in self.common or not int(self.rare[at >> 6]) >> (at & 63) & 1:
                i = -1
            else:
                i = len(self.hashes)
                self.hashes.append(h)
            self.words[word] = i
        return i

    def add(self, text: str | None) -> None:
        at = np.fromiter(map(self.place, terms(text)), np.int64)
        for k in range(1, min(SPAN, len(at) - 1) + 1):
            both = (at[:-k] >= 0) & (at[k:] >= 0)
            u, v = at[:-k][both], at[k:][both]
            self.pending.append(np.minimum(u, v) << 32 | np.maximum(u, v))
            self.waiting += len(u)
        if self.waiting > 4 * HELD:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate([np.empty(0, np.int64), *self.pending]), return_counts=True)
        codes, n = np.concatenate([self.codes, new]), np.concatenate([self.n, n])
        self.pending, self.waiting = [], 0
        order = np.argsort(codes, kind="stable")  # two sorted runs, so a merge
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        self.codes, self.n = codes[first], np.add.reduceat(n, first) if len(first) else n

    def full(self) -> bool:
        return len(self.codes) > 20 * HELD or len(self.words) > 5 * HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The counts so far, by the hashes of their words, the lesser one first and once for all its pairs; then it starts anew.
        Of a hub, the pairs are parted by the first six bits of the other hash."""
        self.merge()
        h = np.array(self.hashes, np.int64)
        u, v = h[self.codes >> 32], h[self.codes & 0xFFFFFFFF]
        two = u != v
        a, b, n = np.minimum(u, v)[two], np.maximum(u, v)[two], self.n[two]
        at = a % (len(self.hubs) * 64)
        part = np.where(self.hubs[at >> 6] >> (at & 63) & 1, b >> 58, 0)
        order = np.lexsort((b, a))  # parts stand in order too
        a, part, b, n = a[order], part[order], b[order], n[order]
        for i in range(0, len(a), HELD):
            x, p, y, k = (z[i : i + HELD] for z in (a, part, b, n))
            first = np.concatenate([[0], np.flatnonzero((np.diff(x) != 0) | (np.diff(p) != 0)) + 1])
            to = np.append(first, len(x)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(to, z) for z in (y, k)]
            yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(p[first]), *lists], ["a", "part", "b", "n"])
        self.__init__(self.rare, self.common, self.hubs)


def pairs(docs: DataFrame, counts: DataFrame, n_docs: int, least: int = PAIRS) -> DataFrame:
    """How often words of the graph stand within SPAN of each other, if least times or more: a and b (hashes, a < b) and n."""
    common = frozenset(r.term for r in counts.filter((F.col("docs") > max(FEW, COMMON * n_docs))).select("term").collect())
    rare, hubs = bitmap(nodes(counts, n_docs)), bitmap(nodes(counts.filter(F.col("docs") > HUB), n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Pairs(np.frombuffer(rare, np.int64), common, np.frombuffer(hubs, np.int64))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.add(text)
            if held.full():
                yield from held.rows()
        yield from held.rows()

    found = docs.select("text").mapInArrow(run, "a long, part long, b array<long>, n array<long>").repartition("a", "part")
    single = found.select("a", "part", F.inline(F.arrays_zip("b", "n")))  # of a part, all rows of a pair are in one task
    return single.groupBy("a", "part", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("a", "b", "n")


def graph(found: DataFrame, of: DataFrame) -> DataFrame:
    """Edges u, v, w both ways, between any two words of nodes(); w is the positive pointwise mutual information as a share of all that leaves u."""
    uses = of.agg(F.sum("uses")).first()[0] or 1
    end = lambda x: of.select(F.col("h").alias(x), F.col("term").alias(f"term_{x}"), F.col("uses").cast("double").alias(f"uses_{x}"))
    named = found.join(end("a"), "a").join(end("b"), "b")
    ppmi = named.withColumn("w", F.log(F.col("n") * uses / (2 * SPAN * F.col("uses_a") * F.col("uses_b")))).filter("w > 0")
    way = lambda x, y: F.struct(F.col(x).alias("u"), F.col(y).alias("v"), "w")
    edges = written(ppmi.select(F.inline(F.array(way("term_a", "term_b"), way("term_b", "term_a")))), "ppmi")
    leaving = edges.groupBy("u").agg(F.sum("w").alias("all"))
    return written(edges.join(leaving, "u").select("u", "v", (F.col("w") / F.col("all")).alias("w")), "graph")


def walk(edges: DataFrame, of: DataFrame, steps: int = STEPS) -> DataFrame:
    """node, bad and good: its shares after walks that start at the seeds of a side and go back to them, as often as they weigh."""
    sums = of.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    at = of.select(F.col("term").alias("node"), *[(F.col(c) / (sums[c] or 1.0)).alias(c) for c in ("bad", "good")])
    home = at.select("node", *[(F.col(c) * RESTART).alias(c) for c in ("bad", "good")])
    for _ in range(steps):
        moved = at.join(edges, at.node == edges.u).select(F.col("v").alias("node"), *[(F.col(c) * F.col("w") * (1 - RESTART)).alias(c) for c in ("bad", "good")])
        at = written(moved.unionByName(home).groupBy("node").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "walk")
    return at


def polarities(edges: DataFrame, of: DataFrame) -> dict[str, float]:
    """Words and polarities from -1 to 1. Shares far below a seed's own count for little."""
    n = of.agg(F.count(F.when(F.col("bad") > 0, 1)).alias("bad"), F.count(F.when(F.col("good") > 0, 1)).alias("good")).first()
    least = RESTART / 2 / max(1, n.bad)
    scored = walk(edges, of).select("node", ((F.col("bad") - F.col("good")) / (F.col("bad") + F.col("good") + least)).alias("polarity"))
    return {r.node: r.polarity for r in scored.filter(F.abs("polarity") >= LEAST).collect()}


def figures(text: Column, lexicon: dict[str, float]) -> Column:
    """Struct of the sums of a text's positive and negative polarities (each word once) and of the largest."""

    @F.arrow_udf("struct<total: double, clean: double, top: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [sorted(lexicon[t] for t in lexicon.keys() & terms(x.as_py())) for x in texts]
            cols = [[float(sum(v for v in f if v > 0)) for f in found], [float(-sum(v for v in f if v < 0)) for f in found], [max([0.0, *f[-1:]]) for f in found]]
            yield pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in cols], ["total", "clean", "top"])

    return run(text)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve with a small ridge, by Newton's method; the last one is the offset. Row i counts n[i] times."""
    n = np.ones(len(x)) if n is None else n
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, total, clean and top."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = sample(labels)
    n = {r.toxic: r["count"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    cols = ["total", "clean", "top"]
    done = lambda df: df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *cols)
    nothing = rows.select("doc_id", *[F.lit(0.0).alias(c) for c in ("score", *cols)])
    if not n.get(0) or not n.get(1):
        return done(nothing)
    counts = written(counted(rows.join(F.broadcast(known), "doc_id", "left")), "counts")  # known is bounded by LABELLED
    of, n_docs = written(seeds(counts, n[1], n[0]), "seeds"), rows.count()
    if of.filter("bad > 0").isEmpty():
        return done(nothing)
    edges = graph(written(pairs(rows, counts, n_docs), "pairs"), nodes(counts, n_docs))
    found = written(rows.select("doc_id", figures(F.col("text"), polarities(edges, of)).alias("f")).select("doc_id", F.log1p("f.total").alias("total"), F.log1p("f.clean").alias("clean"), "f.top"), "figures")
    seen = np.array([tuple(r) for r in found.join(F.broadcast(known), "doc_id").groupBy(*cols, (F.col("toxic") > 0).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n")).collect()])
    if not len(seen):
        return done(nothing)
    w = fit(seen[:, :3], seen[:, 3], seen[:, 4])
    z = sum((float(x) * F.col(c) for x, c in zip(w, cols, strict=False)), F.lit(float(w[-1])))
    return done(found.withColumn("score", 1 / (1 + F.exp(-z))))
