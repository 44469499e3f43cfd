"""Full-text search as relations: an inverted index of (term, id, positions), queries as semi, anti and position joins,
BM25 from aggregates. Query texts are parsed on the driver into a plan; nothing of the index is."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import scratch

K1, B = 1.2, 0.75
#: Ids that are there more than once, up to which they are broadcast to find their texts; beyond, texts and ids meet by shuffle.
REPEATED = 200_000
WORD = re.compile(r"[^\W_]+")


def tokens(text: Column, kind: str = "unicode61") -> Column:
    """Arrays of tokens: runs of letters and digits in lower case, of ASCII ones, or all runs of three characters."""
    if kind == "trigram":
        return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))  # a look ahead takes nothing, so runs overlap
    pattern = "[a-z0-9]+" if kind == "ascii" else "[\\p{L}\\p{N}]+"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def index(docs: DataFrame, id_col: str, text_col: str, kind: str = "unicode61") -> DataFrame:
    """term, id, pos (from 0): one row for each token."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col), kind)).alias("pos", "term"))


def postings(idx: DataFrame) -> DataFrame:
    """term, id and the array of positions."""
    return idx.groupBy("term", "id").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def vocabulary(docs: DataFrame, id_col: str, text_col: str, kind: str = "unicode61") -> DataFrame:
    """term, docs (different ids that have it, null not counted) and uses. Each text adds its words up to counts by term before
    anything is shuffled, so a term is one row per task. Texts whose id is there more than once are found by their
    ids alone, and only for these are pairs of term and id gathered, to take off what was counted twice."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = tokens(F.col("text"), kind)
    one = F.col("id").isNotNull().cast("long")
    each = lambda xs, docs, uses: F.transform(xs, lambda t: F.struct(t.alias("term"), docs.alias("docs"), uses.alias("uses")))
    zero = F.lit(0).cast("long")
    both = rows.select(words.alias("words"), one.alias("one")).select(F.inline(F.concat(each(F.col("words"), zero, F.lit(1).cast("long")), each(F.array_distinct("words"), F.col("one"), zero))))
    path = scratch(docs.sparkSession, "repeated")
    rows.groupBy("id").count().filter("id IS NOT NULL AND count > 1").select("id").write.parquet(path)
    repeated = docs.sparkSession.read.schema(rows.select("id").schema).parquet(path)
    n = repeated.count()
    if n:
        again = rows.join(F.broadcast(repeated) if n <= REPEATED else repeated.hint("merge"), "id", "left_semi")
        twice = again.select("id", F.explode(F.array_distinct(words)).alias("term")).groupBy("term", "id").agg((1 - F.count(F.lit(1))).alias("docs"))
        both = both.unionByName(twice.select("term", "docs", zero.alias("uses")))
    return both.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


class Query:
    """term, term*, ^term, "a phrase", NEAR(a b, k), AND, OR, NOT and parentheses; terms side by side mean AND."""

    def __init__(self, text: str):
        self.tokens = re.findall(r'NEAR\([^)]*\)|"[^"]*"|\(|\)|\^?[\w]+\*?', text)
        self.at = 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise ValueError(f"cannot read {self.tokens[self.at]}")

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def either(self):
        left = self.both()
        while self.peek() == "OR":
            self.at += 1
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.one()
        while (t := self.peek()) not in (None, ")", "OR"):
            self.at += t in ("AND", "NOT")
            left = ("not" if t == "NOT" else "and", left, self.one())
        return left

    def one(self):
        t = self.peek()
        if t is None or t in (")", "AND", "OR", "NOT"):
            raise ValueError("a term is missing")
        self.at += 1
        if t == "(":
            inner = self.either()
            if self.peek() != ")":
                raise ValueError("a parenthesis is missing")
            self.at += 1
            return inner
        if t.startswith("NEAR("):
            words, _, k = t[5:-1].partition(",")
            return ("near", re.findall(r"\w+", words.lower()), int(k or 10))
        if t.startswith('"'):
            return ("phrase", re.findall(r"\w+", t.lower()))
        return ("initial", t[1:].lower()) if t.startswith("^") else ("prefix", t[:-1].lower()) if t.endswith("*") else ("term", t.lower())


def match(idx: DataFrame, text: str) -> DataFrame:
    """The ids of the documents that a query finds."""
    return _run(idx, Query(text).tree)


def _run(idx: DataFrame, tree: tuple) -> DataFrame:
    kind, *rest = tree
    of = lambda t: idx.filter(F.col("term") == t)
    if kind == "term":
        return of(rest[0]).select("id").distinct()
    if kind == "prefix":
        return idx.filter(F.col("term").startswith(rest[0])).select("id").distinct()
    if kind == "initial":
        return of(rest[0]).filter("pos = 0").select("id").distinct()
    if kind == "phrase":
        words = rest[0]
        # Each word votes for the place where the phrase would start; all votes there make a hit. No join of positions.
        votes = idx.filter(F.col("term").isin(*set(words))).select("id", "pos", F.explode(F.filter(F.array(*[F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(words)]), lambda x: x.isNotNull())).alias("i"))
        hits = votes.groupBy("id", (F.col("pos") - F.col("i")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        return hits.filter(F.col("n") == len(words)).select("id").distinct()
    if kind == "near":
        words, k = rest
        places = idx.filter(F.col("term").isin(*words)).groupBy("id").agg(*[F.collect_list(F.when(F.col("term") == w, F.col("pos"))).alias(f"p{i}") for i, w in enumerate(words)])
        first = F.exists("p0", lambda p: _all_near(p, words, k))
        return places.filter(first).select("id")
    a, b = (_run(idx, t) for t in rest)
    if kind == "or":
        return a.union(b).distinct()
    return a.join(b, "id", "left_semi" if kind == "and" else "left_anti")


def _all_near(p: Column, words: list[str], k: int) -> Column:
    out = F.lit(True)
    for i in range(1, len(words)):
        out = out & F.exists(f"p{i}", lambda q: F.abs(q - p) <= k + 1)
    return out


def bm25(idx: DataFrame, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """id and score of documents with any of the terms; negated, so that lower is better. Lengths and document counts are
    aggregates over the index; the few term statistics are joined by broadcast, as there is a row for each query term."""
    lengths = idx.groupBy("id").agg(F.count(F.lit(1)).alias("dl"))
    whole = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("dl").alias("avgdl"))
    tf = idx.filter(F.col("term").isin(*terms)).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(df.join(F.broadcast(whole)).select("term", "avgdl", F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(stats, "term").join(lengths, "id").groupBy("id").agg((-F.sum(part)).alias("score"))


def highlight(text: Column, terms: list[str], start: str, end: str) -> Column:
    words = "|".join(re.escape(t) for t in terms)
    return F.regexp_replace(text, f"(?iu)(?<![\\p{{L}}\\p{{N}}])({words})(?![\\p{{L}}\\p{{N}}])", f"{start}$1{end}")


def snippet(text: Column, terms: list[str], start: str, end: str, dots: str, n: int) -> Column:
    """The n tokens with the most hits, the first of them on ties. In Arrow batches: the sliding count over a text's
    tokens has no linear form in column expressions."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = WORD.findall(t or "")
            hits = [w.lower() in terms for w in words]
            count = best = sum(hits[:n])
            at = 0
            for i in range(1, len(words) - n + 1):
                count += hits[i + n - 1] - hits[i - 1]
                if count > best:
                    best, at = count, i
            body = " ".join(start + w + end if h else w for w, h in zip(words[at : at + n], hits[at : at + n], strict=True))
            out.append(dots * (at > 0) + body + dots * (at + n < len(words)))
        return pa.array(out, pa.string())

    return run(text)


def offsets(idx: DataFrame, terms: list[str]) -> DataFrame:
    """id and, for each hit, the term's number and its position."""
    number = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term")) - 1
    return idx.filter(F.col("term").isin(*terms)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(number.cast("int").alias("term"), "pos"))).alias("offsets"))
