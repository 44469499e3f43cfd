"""Personal data by patterns and bootstrapped contexts, with DataFrame functions alone.

Base spans are matches of four expressions that pass a check (parts of an address, Luhn's sum, number of digits). They are
the seeds. Every seed and every other identifier-like token is a mention with a context, the words before it; contexts
and values form a graph. In each round a context's confidence is the mean confidence of its values (less one for
doubt), a value's is that of its best context that has enough different values of high confidence, seeds or found in
earlier rounds; after ROUNDS, values that a
high-confidence context holds, and that have the form of the kind, are personal data wherever they occur. Base spans
always stay, and what overlaps them is dropped.

The expressions are written so that they find what the plain ones find but neither backtrack nor recurse over long runs.
Texts are scanned once; what goes on from there is mentions only. A frequent context or value is one row per task before
the shuffle, and one row of the graph after it.

Defined cases: a null text counts as empty; texts are read whole; offsets are code points; rows are known by doc_id and
text, so identical rows get identical results; empty tables give empty tables; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import parted, small, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What may be an identifier: something with an @, or digits with at most two separators between them.
OTHER = "(?:\\G|(?<![^\\s\"'(<=:#]))(?:[^\\s@\"'<>,;=:#]++@[^\\s@\"'<>,;]++|[(+]{0,2}[0-9](?:[ ().:-]{0,2}[0-9])++)"
#: Different seeds that a context needs, the confidence that it needs, and rounds over the graph.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.6, 3
HEAVY = 1000
#: Characters before a mention that its context is taken from.
REACH = 64
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
MENTION = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches as structs of start, end and value; the stretches between them give the places."""
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, v: F.struct(F.length(gap).alias("gap"), F.length(v).alias("size"), v.alias("value")))
    found = F.filter(both, lambda x: x["value"].isNotNull())  # after the last match there is one more stretch
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(MENTION).alias("out"))
    start = lambda s, x: s["at"] + x["gap"]
    step = lambda s, x: F.struct((start(s, x) + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(start(s, x).alias("start"), (start(s, x) + x["size"]).alias("end"), x["value"].alias("value")))).alias("out"))
    return F.aggregate(found, zero, step, lambda s: s["out"])


def luhn(value: Column) -> Column:
    back = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike("^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\\.|$)){4}$")
    if kind == "card":
        return F.when(digits(value).between(13, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return digits(value).between(9, 15)
    return F.lit(True)


def may_have(kind: str, text: Column) -> Column:
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def base(text: Column) -> Column:
    """The base spans: structs of kind (its number), start, end and value, by kind and start."""
    return F.concat(*[of_kind(k, text) for k in range(len(KINDS))])


def of_kind(k: int, text: Column) -> Column:
    found = F.filter(matches(text, PATTERNS[KINDS[k]]), lambda x: valid(KINDS[k], x["value"]))
    spans = F.transform(found, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(may_have(KINDS[k], text), spans).otherwise(F.array().cast(SPAN))


def count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")


def apart(x: Column, spans: Column) -> Column:
    return ~F.exists(spans, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))


def placed(text: Column, found: Column) -> Column:
    """Spans, each with the text before it."""
    left = lambda x: F.substring(text, F.greatest(x["start"] - REACH, F.lit(0)) + 1, F.least(x["start"], F.lit(REACH)))
    return F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), left(x).alias("left")))


def others(text: Column) -> Column:
    """Identifier-like tokens, as spans of kind -1."""
    found = F.transform(matches(text, OTHER), lambda x: F.struct(F.lit(-1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_id and mentions, the base spans and then the other tokens that overlap none of them. The
    one pass over the texts ends in a table without them; what compares spans reads that table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_id"), text.alias("text"))
    found = rows.select("doc_id", "text_id", placed(F.col("text"), base(F.col("text"))).alias("base"), placed(F.col("text"), others(F.col("text"))).alias("other"))
    found = written(found, "mentions")
    return found.select("doc_id", "text_id", F.concat("base", F.filter("other", lambda x: apart(x, F.col("base")))).alias("mentions"))


def formed(kind: Column, value: Column) -> Column:
    """Whether a value has the form of a kind, more loosely than the base expressions."""
    many = digits(value)
    return F.when(kind == 0, value.contains("@")).when(kind == 1, value.rlike("^[0-9]+(?:[.:-][0-9]+){3,7}$")).when(kind == 2, many.between(12, 19)).otherwise(many.between(6, 15))


def contexts(left: Column) -> Column:
    """The patterns before a mention: its two words, and the last one alone if it announces a value."""
    words = F.split(F.rtrim(F.regexp_replace(F.lower(left), "[0-9]", "0")), "[ \\t\\n\\x0B\\f\\r]+", -1)
    last, two = F.element_at(words, -1), F.array_join(F.slice(words, -2, 2), " ")
    found = F.array(F.when(F.size(words) > 2, two), F.when(last.rlike("[:=#]['\"(]*$") & (F.length(last) > 2), last))
    return F.filter(found, lambda x: x.isNotNull())


def discovered(scan: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """The values that contexts vouch for: value, kind and confidence."""
    each = scan.select(F.explode("mentions").alias("m")).select("m.kind", F.lower("m.value").alias("value"), F.explode(contexts(F.col("m.left"))).alias("context"))
    edges = written(each.groupBy("context", "value").agg(F.max("kind").alias("kind")), "edges")
    sure = edges.filter("kind >= 0").groupBy("value").agg(F.max("kind").alias("kind")).select("value", "kind", F.lit(1.0).alias("confidence"), F.lit(True).alias("seed"))
    if sure.isEmpty():
        return sure.drop("seed")
    links, known, total = edges.select("context", "value"), sure, edges.count()
    for _ in range(rounds):
        of = links.join(known, "value", "left")
        size = of.groupBy("context").agg(F.count(F.lit(1)).alias("n"))
        per = of.filter(F.col("kind").isNotNull()).groupBy("context", "kind").agg(F.sum("confidence").alias("sum"), F.count(F.when(F.col("confidence") >= confidence, 1)).alias("seeds"))
        per = per.filter(F.col("seeds") >= support).join(size, "context").withColumn("confidence", F.col("sum") / (F.col("n") + 1))
        best = per.filter(F.col("confidence") >= confidence).groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("b"), F.max("n").alias("n")).select("context", "b.confidence", "b.kind", "n")
        best = written(best, "best")
        # A context of more than a thousandth of all links is a hot key; there are a thousand at most, so they are broadcast.
        hot, of = F.broadcast(best.filter(F.col("n") * HEAVY > total).drop("n")), best.drop("n")
        found = links.join(hot, "context").unionByName(links.join(hot.select("context"), "context", "left_anti").join(of, "context")).filter(formed(F.col("kind"), F.col("value"))).groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        new = found.join(sure, "value", "left_anti").select("value", "b.kind", "b.confidence", F.lit(False).alias("seed"))
        known = written(sure.unionByName(new), "known")
    return known.filter("not seed").drop("seed")


def spans_of(scan: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, text_id, base and spans (base and discovered), structs of kind, start and end by kind and start."""
    plain = lambda xs: F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = scan.select("doc_id", "text_id", plain(F.filter("mentions", lambda x: x["kind"] >= 0)).alias("base"), "mentions")
    found = written(discovered(scan, **how), "discovered")
    if found.isEmpty():
        return rows.select("doc_id", "text_id", "base", F.col("base").alias("spans"))
    open_ = scan.select("doc_id", "text_id", F.explode(F.filter("mentions", lambda x: x["kind"] < 0)).alias("m"))
    more = open_.withColumn("value", F.lower("m.value")).join(small(found), "value")
    more = more.groupBy(F.col("doc_id").alias("id"), F.col("text_id").alias("of")).agg(F.collect_set(F.struct("kind", F.col("m.start").alias("start"), F.col("m.end").alias("end"))).alias("more"))
    both = rows.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left")
    return both.select("doc_id", "text_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: doc_id, text_id, base and spans."""
    return spans_of(scanned(docs, id_col, text_col), **how)


def listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with [KIND] for its spans; of spans that overlap, the first one names the whole."""
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    gap = lambda s, x: F.when(x["start"] >= s["at"], F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(name, x["kind"]))).otherwise("")
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap(s, x)).alias("out"))
    return F.aggregate(order, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in text; null texts stay null. Only rows with spans are looked up."""
    spans = find(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias("id"), F.col("text_id").alias("of"), "spans").distinct()
    spans = written(spans.withColumn("h", F.xxhash64("id", "of")), "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_id"))
    maybe, rest = parted(rows.withColumn("h", F.xxhash64("row.doc_id", "text_id")), spans)
    both = maybe.join(spans.drop("h").hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_id") == F.col("of")), "left")
    both = both.unionByName(rest, allowMissingColumns=True)
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(masked(F.col("row.text"), F.col("spans")))
    return both.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
