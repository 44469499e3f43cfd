import hashlib
from collections import defaultdict

from siltstone.llm import line_dedup, queries


def brute(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and d != max(held[key(x)]))]
        out.append((d, len(ls), len(ls) - len(stay), "\n".join(stay)))
    return sorted(out)


LINE = "É A line of at least forty characters, it is"
ROWS = [(i, f"start {i}\n{' ' if i % 2 else ''}{LINE.upper() if i % 3 else LINE.lower()}\t\n\nshort\n") for i in range(7)]
ROWS += [(20 + i, "\n".join([f"own {i} {j} " + "z" * 40 for j in range(150)][: 140 + i] + [LINE.swapcase()] * 2 + ["x" * 39 + "É"])) for i in range(6)]
ROWS += [(40, None), (41, ""), (42, "\n\n"), (43, "x" * 39 + "É\nlast"), (44, "w " * 60_000)]


def test_small(spark):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in ROWS], "doc_id long, text string, pos int, keep string")
    for heavy in (line_dedup.HEAVY, 0, 6):  # all hashes streamed, none, some
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, heavy=heavy).collect())
        assert got == brute(ROWS)
    assert sum(r[2] > 0 for r in got) >= 9


def test_bitmaps(spark):
    keep = {r.doc_id: r.keep for r in line_dedup.bitmaps(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    assert [x.gap for x in keep[20]] == [2]
    assert 40 not in keep and 43 not in keep


def test_the_sorted_ranges_tell_first_occurrences(spark):
    """The plan: the window reads the sorted range exchange, with no other exchange or sort between them."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    at = line_dedup.long_lines(df)
    plan = line_dedup.streamed(at, 5)._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in ("Window", "Sort", "Exchange rangepartitioning") if x in plan]
    assert steps == ["Window", "Sort", "Exchange rangepartitioning"] and plan.index("Window") < plan.index("Sort") < plan.index("Exchange")
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1


def test_far_lines_and_whole_longs(spark):
    line = "a line of forty characters or more, to be sure"
    rows = [(i, "\n" * (5000 * i) + line + "\n" + "\n".join([line] * (70 * i))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect())
    assert got == brute(rows)
    assert max(len(r.keep) for r in line_dedup.bitmaps(df).collect()) <= 7


def test_ties_and_nulls(spark):
    rows = [(9, LINE + "\na")] * 3 + [(None, LINE + "\nb")] * 2 + [(1, LINE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.kept_text) for r in line_dedup.dedup_lines(df).collect()))
    assert got == [(0, "b"), (0, "b"), (1, "")] + [(9, LINE + "\na")] * 3
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_query(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = sorted(tuple(r) for r in queries.op5_line_dedup(spark, tables).collect())
    assert rows == [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(docs)]


def test_a_line_twice_in_a_document_counts_once(spark):
    line = "a line of forty characters or more, to be sure"
    rows = [(i, "\n".join([line] * 3)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy in (line_dedup.HEAVY, 0):
        assert {r.n_dropped for r in line_dedup.dedup_lines(df, heavy=heavy).collect()} == {0}
