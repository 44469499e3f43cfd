"""Operators on small rows that the tables don't hold."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone.functions.registry import Functions, collation_key
from siltstone.operators import fulltext as T
from siltstone.operators import relational as R
from siltstone.operators import sketches as K
from siltstone.operators import spatial as G
from siltstone.plans import advanced, search
from siltstone.sources import store as S
from siltstone.sources import tables


def test_limits(spark):
    df = spark.range(5)
    assert R.limit(df, -1).count() == 5 and R.limit(df, 2, -3).count() == 2 and R.limit(df.orderBy("id"), 2, 4).count() == 1


def test_recursion_stops_at_what_it_has_seen(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a long, b long")
    seen = R.recursive(spark.createDataFrame([(1,)], "n long"), lambda df: df.join(edges, df.n == edges.a).select(F.col("b").alias("n")))
    assert sorted(r.n for r in seen.collect()) == [1, 2, 3]


def test_series(spark):
    got = spark.createDataFrame([(1, 5, 2), (5, 1, -2), (3, 1, 1)], "a long, b long, s long").select(R.series(F.col("a"), F.col("b"), F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [[1, 3, 5], [5, 3, 1], []]


@pytest.mark.parametrize("strips", [1, 4, 64])
def test_overlapping_boxes(spark, monkeypatch, strips):
    rnd, inf, nan = random.Random(5), math.inf, math.nan
    side = lambda: sorted(rnd.choice([rnd.random() * 9, float(rnd.randrange(9))]) for _ in range(2))
    rows = [(i % 190, *side(), *side()) for i in range(200)] + [(200 + i, 3.0, 4.0, 3.0, 4.0) for i in range(30)]
    rows += [(300, -inf, inf, 2.0, 1e12), (301, 1.0, nan, 0.0, -0.0), (302, nan, nan, 1.0, 9.0), (303, 5.0, 3.0, 0.0, 9.0), (304, None, 1.0, 0.0, 1.0), (None, 0.0, 9.0, 0.0, 9.0)]
    le = lambda p, q: math.isnan(q) or p <= q
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in a + b and a[0] < b[0] and le(a[1], b[2]) and le(b[1], a[2]) and le(a[3], b[4]) and le(b[3], a[4]))
    monkeypatch.setattr(R, "STRIPS", strips)
    monkeypatch.setattr(R, "REPLICA", 0)  # as many strips as there may be
    got = R.overlap_pairs(spark.createDataFrame(rows, "k long, x0 double, x1 double, y0 double, y1 double"), "k", ("x0", "x1"), ("y0", "y1"))
    assert sorted((r.a, r.b) for r in got.collect()) == want and len(want) > 2000


def test_equal_boxes_are_paired_in_many_tasks(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.1).cast("float")] * 4).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        each = [r["count"] for r in advanced.rtree_overlap_join(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(each) == 2000 * 1999 // 2 and max(each) < 0.5 * sum(each)


@pytest.mark.parametrize(("text", "want"), [("big AND cat", [1, 3]), ("cat NOT big", [2]), ('"big cat"', [1]), ("NEAR(big cat, 1)", [1, 3]), ("do*", [2]), ("^big", [1]), ("(dog OR big) cat", [1, 2, 3])])
def test_search(spark, text, want):
    idx = T.index(spark.createDataFrame([(1, "Big cat sat"), (2, "a dog, a CAT"), (3, "the cat is big")], "d long, t string"), "d", "t")
    assert sorted(r.id for r in T.match(idx, text).collect()) == want


@pytest.mark.parametrize("most", [200_000, 0])
def test_vocabulary(spark, monkeypatch, most):
    monkeypatch.setattr(T, "REPEATED", most)
    rows = [(1, "a b A"), (1, "b b c"), (2, "a"), (2, "a"), (3, None), (None, "a z"), (None, "a"), (4, "")]
    got = T.vocabulary(spark.createDataFrame(rows, "d long, t string"), "d", "t").collect()
    assert sorted((r.term, r.docs, r.uses) for r in got) == [("a", 2, 6), ("b", 1, 3), ("c", 1, 1), ("z", 0, 1)]


def test_postings_are_counted_before_they_are_shuffled(spark, tmp_path):
    """What is shuffled is terms per task: no row for each document and term."""
    text = F.concat_ws(" ", *[F.lit(w) for w in "the same few words in all of them".split()])
    spark.range(5000, numPartitions=2).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    df = search.fts_postings(spark, str(tmp_path))
    assert sorted((r.term, r.docs, r.uses) for r in df.collect()) == sorted((w, 5000, 5000) for w in "the same few words in all of them".split())
    plan = df._jdf.queryExecution().executedPlan()
    moved, todo = [], [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            moved.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert moved and sum(moved) < 100


def test_snippet_and_highlight(spark):
    df = spark.createDataFrame([("one two three Cat four five cat six",)], "t string")
    assert df.select(T.snippet(F.col("t"), ["cat"], "[", "]", "..", 4).alias("s")).first().s == "..[Cat] four five [cat].."
    assert df.select(T.highlight(F.col("t"), ["cat"], "<", ">").alias("s")).first().s == "one two three <Cat> four five <cat> six"


def test_polygons(spark):
    square = G.polygon(*[(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    inner = G.polygon(*[(F.lit(x), F.lit(y)) for x, y in ((1, 1), (1, 2), (2, 2), (2, 1))])
    row = spark.range(1).select(G.area(square).alias("a"), G.signed_area(inner).alias("s"), G.signed_area(G.ccw(inner)).alias("c"), G.within(inner, square).alias("w"), G.within(square, inner).alias("n"), G.overlap(inner, square).alias("o"), G.contains(square, F.lit(5.0), F.lit(1.0)).alias("out"), G.area(G.regular(F.lit(0.0), F.lit(0.0), F.lit(1.0), 4)).alias("r"), G.area(G.transformed(square, 2, 0, 0, 1, 5, 5)).alias("t")).first()
    assert (row.a, row.s, row.c, row.w, row.n, row.o, row.out, row.t) == (16.0, -1.0, 1.0, True, False, True, False, 32.0) and math.isclose(row.r, 2.0)


def test_sketches(spark):
    df = spark.createDataFrame([(i % 7,) for i in range(700)] + [(9,)] * 300, "x long")
    got = {r.x: r.estimate for r in K.estimate(df.select("x").distinct(), "x", K.count_min(df, "x")).collect()}
    assert all(got[i] >= 100 for i in range(7)) and got[9] >= 300 and sum(got.values()) < 1100
    exact = K.second_moment(df, "x").first().f2
    assert abs(K.ams(df, "x", 256).first().f2 / exact - 1) < 0.5
    assert K.heavy_hitters(df, "x", 1).first().x == 9
    assert abs(K.zipf_exponent(spark.createDataFrame([(1000 / (i + 1),) for i in range(50)], "n double"), "n") - 1) < 1e-6


def test_privacy_budget():
    b = K.Budget(1.0)
    b.spend(0.7)
    with pytest.raises(ValueError, match="spent"):
        b.spend(0.4)


def test_changesets(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    b = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k long, v string")
    c = spark.createDataFrame([(3, "x"), (4, "d")], "k long, v string")
    one, two = S.diff(a, b, ["k"]), S.diff(b, c, ["k"])
    assert {(r.k, r.op) for r in one.collect()} == {(1, "delete"), (2, "update"), (4, "insert")}
    assert {tuple(r) for r in S.apply(a, S.concat(one, two, ["k"]), ["k"], "abort")[0].collect()} == {(3, "x"), (4, "d")}
    other = spark.createDataFrame([(2, "other"), (4, "q")], "k long, v string")
    after, clash = S.apply(other, one, ["k"])
    assert {tuple(r) for r in after.collect()} == {(2, "other"), (4, "q")}
    assert {(r.k, r.clash) for r in clash.collect()} == {(1, "notfound"), (2, "data"), (4, "conflict")}
    assert {tuple(r) for r in S.apply(other, one, ["k"], "replace")[0].collect()} == {(2, "B"), (4, "d")}


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, p long")
    gone = spark.createDataFrame([(1,)], "k long")
    of = lambda action, **how: {tuple(r) for r in S.fk_delete(child, gone, "p", "k", action, **how).collect()}
    assert of("cascade") == {(2, 2), (3, None)} and of("set null") == {(1, None), (2, 2), (3, None)} and of("set default", default=2) == {(1, 2), (2, 2), (3, None)}
    with pytest.raises(S.ConstraintError):
        of("restrict")


def test_sqlite_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k long, s string, d double")
    assert tables.save_sqlite(df, str(tmp_path / "x.db"), "t") == 2
    assert tables.is_sqlite(str(tmp_path / "x.db"))
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("INSERT INTO t VALUES (3, 'c', 2)")
    back = tables.load_sqlite(spark, str(tmp_path / "x.db"), "t", str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a", 1.5), (2, None, None), (3, "c", 2.0)]
    tables.dump(df, "t", f"{tmp_path}/dump")
    assert "INSERT INTO \"t\" VALUES (1,'a',1.5);" in {r.value for r in spark.read.text(f"{tmp_path}/dump/part-*").collect()}


def test_own_functions(spark):
    f = Functions(spark)
    f.scalar("twice", 1, "long", lambda x: 2 * x)
    f.scalar("many", -1, "long", lambda *x: len(x))
    row = spark.range(3, 4).select(f.call("TWICE", F.col("id")).alias("a"), f.call("many", F.col("id"), F.col("id")).alias("b")).first()
    assert (row.a, row.b) == (6, 2)
    with pytest.raises(LookupError):
        f.call("none")
    key = collation_key(lambda s: s[::-1])
    assert [r.s for r in spark.createDataFrame([("ab",), ("ba",)], "s string").orderBy(key(F.col("s"))).collect()] == ["ba", "ab"]
