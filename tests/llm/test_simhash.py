import random

import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import queries, simhash


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(fps):
    """fps: list of (doc_id, fp)."""
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    distinct = sorted({f for _, f in fps})
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        least[find(f)] = min(d, least.get(find(f), d))
    return sorted((d, f, least[find(f)]) for d, f in fps)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "A b C d É Ü\x85x\x1cy", "a a a a a", "x " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(text) == brute(text)


def planted(rnd, n):
    out = []
    for _ in range(n):
        f = rnd.getrandbits(64)
        out.append(f)
        for _ in range(rnd.randrange(4)):
            for b in rnd.sample(range(64), rnd.randrange(1, 6)):
                f ^= 1 << b
            out.append(f)
    return out


@pytest.mark.parametrize("crowd", [2000, 0])
def test_links_and_components(spark, crowd):
    rnd = random.Random(3)
    fps = planted(rnd, 150) + [0, 1, 3, 7, (1 << 64) - 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, crowd=crowd).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in set(fps) for b in set(fps) if a != b and (a ^ b).bit_count() <= 3}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("crowd", [2000, 0])
def test_replicas_are_never_broadcast(spark, tmp_path, crowd):
    """Spark sizes what an explode gives as if it were one row for each, so a table of some MB passed for one to broadcast."""
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")), crowd=crowd)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    met = [line for line in joins if "Inner" in line]
    assert len(met) == (2 if crowd == 0 else 1) and all("SortMergeJoin" in line for line in met), joins


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (205, 200)]
    random.Random(0).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 205: 200}


def test_odd_rows(spark):
    rows = [(5, None, 1), (2, "", 2), (7, "a b c d", 3), (7, "a b c d", 3), (None, "x y z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(2, 2), (5, 2), (7, 7), (7, 7), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df).count() == 4


def test_a_star_of_many_leaves_has_no_hot_key(spark):
    """Its hub is broadcast: no join's key holds all the edges."""
    edges = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    got = simhash.components(edges)
    assert got.filter("root = 0").count() == 100_000 and got.count() == 100_000
    both = edges.selectExpr("b AS u", "a AS v").union(edges.selectExpr("a AS u", "b AS v"))
    assert simhash.star(both).filter("m = least(u, v)  OR u = 0").count() == 200_000


def test_one_id_on_two_texts(spark):
    a, b = " ".join(f"alpha{i} beta" for i in range(50)), " ".join(f"gamma{i} delta" for i in range(50))
    df = spark.createDataFrame([(1, b), (5, a), (5, b), (None, a), (7, None), (8, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str) == sorted([(1, b), (5, a), (7, None)], key=str)


def test_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op10_simhash(spark, tables).collect())
    assert got == brute_components([(r.doc_id, brute(r.text)) for r in docs])
    assert any(d != c for d, _, c in got)
