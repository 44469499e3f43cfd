import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, queries


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    return sorted((d, max(groups[low(t)]), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t in rows)


ROWS = [(1, "Ab"), (9, "aB"), (4, None), (5, ""), (7, "É"), (8, "é"), (3, "ab "), (2, "K"), (6, "k"), (10, "x" * 200_000), (11, "X" * 200_000), (12, "K")]


def got(df, **more):
    out = exact_dedup.duplicates(df, **more).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")), exact_dedup.kept()).collect()
    return sorted((tuple(r)[:4] for r in out), key=str if None in {r.doc_id for r in out} else None), [r.doc_id for r in out if r[4]]


def test_small(spark):
    df = spark.createDataFrame([(d, t, "no", "x") for d, t in ROWS], "doc_id long, text string, digest string, locator string")
    rows, stay = got(df)
    assert rows == brute(ROWS)
    assert sorted(stay) == sorted({r[1] for r in rows})
    assert sorted(r.doc_id for r in exact_dedup.keep_last(df).collect()) == sorted(stay)
    assert exact_dedup.keep_last(df).columns == df.columns


def test_state_lasts_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(d, t) for d, t in ROWS], "doc_id long, text string").repartition(6, "doc_id")
    df.write.parquet(str(tmp_path / "d"))
    assert got(spark.read.parquet(str(tmp_path / "d")), batch=1)[0] == brute(ROWS)


def test_digest_alone_decides_nothing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows, stay = got(df, digest=lambda t: F.substring(t.cast("binary"), 1, 0))
    assert [r[:3] for r in rows] == [r[:3] for r in brute(ROWS)]
    assert sorted(stay) == sorted({r[1] for r in rows})


@pytest.mark.parametrize("rows", [[(1, "a"), (1, "a"), (None, "a"), (None, None)], []])
def test_ties_and_nulls(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_, stay = got(df)
    assert len(all_) == len(rows)
    assert sorted(stay, key=str) == ([1, None] if rows else [])
    assert exact_dedup.keep_last(df).count() == len(stay)


def test_query(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = queries.op3_exact_dedup(spark, tables).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == brute(docs)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_a_column_named_like_the_scan_s_own(spark, tmp_path):
    rows = [(1, "A", 1), (2, "a", 2), (3, "b", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _metadata int")
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.duplicates(docs).collect()) == [(1, 2), (2, 2), (3, 3)]
        assert sorted(tuple(r) for r in exact_dedup.keep_last(docs).collect()) == rows[1:]
