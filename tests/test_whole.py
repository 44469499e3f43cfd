"""Queries over whole tables and whole texts, at a larger size than the other queries are tested at."""

import os
import re
import string
from pathlib import Path

import duckdb
import pytest

from siltstone import plans
from siltstone.plans.registry import ORACLE, QUERIES
from tests.test_queries import plain

SF = "/root/testdata/sf0.01"
plans.load()
NAMES = ["dml_insert_select", "dml_update", "dml_update_from", "dml_delete", "dml_upsert", "dml_or_ignore", "dml_or_replace", "dml_returning", "generated_column", "time_travel", "transaction_rollback", "alter_table", "changeset_diff", "changeset_apply", "changeset_invert", "join_using", "join_parenthesised", "order_nulls", "compound_left_assoc"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_whole_table(spark, oracle, name):
    def wanted(sql):
        found = oracle.execute(sql)
        cols = [c[0] for c in found.description]
        return sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in found.fetchall()), key=repr)

    df = QUERIES[name](spark, SF)
    assert sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == wanted(ORACLE[name])


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    marked = {r.doc_id: r.h for r in QUERIES["fts_highlight"](spark, SF).collect()}
    word = re.compile(r"(?<![^\W_])(the|und)(?![^\W_])", re.IGNORECASE)
    assert marked == {d: t if t is None else word.sub(r"<b>\1</b>", t) for d, t in texts.items()}
    assert any("<b>" in h[400:] for h in marked.values() if h)
    keys = {r.doc_id: (r.same, r.k) for r in QUERIES["collate_nocase"](spark, SF).collect()}
    low = lambda t: t.translate(LOWER)
    assert keys == {d: (None, None) if t is None else (low(t) == low(t.upper()), low(t)) for d, t in texts.items()}
