"""Statements on versioned tables; each query returns the state that they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.registry import query
from siltstone.sources import store as S
from siltstone.sources.tables import scratch, table

c = F.col
SEG = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
#: Of every 120 keys the table has the first 100 and the inserts those from 50 on, so both meet all over the table.
OLD, NEW = "c_custkey % 120 < 100", "c_custkey % 120 >= 50"


def made(spark: SparkSession, d: str, part: str = "true", **rules) -> S.Store:
    """A store with the customers, or a part of them, keyed."""
    store = S.Store(spark, scratch(spark, "store"))
    store.create("t", rows(spark, d).filter(part), key=["c_custkey"], **rules)
    return store


def kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a stored table, so that it is made whole whatever is read of it."""
    store = S.Store(spark, scratch(spark, "kept"))
    store.create("t", df)
    return store.read("t")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("dml_insert_select", SEG)
def dml_insert_select(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d, "c_mktsegment = 'BUILDING'")
    s.insert("t", rows(spark, d).filter("NOT c_mktsegment <=> 'BUILDING'"))
    return s.read("t")


@query("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    s.update("t", {"c_mktsegment": F.lit("DEBT")}, c("c_acctbal") < 0)
    return s.read("t")


@query("dml_update_from", "SELECT c_custkey, c_mktsegment, coalesce(t, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def dml_update_from(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    best = table(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    s.update_from("t", best, ["c_custkey"], {"c_acctbal": c("src.t")})
    return s.read("t")


@query("dml_delete", f"{SEG} WHERE NOT c_mktsegment = 'BUILDING'")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    s.delete("t", c("c_mktsegment") == "BUILDING")
    return s.read("t")


@query("dml_upsert", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 120 BETWEEN 50 AND 99 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d, OLD)
    s.insert("t", rows(spark, d).filter(NEW), "update", {"c_acctbal": c("excluded.c_acctbal") + 1})
    return s.read("t")


@query("dml_or_ignore", SEG)
def dml_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d, OLD)
    s.insert("t", rows(spark, d).filter(NEW).withColumn("c_acctbal", F.when(F.expr(OLD), 0.0).otherwise(c("c_acctbal"))), "ignore")
    return s.read("t")


@query("dml_or_replace", "SELECT c_custkey, CASE WHEN c_custkey % 120 >= 50 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def dml_or_replace(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d, OLD)
    s.insert("t", rows(spark, d).filter(NEW).withColumn("c_mktsegment", F.lit("NEW")), "replace")
    return s.read("t")


@query("dml_returning", f"{SEG} WHERE c_acctbal < 1000")
def dml_returning(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, made(spark, d).delete("t", c("c_acctbal") < 1000))


@query("generated_column", "SELECT c_custkey, c_mktsegment, c_acctbal, c_acctbal * 2 AS twice FROM customer")
def generated_column(spark: SparkSession, d: str) -> DataFrame:
    return made(spark, d, generated={"twice": "c_acctbal * 2"}).read("t")


@query("time_travel", SEG)
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    s.delete("t", c("c_mktsegment") == "BUILDING")
    s.update("t", {"c_acctbal": F.lit(0.0)}, F.lit(True))
    return s.read("t", version=1)


@query("transaction_rollback", SEG)
def transaction_rollback(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    t = s.transaction()
    s.delete("t", c("c_mktsegment") == "BUILDING")
    t.rollback()
    return s.read("t")


@query("alter_table", "SELECT c_custkey AS id, c_acctbal, 7 AS extra FROM customer")
def alter_table(spark: SparkSession, d: str) -> DataFrame:
    s = made(spark, d)
    s.alter("t", add={"extra": F.lit(7)}, drop=["c_mktsegment"], rename={"c_custkey": "id"})
    return s.read("t")


@query("fk_violations", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    return S.fk_violations(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


def _fk(action: str, sql: str) -> None:
    @query(f"fk_{action.replace(' ', '_')}", sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        gone = table(spark, d, "customer").filter("c_acctbal < 0")
        return S.fk_delete(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey", action)


_fk("cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
_fk("set null", "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders")


def changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = rows(spark, d).filter("c_custkey % 130 < 100")
    b = rows(spark, d).filter("c_custkey % 130 >= 20").withColumn("c_acctbal", F.when(c("c_custkey") % 7 == 0, 0.0).otherwise(c("c_acctbal")))
    return a, b


@query("changeset_diff", "SELECT c_custkey, CASE WHEN c_custkey % 130 < 20 THEN 'delete' WHEN c_custkey % 130 >= 100 THEN 'insert' ELSE 'update' END AS op FROM customer WHERE c_custkey % 130 < 20 OR c_custkey % 130 >= 100 OR (c_custkey % 7 = 0 AND c_acctbal <> 0)")
def changeset_diff(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, S.diff(*changed(spark, d), ["c_custkey"]).select("c_custkey", "op"))


@query("changeset_apply", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 130 >= 20")
def changeset_apply(spark: SparkSession, d: str) -> DataFrame:
    a, b = changed(spark, d)
    return kept(spark, S.apply(a, S.diff(a, b, ["c_custkey"]), ["c_custkey"], "abort")[0])


@query("changeset_invert", f"{SEG} WHERE c_custkey % 130 < 100")
def changeset_invert(spark: SparkSession, d: str) -> DataFrame:
    a, b = changed(spark, d)
    return kept(spark, S.apply(b, S.invert(S.diff(a, b, ["c_custkey"])), ["c_custkey"], "abort")[0])
