"""Raw text of the dialect through a Connection, against what it means in another engine's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans.registry import query
from siltstone.plans.sqlfront import Connection
from siltstone.sources.tables import scratch, table

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def connected(spark: SparkSession, d: str, *names: str) -> Connection:
    return Connection(spark, scratch(spark, "sql"), **{n: table(spark, d, n) for n in names})


def text(name: str, tables: str, sql: str, oracle: str) -> None:
    query(name, oracle)(lambda spark, d: connected(spark, d, *tables.split()).query(sql))


text("sql_integers", "orders", "SELECT o_orderkey, o_orderkey / 7 AS q, -o_orderkey / 7 AS neg, o_orderkey % 7 AS m, o_orderkey / 0 AS z, o_orderkey % 0 AS mz, 7 / 2 AS c, (o_orderkey << 2) | 1 AS b FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, -(o_orderkey // 7) AS neg, o_orderkey % 7 AS m, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS mz, 3 AS c, (o_orderkey * 4) | 1 AS b FROM orders")
text("int_div_big", "orders", "SELECT o_orderkey, (o_orderkey + 9007199254740993) / 1 AS a, (o_orderkey + 9007199254740993) / 3 AS b FROM orders", "SELECT o_orderkey, o_orderkey + 9007199254740993 AS a, (o_orderkey + 9007199254740993) // 3 AS b FROM orders")
text("add_int_stays_int", "orders", "SELECT o_orderkey, o_orderkey + 9007199254740992 + 1 AS s, typeof(o_orderkey + 1) AS t FROM orders", "SELECT o_orderkey, o_orderkey + 9007199254740993 AS s, 'integer' AS t FROM orders")
text("sql_casts", "customer", "SELECT c_custkey, CAST(c_custkey || 'abc' AS INTEGER) AS i, CAST('x' || c_name AS INTEGER) AS n, CAST(c_acctbal AS INTEGER) AS t, '3abc' + c_custkey AS s, CAST('2.5e1z' AS REAL) AS r, typeof(c_name) AS k FROM customer", "SELECT c_custkey, c_custkey AS i, 0 AS n, CAST(trunc(c_acctbal) AS BIGINT) AS t, 3 + c_custkey AS s, 25.0::DOUBLE AS r, 'text' AS k FROM customer")
text("sql_like", "customer", "SELECT c_custkey, c_name LIKE '%CUSTOMER%1_' AS a, c_mktsegment LIKE 'b%' AS b, c_mktsegment GLOB 'B*' AS g, c_name NOT LIKE '%#_%' ESCAPE '#' AS e, 'É' LIKE 'é' AS u FROM customer WHERE c_mktsegment LIKE '%u%' OR c_name LIKE '%9'", "SELECT c_custkey, lower(c_name) LIKE '%customer%1_' AS a, lower(c_mktsegment) LIKE 'b%' AS b, c_mktsegment LIKE 'B%' AS g, NOT contains(c_name, '_') AS e, false AS u FROM customer WHERE lower(c_mktsegment) LIKE '%u%' OR c_name LIKE '%9'")
text("sql_text", "customer", "SELECT c_custkey, substr(c_name, 0, 4) AS a, substr(c_name, -3) AS b, upper(substr(c_name, 1, 4)) || '-' || c_nationkey AS c, instr(c_name, '#') AS i, replace(c_name, 'Customer', 'C') AS r, printf('%05d|%s', c_custkey, c_mktsegment) AS p, iif(c_nationkey, 'some', 'none') AS f, max(c_nationkey, 10, NULL) AS m FROM customer", "SELECT c_custkey, left(c_name, 3) AS a, right(c_name, 3) AS b, upper(left(c_name, 4)) || '-' || c_nationkey AS c, CAST(instr(c_name, '#') AS INTEGER) AS i, replace(c_name, 'Customer', 'C') AS r, format('{:05d}|{}', c_custkey, c_mktsegment) AS p, CASE WHEN c_nationkey <> 0 THEN 'some' ELSE 'none' END AS f, CAST(NULL AS INTEGER) AS m FROM customer")
text("sql_dates", "orders", "SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS ym, date(o_orderdate, 'start of month', '+10 days') AS s, julianday(date(o_orderdate)) AS j, date(o_orderkey, 'unixepoch') AS u FROM orders WHERE o_orderdate >= '1995-01-01'", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, strftime(date_trunc('month', o_orderdate) + INTERVAL 10 DAY, '%Y-%m-%d') AS s, epoch(date_trunc('day', o_orderdate)) / 86400 + 2440587.5 AS j, strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d') AS u FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
text("sql_json", "events", "SELECT event_id, json_extract(props, '$.k') AS a, props ->> 'k' AS b, json_set('{}', '$.id', event_id) AS s, json_array(event_id, event_type, NULL) AS r, json_object('t', event_type) AS o FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b, '{\"id\":' || event_id || '}' AS s, '[' || event_id || ',\"' || event_type || '\",null]' AS r, '{\"t\":\"' || event_type || '\"}' AS o FROM events")
text("sql_aggregates", "orders", "SELECT o_orderpriority, sum(o_orderkey) / count(*) AS q, total(o_totalprice) AS t, count(*) FILTER (WHERE o_orderkey % 2) AS odd, group_concat(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS st FROM orders GROUP BY o_orderpriority HAVING count(*)", "SELECT o_orderpriority, CAST(sum(o_orderkey) AS BIGINT) // count(*) AS q, sum(o_totalprice) AS t, count(*) FILTER (WHERE o_orderkey % 2 <> 0) AS odd, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS st FROM orders GROUP BY o_orderpriority")
text("sql_windows_ctes", "orders customer", "WITH t(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY 1), u AS NOT MATERIALIZED (SELECT k, n, n / 2 AS h, row_number() OVER (PARTITION BY n ORDER BY k) AS r FROM t) SELECT u.k, u.h, u.r, c.c_name COLLATE NOCASE AS name FROM u JOIN customer AS c ON c.c_custkey == u.k WHERE u.r <= 20 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = u.k)", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT k, n, n // 2 AS h, row_number() OVER (PARTITION BY n ORDER BY k) AS r FROM t) SELECT u.k, u.h, u.r, " + LOW.format("c.c_name") + " AS name FROM u JOIN customer c ON c.c_custkey = u.k WHERE u.r <= 20")


@query("sql_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 2 * (c_custkey % 100) ELSE c_custkey % 100 END AS n FROM customer")
def sql_upsert(spark: SparkSession, d: str) -> DataFrame:
    db = connected(spark, d, "customer")
    db.execute("CREATE TABLE tally(id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO tally SELECT c_custkey, c_custkey % 100 FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 7 = 0")
    db.execute("INSERT INTO tally SELECT c_custkey, c_custkey % 100 FROM customer WHERE TRUE ON CONFLICT (id) DO UPDATE SET n = n + excluded.n WHERE tally.id % 3 = 0")
    return db.query("SELECT * FROM tally")


@query("sql_update_from", "SELECT c_custkey AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def sql_update_from(spark: SparkSession, d: str) -> DataFrame:
    db = connected(spark, d, "customer", "orders")
    db.execute("CREATE TABLE tally(id INTEGER PRIMARY KEY, n INTEGER)")
    db.execute("INSERT INTO tally SELECT c_custkey, 0 FROM customer")
    db.execute("CREATE VIEW per AS SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey")
    db.execute("UPDATE tally SET n = per.n FROM per WHERE tally.id = per.k")
    return db.query("SELECT * FROM tally")


@query("sql_savepoints", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0")
def sql_savepoints(spark: SparkSession, d: str) -> DataFrame:
    db = connected(spark, d, "customer")
    db.execute("CREATE TABLE ids AS SELECT c_custkey AS id FROM customer")
    for statement in ("BEGIN", "DELETE FROM ids WHERE id % 2", "SAVEPOINT half", "DELETE FROM ids", "ROLLBACK TO half", "COMMIT"):
        db.execute(statement)
    return db.query("SELECT * FROM ids")
