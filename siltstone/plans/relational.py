"""Queries over the relational core whose text is the same SQL in both engines, or nearly so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans.registry import query
from siltstone.sources.tables import TABLES, views


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose plan Catalyst makes from text; the oracle runs the same unless it has its own."""
    used = [t for t in TABLES if f" {t}" in " " + text.replace("\n", " ").replace("(", " ").replace(",", " ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *used)
        return spark.sql(text)

    query(name, oracle or text)(run)


# The flagship
sql(
    "q1_pricing",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)

# Scans and filters
sql("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45")
sql("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
sql("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
sql("filter_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('F', 'O') AND o_orderkey NOT BETWEEN 10 AND 20")
sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
sql("null_logic", "WITH c AS (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS v FROM customer) SELECT c_custkey, v IS NULL AS is_null, v IS NOT DISTINCT FROM NULL AS same, (v > 2) IS TRUE AS gt, coalesce(v, -1) AS filled, (v IN (1, 2)) AS inlist, v NOT IN (1, NULL) AS notin FROM c")
sql("row_value_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (50L, 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey < 50 OR (l_orderkey = 50 AND l_linenumber < 3)")
sql("values_inline", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
sql("select_no_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab, 7 % 3 AS rest")
sql("bitwise", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, ~p_size AS inv FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, ~p_size AS inv FROM part")
sql("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")

# Joins
sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 100000")
sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 150000 GROUP BY c.c_custkey")
sql("join_right", "SELECT n.n_name, s.s_name FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000")
sql("join_full", "SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural", "WITH a AS (SELECT n_nationkey AS k, n_name FROM nation), b AS (SELECT s_nationkey AS k, s_name FROM supplier) SELECT k, n_name, s_name FROM a NATURAL JOIN b")
sql("join_using", "WITH a AS (SELECT c_custkey AS k, c_name FROM customer), b AS (SELECT o_custkey AS k, o_orderkey FROM orders) SELECT k, c_name, o_orderkey FROM a JOIN b USING (k)")
sql("join_semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql("join_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
sql("join_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
sql("join_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier)")
sql("join_multiway_star", "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS lines FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY n.n_name")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_parenthesised", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c LEFT JOIN (orders o JOIN nation n ON n.n_nationkey = o.o_orderkey % 25) ON o.o_custkey = c.c_custkey")

# Aggregation
sql("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS d FROM lineitem")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, max(l_tax) AS hi FROM lineitem WHERE l_quantity < 0")
sql("agg_group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_having_no_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, sum(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS q FROM lineitem GROUP BY l_returnflag")
sql("agg_group_expr", "SELECT year(o_orderdate) AS y, o_orderkey % 7 AS b, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderkey % 7")
sql("agg_group_ordinal", "SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
sql("agg_group_concat_ordered", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_median", "SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_percentile", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.9), 4) AS p90, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 4) AS q1 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_quantity, 0.25), 4) AS q1 FROM lineitem GROUP BY l_returnflag")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("q6_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")

# Windows
sql("win_row_number", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
sql("win_rank_family", "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
sql("win_percent_cume", "SELECT p_partkey, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
sql("win_ntile", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS q FROM part")
sql("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2, -1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_first_last_nth", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM events")
sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM part")
sql("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS t, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 4) AS a, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders")
sql("win_filter", "SELECT event_id, count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS views FROM events", "SELECT event_id, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS views FROM events")
sql("win_group_concat", "SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') AS names FROM nation", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation")

# Sets, common tables, subqueries, order
sql("union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
sql("intersect_except_all", "(SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region) INTERSECT ALL SELECT n_regionkey FROM nation")
sql("cte_multi", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1), b AS (SELECT k, t FROM a WHERE t > 300000) SELECT c_name, round(b.t, 2) AS t FROM b JOIN customer ON c_custkey = b.k")
sql("cte_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
sql("subq_scalar_corr", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
sql("subq_scalar_limit", "SELECT (SELECT max(o_totalprice) FROM orders) AS top, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS first_nation")
sql("subq_derived", "SELECT b, count(*) AS n FROM (SELECT o_custkey % 10 AS b, o_totalprice AS p FROM orders) t WHERE p > 1000 GROUP BY b")
sql("order_nulls", "SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_nationkey, 7) ASC NULLS FIRST, c_custkey) AS a, row_number() OVER (ORDER BY nullif(c_nationkey, 7) DESC NULLS LAST, c_custkey) AS d FROM customer")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("view_nested", "SELECT r_name, n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) v JOIN region ON r_regionkey = v.n_regionkey")

# Batch twins of event windows
sql("event_tumbling", "SELECT window.start AS ws, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS ws, event_type, count(*) AS n FROM events GROUP BY 1, 2")