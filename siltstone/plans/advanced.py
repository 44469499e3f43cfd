"""Queries over the composed operators: frames, joins by bins, recursion, sketches, spatial, series, own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import aggregates as A
from siltstone.operators import relational as R
from siltstone.operators import sketches as K
from siltstone.operators import spatial as G
from siltstone.plans.registry import query
from siltstone.sources.tables import table

c = F.col


@query("agg_total", "SELECT l_returnflag, coalesce(sum(CAST(l_linenumber AS DOUBLE)), 0.0) AS t, coalesce(sum(CASE WHEN l_quantity < 0 THEN 1.0::DOUBLE END), 0.0) AS none FROM lineitem GROUP BY l_returnflag")
def agg_total(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(A.total(c("l_linenumber")).alias("t"), A.total(F.when(c("l_quantity") < 0, 1)).alias("none"))


@query("agg_percentile_disc", "SELECT l_returnflag, CAST(quantile_disc(l_extendedprice, 0.9) AS DOUBLE) AS p FROM lineitem GROUP BY l_returnflag")
def agg_percentile_disc(spark: SparkSession, d: str) -> DataFrame:
    return A.percentile_disc(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "p")


@query("win_groups_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM part")
def win_groups_frame(spark: SparkSession, d: str) -> DataFrame:
    df = A.numbered_groups(table(spark, d, "part"), ["p_brand"], ["p_size"])
    return df.select("p_partkey", F.sum("p_size").over(A.groups_frame(["p_brand"], -1, 1)).alias("s"))


def _excluding(what: str):
    @query(f"win_exclude_{what.split()[0]}", f"SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what.upper()}) AS s FROM part")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return A.sum_excluding(table(spark, d, "part"), "p_size", ["p_brand"], ["p_size"], what, "s").select("p_partkey", "s")


for what in ("current row", "group", "ties"):
    _excluding(what)


@query("win_count_distinct", "SELECT event_id, count(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events")
def win_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.size(F.collect_set("event_type").over(w)).cast("long").alias("n"))


@query("compound_left_assoc", "SELECT k FROM (SELECT * FROM (SELECT n_regionkey AS k FROM nation UNION SELECT n_nationkey FROM nation) INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT r_regionkey FROM region")
def compound_left_assoc(spark: SparkSession, d: str) -> DataFrame:
    n, cu, r = (table(spark, d, t) for t in ("nation", "customer", "region"))
    return R.compound(n.select(c("n_regionkey").alias("k")), ("union", n.select("n_nationkey")), ("intersect", cu.select("c_nationkey")), ("except", r.select("r_regionkey")))


@query("cte_recursive_distinct", "WITH RECURSIVE r(n) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (n * 3) % 101 FROM r) SELECT n FROM r")
def cte_recursive_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.recursive(spark.range(1, 2).select(c("id").alias("n")), lambda df: df.select(((c("n") * 3) % 101).alias("n")))


@query("join_theta_range", "SELECT p_partkey, band FROM part JOIN (VALUES ('s', 1, 12), ('m', 10, 30), ('l', 25, 50)) AS b(band, lo, hi) ON p_size BETWEEN lo AND hi")
def join_theta_range(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("s", 1, 12), ("m", 10, 30), ("l", 25, 50)], "band string, lo int, hi int")
    return R.range_join(table(spark, d, "part"), bands, "p_size", "lo", "hi", 10).select("p_partkey", "band")


@query("join_leapfrog", "SELECT k, a.n * b.n * e.n AS multiplicity FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k) JOIN (SELECT n_nationkey AS k, count(*) AS n FROM nation GROUP BY 1) e USING (k)")
def join_leapfrog(spark: SparkSession, d: str) -> DataFrame:
    keys = [table(spark, d, t).select(c(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return R.multiway(*keys, on=["k"])


@query("join_as_of", "SELECT a.event_id, b.value AS last_purchase FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'view'")
def join_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return R.as_of_join(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query("generate_series", "SELECT n_nationkey, CAST(unnest(generate_series(n_nationkey, 30, 7)) AS BIGINT) AS v FROM nation")
def generate_series(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", F.explode(R.series(c("n_nationkey").cast("long"), F.lit(30).cast("long"), F.lit(7).cast("long"))).alias("v"))


BOXES = "SELECT vec_id, embedding[1] AS x0, embedding[1] + abs(embedding[3]) AS x1, embedding[2] AS y0, embedding[2] + abs(embedding[4]) AS y1 FROM embeddings"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    v = lambda i: F.get("embedding", F.lit(i))
    return table(spark, d, "embeddings").select("vec_id", v(0).alias("x0"), (v(0) + F.abs(v(2))).alias("x1"), v(1).alias("y0"), (v(1) + F.abs(v(3))).alias("y1"))


def box() -> list:
    return [(c("x0"), c("x1")), (c("y0"), c("y1"))]


@query("rtree_range", f"SELECT vec_id FROM ({BOXES}) WHERE x0 <= 0.1 AND x1 >= -0.1 AND y0 <= 0.2 AND y1 >= 0.0")
def rtree_range(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter(G.overlaps(box(), [(-0.1, 0.1), (0.0, 0.2)])).select("vec_id")


@query("rtree_within", f"SELECT vec_id FROM ({BOXES}) WHERE x0 >= -0.5 AND x1 <= 0.5 AND y0 >= -0.5 AND y1 <= 0.5")
def rtree_within(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter(G.within_box(box(), [(-0.5, 0.5), (-0.5, 0.5)])).select("vec_id")


@query("rtree_overlap_join", f"WITH b AS ({BOXES}) SELECT a.vec_id AS a, b.vec_id AS b FROM b a JOIN b ON a.vec_id < b.vec_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def rtree_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return R.overlap_pairs(boxes(spark, d), "vec_id", ("x0", "x1"), ("y0", "y1"))


@query("geopoly_area", f"SELECT vec_id, round(CAST(x1 - x0 AS DOUBLE) * CAST(y1 - y0 AS DOUBLE), 6) AS area, true AS inside FROM ({BOXES}) WHERE x1 > x0 AND y1 > y0")
def geopoly_area(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).filter("x1 > x0 AND y1 > y0")
    p = G.polygon((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    x, y = ((c(i) + c(j)) / 2 for i, j in (("x0", "x1"), ("y0", "y1")))
    return b.select("vec_id", F.round(G.area(p), 6).alias("area"), G.contains(p, x.cast("double"), y.cast("double")).alias("inside"))


@query("heavy_hitters", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return K.heavy_hitters(table(spark, d, "events"), "user_id", 10)


@query("ams_f2_exact", "SELECT CAST(sum(n * n) AS BIGINT) AS f2 FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def ams_f2_exact(spark: SparkSession, d: str) -> DataFrame:
    return K.second_moment(table(spark, d, "events"), "user_id")


@query("count_min")
def count_min(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return K.estimate(e.select("user_id").distinct(), "user_id", K.count_min(e, "user_id"))


@query("ams_f2_estimate")
def ams_f2_estimate(spark: SparkSession, d: str) -> DataFrame:
    return K.ams(table(spark, d, "events"), "user_id")


@query("sliding_hist", "SELECT time_bucket(INTERVAL '6 hours', ts) AS ws, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def sliding_hist(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours")["start"].alias("ws"), K.histogram(c("value"), 0.0, 100.0, 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("dp_noisy_count")
def dp_noisy_count(spark: SparkSession, d: str) -> DataFrame:
    epsilon = K.Budget(1.0).spend(0.5)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", K.laplace(c("n").cast("double"), 1.0, epsilon, 7).alias("noisy"))


@query("udf_scalar", "SELECT n_nationkey, reverse(n_name) AS r FROM nation")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.functions.registry import Functions

    f = Functions(spark)
    f.scalar("turned", 1, "string", lambda s: s[::-1])
    return table(spark, d, "nation").select("n_nationkey", f.call("turned", c("n_name")).alias("r"))


@query("udaf_grouped", "SELECT n_regionkey, CAST(count(*) AS DOUBLE) AS n FROM nation GROUP BY n_regionkey")
def udaf_grouped(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.functions.registry import Functions

    f = Functions(spark)
    f.aggregate("counted", 1, "double", lambda: 0, lambda s, v: s + 1, float)
    return table(spark, d, "nation").groupBy("n_regionkey").agg(f.call("counted", c("n_name")).alias("n"))


@query("udtf", "SELECT CAST(unnest(generate_series(3, 9, 2)) AS BIGINT) AS v")
def udtf(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.functions.registry import Functions

    f = Functions(spark)
    f.table("stepped", "v long", lambda a, b, s: range(a, b + 1, s))
    return spark.sql("SELECT v FROM stepped(3, 9, 2)")
