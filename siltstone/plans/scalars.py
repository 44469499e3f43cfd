"""Queries over the scalar functions: text, numbers, dates, collations, JSON, exact decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import dates as D
from siltstone.functions import dialect as X
from siltstone.functions import json as J
from siltstone.plans.registry import query
from siltstone.sources.tables import table

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def of(name: str, source: str, key: str, sql: str | None, cols: Callable[[], dict]) -> None:
    """A projection of the key and the columns over a table; columns are made when there is a session."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[c.alias(n) for n, c in cols().items()])


c = F.col
of("filter_like_nocase", "part", "p_partkey", "SELECT p_partkey, p_name ILIKE '%1%' AS a, p_type ILIKE 's%l' AS b, p_name ILIKE 'PART_1%' AS c FROM part", lambda: dict(a=X.like(c("p_name"), "%1%"), b=X.like(c("p_type"), "S%L"), c=X.like(c("p_name"), "part_1%")))
of("filter_glob", "part", "p_partkey", "SELECT p_partkey, p_name GLOB '*[0-4]' AS a, regexp_matches(p_name, '^.*[^0-4]$') AS b, p_brand GLOB 'Brand?*' AS c FROM part", lambda: dict(a=X.glob(c("p_name"), "*[0-4]"), b=X.glob(c("p_name"), "*[^0-4]"), c=X.glob(c("p_brand"), "Brand?*")))
of("int_div_mod", "lineitem", "l_orderkey", "SELECT l_orderkey, l_orderkey // nullif(l_linenumber - 3, 0) AS q, l_orderkey % nullif(l_linenumber - 3, 0) AS r, CAST(trunc(-l_orderkey / 7.0) AS BIGINT) AS n FROM lineitem", lambda: dict(q=X.int_div(c("l_orderkey"), c("l_linenumber") - 3), r=X.mod(c("l_orderkey"), c("l_linenumber") - 3), n=X.int_div(-c("l_orderkey"), F.lit(7))))
of("overflow_to_real", "orders", "o_orderkey", "SELECT o_orderkey, CAST(9223372036854775807 AS DOUBLE) + o_orderkey AS s FROM orders", lambda: dict(s=X.add(F.lit(9223372036854775807), c("o_orderkey"))))
of("shifts", "part", "p_partkey", "SELECT p_partkey, CAST(p_size AS BIGINT) << 3 AS l, CAST(p_size AS BIGINT) >> 2 AS r, CAST(p_size AS BIGINT) >> 1 AS n FROM part", lambda: dict(l=X.shift_left(c("p_size"), F.lit(3)), r=X.shift_right(c("p_size"), F.lit(2)), n=X.shift_left(c("p_size"), F.lit(-1))))
of("cast_prefix", "events", "event_id", "SELECT event_id, CAST(regexp_extract(event_id || 'abc', '^[0-9]+') AS BIGINT) AS i, CAST(regexp_extract('-' || event_id || '.5e1x', '^-[0-9]+[.]5e1') AS DOUBLE) AS d, 0 AS z FROM events", lambda: dict(i=X.cast_integer(F.concat(c("event_id").cast("string"), F.lit("abc"))), d=X.cast_real(F.concat(F.lit("-"), c("event_id").cast("string"), F.lit(".5e1x"))), z=X.cast_integer(c("event_type")).cast("int")))
of("text_basic", "customer", "c_custkey", f"SELECT c_custkey, {LOW.format('c_name')} AS lo, length(c_name) AS n, instr(c_name, '0') AS i, replace(c_name, '0', 'oo') AS r, trim('  ' || c_name || ' ') AS t, ltrim(c_name, 'C') AS lt, rtrim(c_name, '0123456789') AS rt, concat(c_name, NULL, '!') AS ct, concat_ws('-', c_name, NULL, c_mktsegment) AS ws FROM customer", lambda: dict(lo=X.lower(c("c_name")), n=F.length("c_name"), i=X.instr(c("c_name"), "0"), r=X.replace(c("c_name"), "0", "oo"), t=X.trim(F.concat(F.lit("  "), c("c_name"), F.lit(" "))), lt=X.ltrim(c("c_name"), "C"), rt=X.rtrim(c("c_name"), "0123456789"), ct=X.concat(c("c_name"), F.lit(None), F.lit("!")), ws=X.concat_ws("-", c("c_name"), F.lit(None), c("c_mktsegment"))))
of("text_substr_quirks", "nation", "n_nationkey", "SELECT n_nationkey, substr(n_name, 2, 3) AS a, right(n_name, 3) AS b, substr(n_name, 1, 1) AS z, substr(n_name, 2, 2) AS back, substr(n_name, 3) AS tail FROM nation", lambda: dict(a=X.substr(c("n_name"), 2, 3), b=X.substr(c("n_name"), -3), z=X.substr(c("n_name"), 0, 2), back=X.substr(c("n_name"), 4, -2), tail=X.substr(c("n_name"), 3)))
of("text_pad_format", "orders", "o_orderkey", "SELECT o_orderkey, printf('%08d|%s|%.2f|%x', o_orderkey, o_orderstatus, o_totalprice, o_orderkey) AS f, '''' || replace(o_orderpriority, '''', '''''') || '''' AS q FROM orders", lambda: dict(f=X.format_("%08d|%s|%.2f|%x", c("o_orderkey"), c("o_orderstatus"), c("o_totalprice"), c("o_orderkey")), q=X.format_("%Q", c("o_orderpriority"))))
of("text_hex_quote", "nation", "n_nationkey", "SELECT n_nationkey, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS hn, '''' || replace(n_name, '''', '''''') || '''' AS q, octet_length(encode(n_name)) AS o, unicode(n_name) AS u, n_name AS back FROM nation", lambda: dict(h=X.hex_(c("n_name")), hn=X.hex_(c("n_nationkey")), q=X.quote(c("n_name")), o=X.octet_length(c("n_name")).cast("long"), u=X.unicode_(c("n_name")), back=X.unhex(X.hex_(c("n_name"))).cast("string")))
of("math_trig", "part", "p_partkey", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS co, round(atan2(p_size, 3), 9) AS a2, CASE WHEN p_size / 25.0 <= 1 THEN round(acos(p_size / 25.0), 9) END AS ac, round(degrees(p_size), 9) AS de, round(tanh(p_size / 10.0), 9) AS th, round(asinh(p_size), 9) AS ah FROM part", lambda: dict(s=F.round(X.math("sin", c("p_size")), 9), co=F.round(X.math("cos", c("p_size")), 9), a2=F.round(X.math("atan2", c("p_size"), F.lit(3)), 9), ac=F.round(X.math("acos", c("p_size") / 25.0), 9), de=F.round(X.math("degrees", c("p_size")), 9), th=F.round(X.math("tanh", c("p_size") / 10.0), 9), ah=F.round(X.math("asinh", c("p_size")), 9)))
of("math_log_pow", "part", "p_partkey", "SELECT p_partkey, round(ln(p_retailprice), 9) AS n, round(log10(p_retailprice), 9) AS t, round(log2(p_retailprice), 9) AS w, round(ln(p_size) / ln(3), 9) AS b, CASE WHEN p_size >= 25 THEN round(sqrt(p_size - 25), 9) END AS q, round(pow(p_size, 0.5), 9) AS p, round(exp(p_size / 10.0), 6) AS e, round(fmod(p_retailprice, 7), 6) AS m FROM part", lambda: dict(n=F.round(X.math("ln", c("p_retailprice")), 9), t=F.round(X.log(c("p_retailprice")), 9), w=F.round(X.math("log2", c("p_retailprice")), 9), b=F.round(X.log(c("p_size"), F.lit(3)), 9), q=F.round(X.math("sqrt", c("p_size") - 25), 9), p=F.round(X.math("pow", c("p_size"), F.lit(0.5)), 9), e=F.round(X.math("exp", c("p_size") / 10.0), 6), m=F.round(X.fmod(c("p_retailprice"), F.lit(7)), 6)))
of("math_round_sign", "customer", "c_custkey", "SELECT c_custkey, round(c_acctbal, 1) AS r, CAST(sign(c_acctbal) AS INTEGER) AS s, abs(c_acctbal) AS a, trunc(c_acctbal) AS t, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl FROM customer", lambda: dict(r=X.round_(c("c_acctbal"), 1), s=X.sign(c("c_acctbal")), a=F.abs("c_acctbal"), t=X.trunc(c("c_acctbal")), ce=F.ceil("c_acctbal"), fl=F.floor("c_acctbal")))
of("cond_iif_coalesce", "customer", "c_custkey", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS i, coalesce(nullif(c_nationkey, 3), -1) AS n, ifnull(nullif(c_mktsegment, 'BUILDING'), '?') AS f, CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 'null' ELSE 'integer' END AS t FROM customer", lambda: dict(i=X.iif(c("c_acctbal") > 0, "pos", "neg"), n=F.coalesce(F.nullif(c("c_nationkey"), F.lit(3)), F.lit(-1)), f=F.ifnull(F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.lit("?")), t=X.typeof(F.nullif(c("c_nationkey"), F.lit(3)), "int")))
of("scalar_minmax_null", "customer", "c_custkey", "SELECT c_custkey, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN greatest(c_nationkey, 10) END AS hi, CASE WHEN nullif(c_nationkey, 3) IS NOT NULL THEN least(c_nationkey, 10) END AS lo FROM customer", lambda: dict(hi=X.scalar_max(F.nullif(c("c_nationkey"), F.lit(3)), F.lit(10)), lo=X.scalar_min(F.nullif(c("c_nationkey"), F.lit(3)), F.lit(10))))
of("collate_nocase", "documents", "doc_id", None, lambda: dict(same=X.nocase(c("text")) == X.nocase(F.upper("text")), k=X.nocase(c("text"))))
of("collate_rtrim", "nation", "n_nationkey", "SELECT n_nationkey, true AS same, rtrim(n_name || '  ') AS k FROM nation", lambda: dict(same=X.rtrim_key(F.concat(c("n_name"), F.lit("  "))) == X.rtrim_key(c("n_name")), k=X.rtrim_key(F.concat(c("n_name"), F.lit("  ")))))
of("date_parts", "orders", "o_orderkey", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt FROM orders", lambda: dict(d=D.date(c("o_orderdate")), t=D.time(c("o_orderdate")), dt=D.datetime(c("o_orderdate"))))
of("date_modifiers", "orders", "o_orderkey", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS sunday FROM orders", lambda: dict(a=D.date(c("o_orderdate"), "start of month", "+10 days"), b=D.datetime(c("o_orderdate"), "-36 hours"), y=D.date(c("o_orderdate"), "start of year"), sunday=D.date(c("o_orderdate"), "weekday 0")))
of("date_month_overflow", "orders", "o_orderkey", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS m, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 YEAR + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS y FROM orders", lambda: dict(m=D.date(c("o_orderdate"), "+1 month"), y=D.date(c("o_orderdate"), "+1 year")))
of("date_julian_epoch", "events", "event_id", "SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 6) AS j, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS u, round(epoch_us(ts) / 1000000.0, 6) AS us FROM events", lambda: dict(j=F.round(D.julianday(c("ts")), 6), u=D.unixepoch(c("ts")), us=F.round(D.unixepoch(c("ts"), "subsec"), 6)))
of("strftime_codes", "events", "event_id", "SELECT event_id, strftime(ts, '%d %H %I %j %m %M %p %S %u %w %W %Y %G %V %%') AS s FROM events", lambda: dict(s=D.strftime("%d %H %I %j %m %M %p %S %u %w %W %Y %G %V %%", c("ts"))))
of("date_parse", "events", "event_id", "SELECT event_id, ts AS full, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, CAST(NULL AS TIMESTAMP) AS bad FROM events", lambda: dict(full=D.parse(c("ts").cast("string")), day=D.parse(c("ts").cast("date").cast("string")), bad=D.parse(F.concat(c("event_type"), F.lit("-13-45")))))
of("decimal_exact", "orders", "o_orderkey", "SELECT o_orderkey, rtrim(rtrim(CAST(CAST(round(o_totalprice, 2) AS DECIMAL(38,2)) + 0.10 AS VARCHAR), '0'), '.') AS a, CAST(sign(o_orderkey - 500) AS INTEGER) AS c FROM orders", lambda: dict(a=X.decimal_op("add", F.round("o_totalprice", 2).cast("decimal(38,2)").cast("string"), F.lit("0.10")), c=X.decimal_op("cmp", c("o_orderkey").cast("string"), F.lit("500"))))
of("uuid_text", "nation", "n_nationkey", "SELECT n_nationkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS u, CAST(NULL AS VARCHAR) AS bad FROM (SELECT n_nationkey, md5(n_name) AS m FROM nation)", lambda: dict(u=X.uuid_text(F.concat(F.lit("{"), F.upper(F.md5(c("n_name").cast("binary"))), F.lit("}"))), bad=X.uuid_text(c("n_name"))))
of("real_text", "part", "p_partkey", "SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS t FROM part", lambda: dict(t=X.real_text(F.round("p_retailprice", 2))))

of("json_extract", "events", "event_id", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events", lambda: dict(k=J.extract(c("props"), "$.k"), none=J.extract(c("props"), "$.none")))
of("json_arrow", "events", "event_id", "SELECT event_id, CAST(props -> '$.k' AS VARCHAR) AS a, props ->> '$.k' AS b FROM events", lambda: dict(a=J.arrow(c("props"), "$.k"), b=J.double_arrow(c("props"), "$.k")))
of("json_type_valid", "events", "event_id", "SELECT event_id, 1 AS v, 0 AS bad, 'object' AS t, 'integer' AS tk, 2 AS n FROM events", lambda: dict(v=J.valid(c("props")), bad=J.valid(c("event_type")), t=J.type_(c("props")), tk=J.type_(c("props"), "$.k"), n=J.array_length(F.concat(F.lit("["), c("props"), F.lit(",1]")))))
of("json_array_object", "events", "event_id", "SELECT event_id, '[' || event_id || ',\"' || event_type || '\",null]' AS a, '{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}' AS o, '\"' || event_type || '\"' AS q FROM events", lambda: dict(a=J.array(c("event_id"), c("event_type"), F.lit(None).cast("string")), o=J.object_(id=c("event_id"), t=c("event_type")), q=J.quote(c("event_type"))))
of("json_edit", "events", "event_id", "SELECT event_id, '{\"k\":' || (props ->> '$.k') || ',\"n\":1}' AS s, '{\"k\":' || (props ->> '$.k') || '}' AS i, '{\"k\":0}' AS r, '{}' AS d FROM events", lambda: dict(s=J.edit("set", c("props"), ("$.n", 1)), i=J.edit("insert", c("props"), ("$.k", 5)), r=J.edit("replace", c("props"), ("$.k", 0), ("$.z", 1)), d=J.remove(c("props"), "$.k")))
of("json_patch", "events", "event_id", "SELECT event_id, '{\"b\":{\"c\":2}}' AS p FROM events", lambda: dict(p=J.patch(c("props"), F.lit('{"k":null,"b":{"c":2,"d":null}}'))))


@query("json_each", "SELECT event_id, 'k' AS key, props ->> '$.k' AS value, 'integer' AS type FROM events")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "events").select("event_id", F.explode(J.each(c("props"))).alias("e"))
    return each.select("event_id", "e.key", "e.value", "e.type")


@query("json_tree", "SELECT event_id, unnest(['$', '$.k', '$.a', '$.a[0]', '$.a[1]']) AS fullkey, unnest(['object', 'integer', 'array', 'integer', 'integer']) AS type FROM events")
def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("props", "}\\s*$", ', "a": [1, 2]}')
    return table(spark, sf_dir, "events").select("event_id", F.explode(J.tree(text)).alias("e")).select("event_id", "e.fullkey", "e.type")


@query("json_group_array", "SELECT user_id, '[' || string_agg(event_id, ',' ORDER BY event_id) || ']' AS a FROM events GROUP BY user_id")
def json_group_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(J.group_array(c("event_id"), c("event_id")).alias("a"))


@query("json_group_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def json_group_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.group_object(c("n_name"), c("n_nationkey")).alias("o"))
