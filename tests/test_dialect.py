"""Scalar meanings on small values, against what the dialect says."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dates as D
from siltstone.functions import dialect as X
from siltstone.functions import json as J


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: X.int_div(F.lit(-7), F.lit(2)), -3), (lambda: X.int_div(F.lit(7), F.lit(0)), None), (lambda: X.mod(F.lit(-7), F.lit(3)), -1), (lambda: X.mod(F.lit(7), F.lit(0)), None),
        (lambda: X.add(F.lit(2**63 - 1), F.lit(1)), float(2**63)), (lambda: X.shift_left(F.lit(8), F.lit(-1)), 4), (lambda: X.shift_left(F.lit(1), F.lit(64)), 0), (lambda: X.shift_right(F.lit(-8), F.lit(70)), -1),
        (lambda: X.math("sqrt", F.lit(-1)), None), (lambda: X.math("acos", F.lit(2)), None), (lambda: X.log(F.lit(100)), 2.0), (lambda: X.log(F.lit(-1)), None), (lambda: X.trunc(F.lit(-2.7)), -2.0),
        (lambda: X.round_(F.lit(2.5)), 3.0), (lambda: X.round_(F.lit(-2.5)), -3.0), (lambda: X.sign(F.lit(-3.2)), -1),
        (lambda: X.lower(F.lit("ÄB")), "Äb"), (lambda: X.upper(F.lit("äb")), "äB"), (lambda: X.concat(F.lit("a"), F.lit(None), F.lit(1)), "a1"), (lambda: X.concat_ws(None, F.lit("a")), None),
        (lambda: X.substr(F.lit("hello"), 0, 2), "h"), (lambda: X.substr(F.lit("hello"), -3, 2), "ll"), (lambda: X.substr(F.lit("hello"), 3, -2), "he"), (lambda: X.substr(F.lit("hello"), 2), "ello"), (lambda: X.substr(F.lit("hello"), -9, 6), "he"), (lambda: X.substr(F.lit(None).cast("string"), 1), None),
        (lambda: X.hex_(F.lit(255)), "323535"), (lambda: X.hex_(F.lit(None)), ""), (lambda: X.unhex(F.lit("4x")), None), (lambda: X.unhex(F.lit("41-42"), "-"), bytearray(b"AB")), (lambda: X.quote(F.lit("it's")), "'it''s'"), (lambda: X.quote(F.lit(None).cast("string")), "NULL"),
        (lambda: X.soundex(F.lit("")), "?000"), (lambda: X.soundex(F.lit("Robert")), "R163"), (lambda: X.char(72, 228), "Hä"), (lambda: X.unicode_(F.lit("é")), 233), (lambda: X.zeroblob(2), bytearray(2)), (lambda: X.replace(F.lit("aa"), "", "x"), "aa"),
        (lambda: X.like(F.lit("HeLLo"), "h_l%"), True), (lambda: X.like(F.lit("Ä"), "ä"), False), (lambda: X.like(F.lit("5%"), "5!%", "!"), True), (lambda: X.like(F.lit("5x"), "5!%", "!"), False), (lambda: X.like(F.lit("a.c"), "abc"), False),
        (lambda: X.glob(F.lit("abc"), "a[^x]?"), True), (lambda: X.glob(F.lit("ABC"), "a*"), False), (lambda: X.glob(F.lit("a*"), "a[*]"), True),
        (lambda: X.format_("%05d|%s|%q|%Q", F.lit(42), F.lit("x"), F.lit("a'b"), F.lit(None).cast("string")), "00042|x|a''b|NULL"), (lambda: X.format_("100%%"), "100%"),
        (lambda: X.scalar_max(F.lit(1), F.lit(None).cast("int")), None), (lambda: X.scalar_min(F.lit(3), F.lit(2)), 2),
        (lambda: X.cast_integer(F.lit(" 12abc")), 12), (lambda: X.cast_integer(F.lit("abc")), 0), (lambda: X.cast_real(F.lit("-1.5e2x")), -150.0), (lambda: X.cast_real(F.lit("")), 0.0),
        (lambda: X.real_text(F.lit(50.0)), "50.0"), (lambda: X.decimal_op("add", F.lit("1.10"), F.lit("2.2")), "3.3"), (lambda: X.decimal_op("cmp", F.lit("1"), F.lit("2")), -1), (lambda: X.decimal_text(F.lit("100")), "100"), (lambda: X.uuid_text(F.lit("{A0EEBC99-9C0B4EF8-BB6D6BB9BD380A11}")), "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), (lambda: X.uuid_text(F.lit("zz")), None),
        (lambda: D.date(D.parse(F.lit("2024-01-31")), "+1 month"), "2024-03-02"), (lambda: D.date(D.parse(F.lit("2024-02-29")), "+1 year"), "2025-03-01"), (lambda: D.date(D.parse(F.lit("nonsense"))), None), (lambda: D.date(D.parse(F.lit("2024-13-01"))), None),
        (lambda: D.julianday(D.parse(F.lit("2000-01-01 12:00:00"))), 2451545.0), (lambda: D.datetime(D.parse(F.lit("2451545.0"))), "2000-01-01 12:00:00"), (lambda: D.date(D.parse(F.lit("2024-05-05")), "weekday 0"), "2024-05-05"), (lambda: D.date(D.parse(F.lit("2024-05-06")), "weekday 0"), "2024-05-12"),
        (lambda: D.datetime(D.parse(F.lit("2024-05-06")), "start of month", "-1 day", "+1.5 hours"), "2024-04-30 01:30:00"), (lambda: D.time(D.parse(F.lit("12:34:56"))), "12:34:56"), (lambda: D.unixepoch(D.from_unix(F.lit(1234567890))), 1234567890), (lambda: D.strftime("%d-%j-%w-%%", D.parse(F.lit("2024-03-01"))), "01-061-5-%"), (lambda: D.strftime("%Q", D.parse(F.lit("2024-03-01"))), None), (lambda: D.date(D.parse(F.lit("2024-03-01")), "nonsense"), None),
        (lambda: D.timediff(D.parse(F.lit("2024-03-02 01:00:00")), D.parse(F.lit("2023-02-01"))), "+0001-01-01 01:00:00.000"), (lambda: D.timediff(D.parse(F.lit("2024-01-01")), D.parse(F.lit("2024-01-02"))), "-0000-00-01 00:00:00.000"),
        (lambda: J.json_(F.lit(' {"b" : 1, "a":[ 2]}')), '{"b":1,"a":[2]}'), (lambda: J.json_(F.lit("{")), None), (lambda: J.valid(F.lit("{")), 0), (lambda: J.error_position(F.lit('{"a":x}')), 6), (lambda: J.error_position(F.lit("1")), 0),
        (lambda: J.edit("set", F.lit('{"a":[1,2]}'), ("$.a[#]", 3), ("$.a[#-3]", 9), ("$.b", {"c": None})), '{"a":[9,2,3],"b":{"c":null}}'), (lambda: J.edit("insert", F.lit('{"a":1}'), ("$.a", 2), ("$.b", 3)), '{"a":1,"b":3}'), (lambda: J.edit("replace", F.lit('{"a":1}'), ("$.a", 2), ("$.b", 3)), '{"a":2}'), (lambda: J.remove(F.lit('{"a":[1,2,3]}'), "$.a[1]", "$.x"), '{"a":[1,3]}'),
        (lambda: J.patch(F.lit('{"a":1,"b":2}'), F.lit('{"a":null,"c":{"d":1}}')), '{"b":2,"c":{"d":1}}'), (lambda: J.type_(F.lit('{"a":1.5}'), "$.a"), "real"), (lambda: J.type_(F.lit("[1]")), "array"), (lambda: J.array_length(F.lit('{"a":1}')), 0), (lambda: J.array(F.lit(1), F.lit('x"y'), F.lit(None).cast("string")), '[1,"x\\"y",null]'),
    ],
)
def test_value(spark, make, want):
    got = value(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) and not math.isinf(want) else got == want


@pytest.mark.parametrize(("declared", "want"), [("BIGINT", "INTEGER"), ("VARCHAR(10)", "TEXT"), ("", "BLOB"), ("DOUBLE", "REAL"), ("DECIMAL(3,1)", "NUMERIC"), ("FLOATING POINT", "INTEGER"), ("CHARINT", "INTEGER")])
def test_affinity(declared, want):
    assert X.affinity(declared) == want
