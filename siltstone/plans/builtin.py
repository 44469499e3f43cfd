"""The dialect's functions by name, lowered to text of Spark SQL by the helpers of siltstone.functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import dates as T
from siltstone.functions import dialect as D
from siltstone.functions import json as J
from siltstone.plans.lowering import Node, SqlError, number, rendered, text_of

if TYPE_CHECKING:
    from siltstone.plans.lowering import Lowering

VERSION = "3.45.0"
MATH = set("ACOS ASIN ATAN ATAN2 COS SIN TAN ACOSH ASINH ATANH COSH SINH TANH LN LOG10 LOG2 EXP POW POWER SQRT DEGREES RADIANS".split())
#: Functions that Spark has with the same meaning, and the type of their results (None: of their arguments).
SAME = {"ABS": None, "COALESCE": None, "IFNULL": None, "NULLIF": None, "COUNT": "bigint", "ROW_NUMBER": "int", "RANK": "int", "DENSE_RANK": "int", "PERCENT_RANK": "double", "CUME_DIST": "double", "NTILE": "int", "LAG": None, "LEAD": None, "FIRST_VALUE": None, "LAST_VALUE": None, "NTH_VALUE": None, "MEDIAN": "double"}


def text(n: Node) -> Column:
    return F.expr(f"CAST({n.text} AS STRING)")


def value(x: Lowering, n: Node) -> Column:
    """An argument of a date function: the time of 'now', times as they are, else text or a Julian day."""
    if n.literal and isinstance(n.value, str) and n.value.lower() == "now":
        return F.current_timestamp()
    return n.col if x.kind(n) in ("timestamp", "date", "timestamp_ntz") else text(n)


def dated(f: Callable) -> Callable:
    def make(x: Lowering, *args: Node) -> Column:
        first = value(x, args[0]) if args else F.current_timestamp()
        ts, rest = T.instant(first, *[str(x.constant(m)) for m in args[1:]]) if args and x.kind(args[0]) not in ("timestamp", "date", "timestamp_ntz") else (first, [str(x.constant(m)) for m in args[1:]])
        return f(ts, *rest)

    return make


def strftime(x: Lowering, fmt: Node, *args: Node) -> Column:
    return dated(lambda ts, *m: T.strftime(x.constant(fmt), ts, *m))(x, *args)


def as_json(x: Lowering, n: Node) -> str:
    """A value as JSON text: what a JSON function made stays as it is."""
    if n.text.startswith(("dialect_json", "to_json(", "concat('[',", "concat('{',")):
        return n.text
    return f"coalesce({rendered(J.quote(n.col))}, 'null')"


def joined(items: list[str], ends: str) -> str:
    return f"concat('{ends[0]}', {(chr(44) + ' ' + text_of(',') + ', ').join(items) or text_of('')}, '{ends[1]}')"


def edited(how: str) -> Callable:
    def make(x: Lowering, doc: Node, *rest: Node) -> str:
        pairs = [y for p, v in zip(rest[::2], rest[1::2], strict=True) for y in (p.text, as_json(x, v))]
        return f"dialect_json_edit('{how}', {doc.text}, array({', '.join(pairs)}))"

    return make


def extract(x: Lowering, doc: Node, *paths: Node) -> str:
    if len(paths) == 1:
        return f"get_json_object({doc.text}, {x.path(paths[0])})"
    return joined([f"coalesce(to_json(variant_get(try_parse_json({doc.text}), {x.path(p)})), 'null')" for p in paths], "[]")


def typed(x: Lowering, n: Node) -> str:
    kind = x.kind(n)
    return "'null'" if kind == "void" else rendered(D.typeof(n.col, kind or "string"))


def shortest(x: Lowering, n: Node) -> Column:
    """trim() and the like take any value as text."""
    return F.expr(x.as_text(n))


def rounded(x: Lowering, n: Node, digits: Node | None = None) -> Column:
    return D.round_(F.expr(number(n, x.kind(n))[0]), int(digits.value) if digits else 0)


def quoted(x: Lowering, n: Node) -> Column:
    kind = x.kind(n)
    return D.quote(n.col, "blob" if kind == "binary" else "text" if kind == "string" else "number")


#: name to (type of the result, what makes a Column or text of the arguments).
TABLE: dict[str, tuple[str | None, Callable]] = {
    "LENGTH": ("int", lambda x, a: F.length(a.col if x.kind(a) == "binary" else shortest(x, a))), "OCTET_LENGTH": ("int", lambda x, a: F.octet_length(shortest(x, a))),
    "LOWER": ("string", lambda x, a: D.lower(shortest(x, a))), "UPPER": ("string", lambda x, a: D.upper(shortest(x, a))),
    "SUBSTR": ("string", lambda x, a, *n: D.substr(shortest(x, a), *[k.col for k in n])), "INSTR": ("int", lambda x, a, b: D.instr(shortest(x, a), shortest(x, b))),
    "TRIM": ("string", lambda x, a, *c: D.trim(shortest(x, a), *map(x.constant, c))), "LTRIM": ("string", lambda x, a, *c: D.ltrim(shortest(x, a), *map(x.constant, c))),
    "RTRIM": ("string", lambda x, a, *c: D.rtrim(shortest(x, a), *map(x.constant, c))), "REPLACE": ("string", lambda x, a, b, c: F.replace(shortest(x, a), shortest(x, b), shortest(x, c))),
    "HEX": ("string", lambda x, a: F.coalesce(F.hex(a.col), F.lit("")) if x.kind(a) == "binary" else D.hex_(shortest(x, a))), "UNHEX": ("binary", lambda x, a, *i: D.unhex(text(a), *map(x.constant, i))),
    "QUOTE": ("string", quoted), "SOUNDEX": ("string", lambda x, a: D.soundex(text(a))), "CHAR": ("string", lambda x, *c: D.char(*map(x.constant, c))), "UNICODE": ("int", lambda x, a: D.unicode_(text(a))),
    "ZEROBLOB": ("binary", lambda x, a: D.zeroblob(a.col)), "CONCAT": ("string", lambda x, *a: D.concat(*[shortest(x, v) for v in a])), "CONCAT_WS": ("string", lambda x, s, *a: D.concat_ws(x.constant(s), *[shortest(x, v) for v in a])),
    "PRINTF": ("string", lambda x, f, *a: D.format_(x.constant(f), *[v.col for v in a])), "TYPEOF": ("string", typed), "ROUND": ("double", rounded), "SIGN": ("int", lambda x, a: D.sign(F.expr(number(a, x.kind(a))[0]))),
    "TRUNC": ("double", lambda x, a: D.trunc(F.expr(f"CAST({a.text} AS DOUBLE)"))), "CEIL": ("double", lambda x, a: F.ceil(F.expr(f"CAST({a.text} AS DOUBLE)")).cast("double")), "FLOOR": ("double", lambda x, a: F.floor(F.expr(f"CAST({a.text} AS DOUBLE)")).cast("double")),
    "LOG": ("double", lambda x, a, *b: D.log(F.expr(f"CAST({(b[0] if b else a).text} AS DOUBLE)"), *[F.expr(f"CAST({a.text} AS DOUBLE)") for _ in b])), "MOD": ("double", lambda x, a, b: D.fmod(a.col, b.col)), "PI": ("double", lambda x: F.pi()),
    "IIF": (None, lambda x, c, a, *b: f"CASE WHEN {x.truth(c)} THEN {a.text} ELSE {b[0].text if b else 'NULL'} END"), "LIKELY": (None, lambda x, a, *_: a.text), "UNLIKELY": (None, lambda x, a: a.text), "LIKELIHOOD": (None, lambda x, a, p: a.text),
    "LIKE": ("boolean", lambda x, p, a, *e: x.like(a, p, x.constant(e[0]) if e else None)), "GLOB": ("boolean", lambda x, p, a: D.glob(text(a), x.constant(p))), "REGEXP": ("boolean", lambda x, p, a: f"regexp_like({a.text}, {p.text})"),
    "RANDOM": ("bigint", lambda x: "CAST(floor((rand() - 0.5D) * 1.8446744073709552E19D) AS BIGINT)"), "RANDOMBLOB": ("binary", lambda x, n: f"substring(unhex(repeat(replace(uuid(), '-', ''), CAST(ceil({n.text} / 16) AS INT))), 1, {n.text})"),
    "SQLITE_VERSION": ("string", lambda x: text_of(VERSION)), "UNISTR": ("string", lambda x, a: text_of(D.unistr(x.constant(a)))),
    "DATE": ("string", dated(T.date)), "TIME": ("string", dated(T.time)), "DATETIME": ("string", dated(T.datetime)), "JULIANDAY": ("double", dated(T.julianday)), "UNIXEPOCH": (None, dated(T.unixepoch)), "STRFTIME": ("string", strftime),
    "TIMEDIFF": ("string", lambda x, a, b: T.timediff(T.parse(value(x, a)), T.parse(value(x, b)))),
    "JSON": ("string", lambda x, a: f"dialect_json({a.text})"), "JSON_VALID": ("int", lambda x, a: J.valid(text(a)).cast("int")), "JSON_EXTRACT": ("string", extract), "JSON_TYPE": ("string", lambda x, a, *p: J.type_(text(a), *map(x.constant, p))),
    "JSON_ARRAY_LENGTH": ("int", lambda x, a, *p: J.array_length(text(a), *map(x.constant, p))), "JSON_QUOTE": ("string", lambda x, a: as_json(x, a)), "JSON_ARRAY": ("string", lambda x, *a: joined([as_json(x, v) for v in a], "[]")),
    "JSON_OBJECT": ("string", lambda x, *a: joined([f"concat({as_json(x, k)}, ':', {as_json(x, v)})" for k, v in zip(a[::2], a[1::2], strict=True)], "{}")),
    "JSON_SET": ("string", edited("set")), "JSON_INSERT": ("string", edited("insert")), "JSON_REPLACE": ("string", edited("replace")), "JSON_REMOVE": ("string", lambda x, a, *p: f"dialect_json_edit('remove', {a.text}, array({', '.join(v.text for v in p)}))"),
    "JSON_PATCH": ("string", lambda x, a, b: f"dialect_json_edit('patch', {a.text}, array({b.text}))"),
    "DECIMAL_ADD": ("string", lambda x, a, b: D.decimal_op("add", text(a), text(b))), "DECIMAL_SUB": ("string", lambda x, a, b: D.decimal_op("sub", text(a), text(b))), "DECIMAL_MUL": ("string", lambda x, a, b: D.decimal_op("mul", text(a), text(b))),
    "UUID": ("string", lambda x: "uuid()"),
}
ALIASES = {"SUBSTRING": "SUBSTR", "FORMAT": "PRINTF", "CEILING": "CEIL", "IF": "IIF", "STRING_AGG": "GROUP_CONCAT", "JSON_ARROW": "JSON_EXTRACT", "JSON_DOUBLE_ARROW": "JSON_EXTRACT", "JSONB": "JSON", **{f"JSONB_{f}": f"JSON_{f}" for f in ("EXTRACT", "ARRAY", "OBJECT", "SET", "INSERT", "REPLACE", "REMOVE", "PATCH", "GROUP_ARRAY", "GROUP_OBJECT")}}


def lowered(x: Lowering, name: str, args: list[Node], distinct: bool, order: str, tail: str) -> Node:
    name = ALIASES.get(name, name)
    one = "DISTINCT " if distinct else ""
    if name in ("MAX", "MIN") and len(args) > 1:
        f = D.scalar_max if name == "MAX" else D.scalar_min
        return Node(rendered(f(*[a.col for a in args])))
    if name in ("MAX", "MIN"):
        return Node(f"{name.lower()}({args[0].text}){tail}", args[0].kind)
    if name == "COUNT" and not args:
        return Node(f"count(*){tail}", "bigint")
    if name in ("SUM", "TOTAL", "AVG"):
        a, kind = number(args[0], x.kind(args[0]))
        if name == "TOTAL" or name == "AVG":
            f = f"{'avg' if name == 'AVG' else 'sum'}({one}CAST({a} AS DOUBLE)){tail}"
            return Node(f if name == "AVG" else f"coalesce({f}, 0.0D)", "double")
        return Node(f"sum({one}{a}){tail}", {"int": "bigint", "bigint": "bigint", "double": "double"}.get(kind or ""))
    if name == "GROUP_CONCAT":
        a, sep = x.as_text(args[0]), text_of(x.constant(args[1])) if len(args) > 1 else "','"
        if "OVER" in tail:
            return Node(f"CASE WHEN count({a}){tail} > 0 THEN array_join(collect_list({a}){tail}, {sep}) END", "string")
        return Node(f"listagg({one}{a}, {sep}){f' WITHIN GROUP (ORDER BY {order})' if order else ''}{tail}", "string")
    if name in ("JSON_GROUP_ARRAY", "JSON_GROUP_OBJECT"):
        item = as_json(x, args[0]) if name == "JSON_GROUP_ARRAY" else f"concat({as_json(x, args[0])}, ':', {as_json(x, args[1])})"
        ends = "[]" if name == "JSON_GROUP_ARRAY" else "{}"
        within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
        return Node(f"concat('{ends[0]}', coalesce(listagg({one}{item}, ','){within}{tail}, ''), '{ends[1]}')", "string")
    if name in ("PERCENTILE", "PERCENTILE_CONT", "PERCENTILE_DISC"):
        p = float(x.constant(args[1])) / (100 if name == "PERCENTILE" else 1)
        f = "percentile_disc" if name == "PERCENTILE_DISC" else "percentile_cont"
        return Node(f"{f}({p}D) WITHIN GROUP (ORDER BY {args[0].text}){tail}")
    if name in MATH:
        return Node(rendered(D.math(name.lower(), *[F.expr(f"CAST({number(a, x.kind(a))[0]} AS DOUBLE)") for a in args])), "double")
    if name in SAME:
        return Node(f"{name.lower()}({one}{', '.join(a.text for a in args)}){tail}", SAME[name])
    if name in TABLE:
        kind, make = TABLE[name]
        try:
            found = make(x, *args)
        except TypeError as e:
            raise SqlError(f"wrong number of arguments to function {name.lower()}()") from e
        return Node(found if isinstance(found, str) else rendered(found), kind)
    return Node(f"{name.lower()}({one}{', '.join(a.text for a in args)}){tail}")  # Spark's own, or a registered one


def register(spark) -> None:
    """The functions that need the parsed document, for use by name."""
    @F.arrow_udf("string")
    def dialect_json(docs: pa.Array) -> pa.Array:
        found = (J.parsed(d) for d in docs.to_pylist())
        return pa.array([None if v is J.MISSING else J.dumps(v) for v in found], pa.string())

    @F.arrow_udf("string")
    def dialect_json_edit(hows: pa.Array, docs: pa.Array, rest: pa.Array) -> pa.Array:
        out = []
        for how, doc, more in zip(hows.to_pylist(), docs.to_pylist(), rest.to_pylist(), strict=True):
            v = J.parsed(doc)
            if v is J.MISSING or any(m is None for m in more):
                out.append(None)
                continue
            if how == "patch":
                v = J.merged(v, J.parsed(more[0]))
            elif how == "remove":
                for p in more:
                    v = J.drop(v, J.steps(p)) if v is not J.MISSING else v
            else:
                for p, new in zip(more[::2], more[1::2], strict=True):
                    v = J.put(v, J.steps(p), J.parsed(new), how)
            out.append(None if v is J.MISSING else J.dumps(v))
        return pa.array(out, pa.string())

    spark.udf.register("dialect_json", dialect_json)
    spark.udf.register("dialect_json_edit", dialect_json_edit)
