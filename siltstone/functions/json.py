"""JSON over text columns. Reading stays in the JVM; edits, which must keep the order of keys, are Arrow-batched Python."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "array<struct<key: string, value: string, type: string, atom: string, id: int, parent: int, fullkey: string, path: string>>"


class MISSING:
    """Nothing there. A class, as it stays the same one in every worker."""



def dumps(v) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def steps(path: str) -> list:
    """Of $.key, $."key", $[n], $[#] and $[#-n]: strings, numbers, and ('end', n)."""
    out: list = []
    if not path.startswith("$"):
        raise ValueError(f"bad path {path}")
    for quoted, bare, index in re.findall(r'\.(?:"([^"]*)"|([^.\[]+))|\[([^\]]+)\]', path[1:]):
        if index:
            out.append(("end", int(index[2:] or 0)) if index.startswith("#") else int(index))
        else:
            out.append(quoted or bare)
    return out


def at(v, path: list):
    for s in path:
        if isinstance(s, tuple) and isinstance(v, list):
            s = len(v) - s[1]
        if isinstance(v, dict) and isinstance(s, str) and s in v:
            v = v[s]
        elif isinstance(v, list) and isinstance(s, int) and 0 <= s < len(v):
            v = v[s]
        else:
            return MISSING
    return v


def kind(v) -> str:
    return {type(None): "null", bool: "true" if v else "false", int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]


def put(v, path: list, new, how: str):
    """how: set, insert (only where nothing is) or replace (only where something is)."""
    if not path:
        return v if how == "insert" else new
    s, rest = path[0], path[1:]
    if isinstance(v, list) and not isinstance(s, str):
        s = len(v) - s[1] if isinstance(s, tuple) else s
        if 0 <= s < len(v):
            v[s] = put(v[s], rest, new, how)
        elif s == len(v) and not rest and how != "replace":
            v.append(new)
    elif isinstance(v, dict) and isinstance(s, str):
        if s in v:
            v[s] = put(v[s], rest, new, how)
        elif not rest and how != "replace":
            v[s] = new
    return v


def drop(v, path: list):
    parent = at(v, path[:-1]) if path else MISSING
    if not path:
        return MISSING
    s = path[-1]
    if isinstance(parent, dict):
        parent.pop(s, None)
    elif isinstance(parent, list):
        s = len(parent) - s[1] if isinstance(s, tuple) else s
        if isinstance(s, int) and 0 <= s < len(parent):
            del parent[s]
    return v


def merged(v, patch_):
    if not isinstance(patch_, dict):
        return patch_
    v = dict(v) if isinstance(v, dict) else {}
    for k, p in patch_.items():
        if p is None:
            v.pop(k, None)
        else:
            v[k] = merged(v.get(k), p)
    return v


def parsed(text: str | None):
    try:
        return MISSING if text is None else json.loads(text)
    except ValueError:
        return MISSING


def mapped(f, *cols: Column, kind_: str = "string") -> Column:
    """f over parsed texts, batch by batch; what doesn't parse is NULL."""
    arrow = {"string": pa.string(), "int": pa.int32()}[kind_]

    @F.arrow_udf(kind_)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = zip(*[x.to_pylist() for x in (batch if isinstance(batch, tuple) else (batch,))], strict=True)
            out = []
            for row in rows:
                values = [parsed(x) for x in row]
                got = MISSING if any(v is MISSING for v in values) else f(*values)
                out.append(None if got is MISSING else got)
            yield pa.array(out, arrow)

    return run(*cols)


def json_(x: Column) -> Column:
    """Checked and without white space."""
    return mapped(dumps, x)


def pretty(x: Column) -> Column:
    return mapped(lambda v: json.dumps(v, indent=4, ensure_ascii=False), x)


def valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("int"))


def error_position(x: Column) -> Column:
    """0 if valid, else the place of the first error, from 1."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else 0 * bool(json.loads(t)))
            except json.JSONDecodeError as e:
                out.append(e.pos + 1)
        return pa.array(out, pa.int32())

    return run(x)


def extract(x: Column, path: str) -> Column:
    """A scalar as text, a container as JSON."""
    return F.get_json_object(x, path)


def arrow(x: Column, path: str) -> Column:
    """-> : JSON text, strings keep their quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(x), path, "variant"))


def double_arrow(x: Column, path: str) -> Column:
    return extract(x, path)


def type_(x: Column, path: str = "$") -> Column:
    name = F.schema_of_variant(F.try_variant_get(F.try_parse_json(x), path, "variant"))
    one = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "BIGINT", "integer")
    one = one.when(name.startswith("DECIMAL") | (name == "DOUBLE"), "real").when(name == "BOOLEAN", extract(x, path)).when(name == "VOID", "null")
    return one


def array_length(x: Column, path: str = "$") -> Column:
    of = x if path == "$" else extract(x, path)
    return F.when(of.isNotNull(), F.coalesce(F.json_array_length(of), F.lit(0)))


def quote(x: Column) -> Column:
    """A value as a JSON literal; a text column is escaped as Spark writes it inside an array."""
    inside = F.to_json(F.array(x))
    return F.coalesce(F.substring(inside, F.lit(2), F.length(inside) - 2), F.lit("null"))


def array(*xs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.when(x.isNull(), "null").otherwise(quote(x)) for x in xs]), F.lit("]"))


def object_(**xs: Column) -> Column:
    cells = [F.concat(F.lit(dumps(k) + ":"), F.when(x.isNull(), "null").otherwise(quote(x))) for k, x in xs.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))


def edit(how: str, x: Column, *changes: tuple) -> Column:
    """set, insert or replace values at paths, one after the other."""
    todo = [(steps(p), v) for p, v in changes]

    def run(v):
        for p, new in todo:
            v = put(v, p, new, how)
        return dumps(v)

    return mapped(run, x)


def remove(x: Column, *paths: str) -> Column:
    todo = [steps(p) for p in paths]

    def run(v):
        for p in todo:
            v = drop(v, p) if v is not MISSING else v
        return v if v is MISSING else dumps(v)

    return mapped(run, x)


def patch(x: Column, y: Column) -> Column:
    """Merge patch of RFC 7396."""
    return mapped(lambda v, p: dumps(merged(v, p)), x, y)


def walk(x: Column, deep: bool) -> Column:
    @F.arrow_udf(NODE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def atom(v):
            return None if isinstance(v, dict | list) else v if isinstance(v, str) else str(int(v)) if isinstance(v, bool) else None if v is None else dumps(v)

        def nodes(v, key, full, path, parent, out):
            i = len(out)
            out.append({"key": key, "value": atom(v) if not isinstance(v, dict | list) else dumps(v), "type": kind(v), "atom": atom(v), "id": i, "parent": parent, "fullkey": full, "path": path})
            if deep or i == 0:
                for k, w in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
                    nodes(w, str(k), full + (f".{k}" if isinstance(v, dict) else f"[{k}]"), full, i, out)

        fields = [("key", pa.string()), ("value", pa.string()), ("type", pa.string()), ("atom", pa.string()), ("id", pa.int32()), ("parent", pa.int32()), ("fullkey", pa.string()), ("path", pa.string())]
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                v, out = parsed(t), []
                if v is not MISSING:
                    nodes(v, None, "$", None if deep else "$", None, out)
                rows.append(out if deep or not isinstance(v, dict | list) else out[1:])
            yield pa.array(rows, pa.list_(pa.struct(fields)))

    return run(x)


def each(x: Column) -> Column:
    """The members of a container, or the scalar itself."""
    return walk(x, False)


def tree(x: Column) -> Column:
    """Every node, the root first."""
    return walk(x, True)


def group_array(x: Column, order: Column) -> Column:
    """All values in an order, NULLs too."""
    cells = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.when(x.isNull(), "null").otherwise(quote(x)).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(cells, lambda s: s["v"]), ","), F.lit("]"))


def group_object(k: Column, v: Column) -> Column:
    cells = F.array_sort(F.collect_list(F.concat(quote(k), F.lit(":"), F.when(v.isNull(), "null").otherwise(quote(v)))))
    return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))
