"""Scalar functions of the dialect as Column expressions. All stay in the JVM, inside generated code where Spark has it.

Where Spark's own function differs (NULLs, case folding beyond ASCII, division by zero, positions from the end), the form
here has the dialect's meaning; each docstring names the difference.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | None


def lit(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- arithmetic -----------------------------------------------------------------------------------------------------


def add(a: Column, b: Column) -> Column:
    """Integer sum that turns REAL on overflow: a double either way."""
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient towards zero; NULL by zero."""
    a, safe = a.cast("long"), F.when(b != 0, b.cast("long"))
    return F.when(safe == -1, F.try_subtract(F.lit(0).cast("long"), a)).otherwise(F.call_function("div", a, safe))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a; NULL by zero."""
    return F.try_mod(a, b)


def fmod(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("double"), b.cast("double"))


def shift_left(a: Column, n: Column) -> Column:
    """A negative count shifts the other way; 64 and more leave nothing (or the sign)."""
    left = lambda k: F.when(k > 63, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", a.cast("long"), k.cast("int")))
    right = lambda k: F.call_function("shiftright", a.cast("long"), F.least(k, F.lit(63)).cast("int"))
    return F.when(n >= 0, left(n)).otherwise(right(-n))


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n)


def number(y: Column) -> Column:
    """NaN is NULL, as for every mathematical function outside its domain."""
    return F.when(~F.isnan(y), y)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def log(x: Column, base: Column | None = None) -> Column:
    """One argument: base 10. Out of domain: NULL."""
    if base is None:
        return F.when(x > 0, F.log10(x))
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def round_(x: Column, n: int = 0) -> Column:
    """Half away from zero, a REAL; digits are clamped to 0..30."""
    return F.round(x.cast("double"), min(max(n, 0), 30))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def math(name: str, *x: Column) -> Column:
    """Any one- or two-argument mathematical function by its name."""
    return number(F.call_function({"pow": "power", "ceiling": "ceil"}.get(name, name), *[v.cast("double") for v in x]).cast("double"))


# --- text -----------------------------------------------------------------------------------------------------------


def lower(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def upper(x: Column) -> Column:
    return F.translate(x, string.ascii_lowercase, string.ascii_uppercase)


def concat(*xs: Column) -> Column:
    """NULLs count as empty."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def concat_ws(sep: str | None, *xs: Column) -> Column:
    return F.lit(None).cast("string") if sep is None else F.concat_ws(sep, *[x.cast("string") for x in xs])


def substr(x: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """From 1; a negative start counts from the end; start 0 is the place before the first character and takes one off
    the length; a negative length takes the characters before start. NULL if any argument is."""
    n, s = F.length(x), lit(start).cast("long")
    first = F.when(s > 0, s).when(s < 0, n + s + 1).otherwise(0)
    if length is None:
        begin, end = first, n.cast("long") + 1
    else:
        k = lit(length).cast("long")
        begin = F.when(k >= 0, first).otherwise(first + k)
        end = F.when(k >= 0, first + k).otherwise(first)
    a, b = F.greatest(begin, F.lit(1).cast("long")), F.least(end, n.cast("long") + 1)
    out = F.when(b > a, F.substring(x, a.cast("int"), (b - a).cast("int"))).otherwise("")
    return F.when(x.isNotNull() & s.isNotNull() & (lit(length).isNotNull() if length is not None else F.lit(True)), out)


def instr(x: Column, y: Column | str) -> Column:
    return F.instr(x, lit(y))


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new)) if old else x


def hex_(x: Column) -> Column:
    """Of a number, the bytes of its text; of NULL, nothing."""
    return F.coalesce(F.hex(x.cast("string").cast("binary")), F.lit(""))


def unhex(x: Column, ignore: str = "") -> Column:
    bare = F.translate(x, ignore, "") if ignore else x
    return F.when(bare.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(bare))


def quote(x: Column, kind: str = "text") -> Column:
    """The literal for a value: text in single quotes, blobs as X'..', numbers bare, NULL."""
    if kind == "text":
        out = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "blob":
        out = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def soundex(x: Column) -> Column:
    return F.when(x.isNull() | ~x.rlike("[A-Za-z]"), "?000").otherwise(F.soundex(F.regexp_replace(x, "[^A-Za-z]", "")))


def char(*codes: int) -> Column:
    return F.lit("".join(map(chr, codes)))


def unicode_(x: Column) -> Column:
    return F.when(x != "", F.ascii(x))


def unistr(text: str) -> str:
    """Escapes of code points: 4 hex digits after a backslash, or u and 4, + and 6, U and 8; a doubled backslash is one."""
    code = lambda m: "\\" if m[0] == "\\\\" else chr(int(m[1] or m[2] or m[3] or m[4], 16))
    return re.sub(r"\\\\|\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))", code, text)


def zeroblob(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), lit(n).cast("int")))


def octet_length(x: Column) -> Column:
    return F.octet_length(x)


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """Without case for ASCII letters. A pattern that is a bare prefix without letters is pushed to the scan."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(_either(pattern[i]))
        else:
            out.append({"%": "(?s:.*)", "_": "(?s:.)"}.get(c) or _either(c))
        i += 1
    return x.rlike("\\A" + "".join(out) + "\\z")


def _either(c: str) -> str:
    return f"[{c.lower()}{c.upper()}]" if c in string.ascii_letters else re.sub(r"([^\w\s])", r"\\\1", c)


def glob(x: Column, pattern: str) -> Column:
    """*, ?, [set] and [^set], with case."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] == "^" else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body.removeprefix("^")) + "]")
            i = end
        else:
            out.append(re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    return x.rlike("\\A" + "".join(out) + "\\z")


def format_(template: str, *xs: Column) -> Column:
    """printf: %d %i %s %f %e %g %x %X %o %c %% with flags and widths, %q (quotes doubled), %Q (quoted or NULL), %w."""
    out, used, values = [], 0, []
    for piece in re.split(r"(%[-+ 0,#!]*\d*(?:\.\d+)?[a-zA-Z%])", template):
        if not piece.startswith("%") or piece == "%%":
            out.append(piece)
            continue
        x, kind, flags = xs[used], piece[-1], piece[1:-1].replace("!", "")
        used += 1
        if kind in "qQw":
            doubled = F.replace(x.cast("string"), F.lit("'" if kind != "w" else '"'), F.lit("''" if kind != "w" else '""'))
            values.append(quote(x.cast("string")) if kind == "Q" else F.coalesce(doubled, F.lit("(NULL)")))
            out.append("%s")
        elif kind in "di":
            values.append(F.coalesce(x.cast("long"), F.lit(0).cast("long")))
            out.append(f"%{flags}d")
        elif kind in "xXo":
            values.append(F.coalesce(x.cast("long"), F.lit(0).cast("long")))
            out.append(f"%{flags}{kind}")
        elif kind in "feEgG":
            values.append(F.coalesce(x.cast("double"), F.lit(0.0)))
            out.append(f"%{flags}{kind}")
        elif kind == "c":
            values.append(F.substring(x.cast("string"), 1, 1))
            out.append(f"%{flags}s")
        else:
            values.append(F.coalesce(x.cast("string"), F.lit("")))
            out.append(f"%{flags}s")
    return F.format_string("".join(out), *values) if values else F.lit("".join(out).replace("%%", "%"))


# --- conditions and types ---------------------------------------------------------------------------------------------


def iif(cond: Column, a: Value, b: Value) -> Column:
    return F.when(cond, lit(a)).otherwise(lit(b))


def scalar_max(*xs: Column) -> Column:
    """NULL if any argument is; greatest() would skip it."""
    return F.when(_all_known(xs), F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    return F.when(_all_known(xs), F.least(*xs))


def _all_known(xs: tuple[Column, ...]) -> Column:
    known = F.lit(True)
    for x in xs:
        known = known & x.isNotNull()
    return known


def likely(x: Column, chance: float | None = None) -> Column:
    """A hint to the planner; the value itself."""
    return x


def cast_integer(x: Column) -> Column:
    """The longest numeric prefix of a text, towards zero; 0 if there is none."""
    prefix = F.regexp_extract(x, "^\\s*([+-]?[0-9]+)", 1)
    return F.when(x.isNotNull(), F.coalesce(F.when(prefix != "", prefix).try_cast("long"), F.lit(0).cast("long")))


def cast_real(x: Column) -> Column:
    prefix = F.regexp_extract(x, "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(x.isNotNull(), F.coalesce(F.when(prefix != "", prefix).try_cast("double"), F.lit(0.0)))


def real_text(x: Column) -> Column:
    """A REAL as text: 15 digits, always with a point."""
    short = F.regexp_replace(F.format_string("%.15g", x), "(\\.[0-9]*?)0+(e|$)", "$1$2")
    short = F.regexp_replace(short, "\\.(e|$)", ".0$1")
    return F.when(x.isNotNull(), F.when(short.rlike("[.]"), short).otherwise(F.regexp_replace(short, "^([^e]+)", "$1.0")))


AFFINITIES = (("INT", "INTEGER"), ("CHAR", "TEXT"), ("CLOB", "TEXT"), ("TEXT", "TEXT"), ("BLOB", "BLOB"), ("REAL", "REAL"), ("FLOA", "REAL"), ("DOUB", "REAL"))


def affinity(declared: str) -> str:
    """By substring of the declared type, first match; none is BLOB, anything else NUMERIC."""
    name = declared.upper()
    if not name.strip():
        return "BLOB"
    return next((a for part, a in AFFINITIES if part in name), "NUMERIC")


def stored(x: Column, kind: str) -> Column:
    """A text value as a column of that affinity stores it, as text; typed columns are cast once and for all."""
    if kind == "INTEGER":
        return F.coalesce(x.try_cast("long").cast("string"), x)
    return x


def typeof(x: Column, dtype: str) -> Column:
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(dtype, "real" if dtype.startswith("decimal") else "integer")
    return F.when(x.isNull(), "null").otherwise(name)


def nocase(x: Column) -> Column:
    """The key under which texts compare in the NOCASE collation: ASCII letters only."""
    return lower(x)


def rtrim_key(x: Column) -> Column:
    """The key of the RTRIM collation."""
    return F.rtrim(x)


# --- exact decimals and identifiers -----------------------------------------------------------------------------------


def decimal_text(x: Column) -> Column:
    """Without trailing zeros or a bare point."""
    plain = x.cast("string")
    return F.when(plain.contains("."), F.regexp_replace(plain, "\\.?0+$", "")).otherwise(plain)


def decimal(x: Column, scale: int = 10) -> Column:
    return x.cast(f"decimal(38,{scale})")


def decimal_op(op: str, a: Column, b: Column) -> Column:
    """add, sub, mul as exact text; cmp as -1, 0, 1."""
    a, b = decimal(a, 6), decimal(b, 6)
    if op == "cmp":
        return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
    return decimal_text({"add": a + b, "sub": a - b, "mul": a * b}[op])


def uuid_text(x: Column) -> Column:
    """Lower case with dashes; NULL if there are not 32 hexadecimal digits."""
    bare = F.lower(F.regexp_replace(x, "[{}-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def uuid_blob(x: Column) -> Column:
    return F.unhex(F.replace(uuid_text(x), F.lit("-"), F.lit("")))
