"""Dates and times: a time value goes through modifiers from left to right and out in one of the formats. Anything that
can't be read is NULL, never an error. Times are UTC timestamps, so all of it stays in Catalyst."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIX_EPOCH = 2440587.5


def parse(x: Column) -> Column:
    """ISO dates, dates with times, times alone (on 2000-01-01), and numbers as Julian days."""
    text = F.trim(x)
    jd = F.when(text.rlike("^[0-9]+(?:\\.[0-9]+)?$"), from_julian(text.try_cast("double")))
    clock = F.when(text.rlike("^[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\\.[0-9]+)?)?$"), F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), text)))
    full = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))
    return F.coalesce(jd, clock, full)


def from_julian(jd: Column) -> Column:
    return F.timestamp_micros(F.round((jd - UNIX_EPOCH) * 86_400_000_000).cast("long"))


def from_unix(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds.cast("double") * 1_000_000).cast("long"))


def shift(ts: Column, n: float, unit: str) -> Column:
    """Months and years keep the day of the month and run over into the next month where it has fewer days."""
    if unit in ("month", "year"):
        months = int(n) * (12 if unit == "year" else 1)
        first = F.add_months(F.trunc(ts, "month"), months)
        days = F.date_add(first, F.dayofmonth(ts) - 1)
        return F.timestamp_micros(F.unix_micros(days.cast("timestamp")) + F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts)))
    micros = round(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000)
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(micros).cast("long"))


def instant(x: Column, *modifiers: str) -> tuple[Column, list[str]]:
    """A time value and the modifiers that are left: a first modifier of unixepoch, julianday or auto says what a number is."""
    how = modifiers[0].strip().lower() if modifiers else ""
    n = x.try_cast("double")
    if how == "unixepoch":
        return from_unix(n), list(modifiers[1:])
    if how == "julianday":
        return from_julian(n), list(modifiers[1:])
    if how == "auto":
        guess = F.when(n.between(0, 5373484.499999), from_julian(n)).when(n.isNotNull(), from_unix(n)).otherwise(parse(x))
        return guess, list(modifiers[1:])
    return parse(x), list(modifiers)


def modify(ts: Column, *modifiers: str) -> Column:
    ts = ts.cast("timestamp")
    for m in modifiers:
        m = m.strip().lower()
        if found := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(found[1], ts)
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            days = F.pmod(F.lit(int(found[1])) - (F.dayofweek(ts) - 1), F.lit(7))
            ts = F.timestamp_micros(F.unix_micros(ts) + days.cast("long") * 86_400_000_000)
        elif found := re.fullmatch(r"([+-]?[0-9.]+) (second|minute|hour|day|month|year)s?", m):
            ts = shift(ts, float(found[1]), found[2])
        elif m in ("utc", "localtime", "subsec", "subsecond"):
            pass  # the session runs in UTC
        else:
            return F.lit(None).cast("timestamp")
    return ts


def date(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd")


def time(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "HH:mm:ss.SSS" if _subsec(modifiers) else "HH:mm:ss")


def datetime(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd HH:mm:ss.SSS" if _subsec(modifiers) else "yyyy-MM-dd HH:mm:ss")


def _subsec(modifiers: tuple[str, ...]) -> bool:
    return any(m.strip().lower().startswith("subsec") for m in modifiers)


def julianday(ts: Column, *modifiers: str) -> Column:
    return F.unix_micros(modify(ts, *modifiers)) / 86_400_000_000 + UNIX_EPOCH


def unixepoch(ts: Column, *modifiers: str) -> Column:
    micros = F.unix_micros(modify(ts, *modifiers))
    return micros / 1_000_000 if _subsec(modifiers) else F.floor(micros / 1_000_000)


def strftime(fmt: str, ts: Column, *modifiers: str) -> Column:
    """Codes d e f F H I j J k l m M p P R s S T u U w W Y G g V %. An unknown code gives NULL."""
    ts = modify(ts, *modifiers)
    day = F.dayofweek(ts)
    pad = lambda x, n, c="0": F.lpad(x.cast("string"), n, c)
    hour12 = F.pmod(F.hour(ts) + 11, F.lit(12)) + 1
    week_year = F.extract(F.lit("YEAROFWEEK"), ts)
    codes = {
        "d": pad(F.dayofmonth(ts), 2), "e": pad(F.dayofmonth(ts), 2, " "), "f": F.date_format(ts, "ss.SSS"), "F": F.date_format(ts, "yyyy-MM-dd"),
        "H": pad(F.hour(ts), 2), "I": pad(hour12, 2), "j": pad(F.dayofyear(ts), 3), "J": julianday(ts).cast("string"), "k": pad(F.hour(ts), 2, " "),
        "l": pad(hour12, 2, " "), "m": pad(F.month(ts), 2), "M": pad(F.minute(ts), 2), "p": F.when(F.hour(ts) < 12, "AM").otherwise("PM"),
        "P": F.when(F.hour(ts) < 12, "am").otherwise("pm"), "R": F.date_format(ts, "HH:mm"), "s": unixepoch(ts).cast("string"), "S": pad(F.second(ts), 2),
        "T": F.date_format(ts, "HH:mm:ss"), "u": (F.pmod(day + 5, F.lit(7)) + 1).cast("string"), "w": (day - 1).cast("string"),
        "U": pad(F.floor((F.dayofyear(ts) + 7 - day) / 7).cast("int"), 2), "W": pad(F.floor((F.dayofyear(ts) + 6 - F.pmod(day + 5, F.lit(7))) / 7).cast("int"), 2),
        "Y": F.date_format(ts, "yyyy"), "G": pad(week_year, 4), "g": pad(F.pmod(week_year, F.lit(100)), 2), "V": pad(F.weekofyear(ts), 2), "%": F.lit("%"),
    }
    parts = re.findall(r"%.|[^%]+|%$", fmt, re.S)
    if any(p[0] == "%" and p[1:] not in codes for p in parts):
        return F.lit(None).cast("string")
    return F.concat(*[codes[p[1:]] if p[0] == "%" else F.lit(p) for p in parts]) if parts else F.lit("")


def timediff(a: Column, b: Column) -> Column:
    """What to add to b to get a: sign, years, months, days and time."""
    late, early = F.greatest(a, b), F.least(a, b)
    months = F.floor(F.months_between(late, early, False)).cast("int")
    reached = lambda n: F.timestamp_micros(F.unix_micros(F.add_months(early, n).cast("timestamp")) + F.unix_micros(early) - F.unix_micros(F.date_trunc("day", early)))
    months = F.when(reached(months) > late, months - 1).otherwise(months)
    rest = F.unix_micros(late) - F.unix_micros(reached(months))
    of = lambda unit, most: F.pmod(F.floor(rest / unit), F.lit(most)).cast("int")
    clock = F.format_string("%02d %02d:%02d:%02d.%03d", F.floor(rest / 86_400_000_000).cast("int"), of(3_600_000_000, 24), of(60_000_000, 60), of(1_000_000, 60), of(1000, 1000))
    head = F.format_string("%04d-%02d-", F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)).cast("int"))
    return F.concat(F.when(a >= b, "+").otherwise("-"), head, clock)
