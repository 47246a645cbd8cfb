"""Times: the layouts of log lines, epoch numbers, durations and display forms.

Instants are nanoseconds since 1970 UTC (``ts_ns``), since log lines carry nine digits
and Spark timestamps hold six. A text without zone means UTC.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_CLOCK = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?"
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})"
#: The accepted layouts. Zones follow the T form only.
_ISO = re.compile(rf"([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})T{_CLOCK}{_ZONE}?")
_BLANK = re.compile(rf"([0-9]{{4}})([-/])([0-9]{{2}})\2([0-9]{{2}}) {_CLOCK}")
_UNIX = re.compile(rf"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) ({'|'.join(_MONTHS)})  ?([0-9]{{1,2}}) {_CLOCK}(?: [A-Z]{{3,4}})? ([0-9]{{4}})", re.I)
_MONTH_OF = {m.lower(): i for i, m in enumerate(_MONTHS, 1)}
_EPOCH_DAY = date(1970, 1, 1).toordinal()
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _instant(year: int, month: int, day: int, hour: str, minute: str, second: str, fraction: str | None, zone: str | None) -> int | None:
    h, m, s = int(hour), int(minute), int(second)
    try:
        days = date(year, month, day).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    if h > 23 or m > 59 or s > 59:
        return None
    seconds = days * 86400 + h * 3600 + m * 60 + s
    if zone and zone != "Z":
        zh, zm = int(zone[1:3]), int(zone[-2:])
        if zh > 24 or zm > 59:
            return None
        seconds -= (zh * 3600 + zm * 60) * (-1 if zone[0] == "-" else 1)
    ns = seconds * 1_000_000_000 + int((fraction or "")[:9].ljust(9, "0"))
    return ns if _LEAST <= ns <= _MOST else None


def text_time(text: str) -> int | None:
    """Instant of a text in one of the layouts, or None; also None beyond 1678 to 2262."""
    if m := _ISO.fullmatch(text):
        return _instant(int(m[1]), int(m[2]), int(m[3]), m[4], m[5], m[6], m[7], m[8])
    if m := _BLANK.fullmatch(text):
        return _instant(int(m[1]), int(m[3]), int(m[4]), m[5], m[6], m[7], m[8], None)
    if m := _UNIX.fullmatch(text):
        return _instant(int(m[7]), _MONTH_OF[m[1].lower()], int(m[2]), m[3], m[4], m[5], m[6], None)
    return None


def scaled(number: int) -> int | None:
    """Instant of an epoch number: s, or from 1e11 on ms, from 1e15 µs, from 1e18 ns."""
    ns = number * (1 if number >= 10**18 else 1000 if number >= 10**15 else 1_000_000 if number >= 10**11 else 1_000_000_000)
    return ns if _LEAST <= ns <= _MOST else None


def parse_time(col: Column) -> Column:
    """``ts_ns`` of a text in one of the layouts; null if it is in none of them."""
    iso = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\z"
    blank = r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}) [0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?\z"
    unix = rf"\A(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:{'|'.join(_MONTHS)})  ?[0-9]{{1,2}} [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}(?:[.,][0-9]+)?(?: [A-Z]{{3,4}})? [0-9]{{4}}\z"
    zone = F.regexp_extract(col, r"T[^Z+-]*([+-][0-9]{2}):?([0-9]{2})\z", 0)
    sign = F.when(F.substring(F.right(zone, F.lit(6)), 1, 1) == "-", -1).when(F.substring(F.right(zone, F.lit(5)), 1, 1) == "-", -1).otherwise(1)
    zh = F.regexp_extract(col, r"[+-]([0-9]{2}):?[0-9]{2}\z", 1)
    zm = F.regexp_extract(col, r"[+-][0-9]{2}:?([0-9]{2})\z", 1)
    offset = F.when(zone != "", sign * (zh.try_cast("bigint") * 3600 + zm.try_cast("bigint") * 60)).otherwise(F.lit(0))
    good_zone = (zone == "") | ((zh.try_cast("int") <= 24) & (zm.try_cast("int") <= 59))
    clock = r"([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?"
    hms = [F.regexp_extract(col, rf"[T ]{clock}", i) for i in (1, 2, 3, 4)]
    month_name = F.initcap(F.regexp_extract(col, r"\A[A-Za-z]{3} ([A-Za-z]{3}) ", 1))
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), month_name)
    is_unix = col.rlike(unix)
    year = F.when(is_unix, F.regexp_extract(col, r"([0-9]{4})\z", 1)).otherwise(F.substring(col, 1, 4)).try_cast("int")
    mon = F.when(is_unix, month.cast("int")).otherwise(F.substring(col, 6, 2).try_cast("int"))
    day = F.when(is_unix, F.regexp_extract(col, r"\A[A-Za-z]{3} [A-Za-z]{3} +([0-9]{1,2}) ", 1)).otherwise(F.substring(col, 9, 2)).try_cast("int")
    days = F.unix_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(mon.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))
    h, m, s = (x.try_cast("int") for x in hms[:3])
    seconds = days.cast("bigint") * 86400 + h * 3600 + m * 60 + s - offset
    # 1678 to 2261 in full, so that nanoseconds fit
    fits = seconds.between(-9214560000, 9214646399)
    ns = seconds * 1_000_000_000 + F.rpad(F.substring(hms[3], 1, 9), 9, "0").try_cast("bigint")
    good = (col.rlike(iso) | col.rlike(blank) | is_unix) & (h <= 23) & (m <= 59) & (s <= 59) & good_zone & fits
    return F.when(good, ns)


def epoch_ns(number: Column) -> Column:
    """``ts_ns`` of an epoch number given as text or number: whole, or cut to whole."""
    text = F.trim(number.cast("string"))
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    value = F.when(text.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    n = F.coalesce(whole, F.when(F.abs(value) < 9.2e18, value.cast("bigint")))
    scale = F.when(n >= F.lit(10**18), 1).when(n >= F.lit(10**15), 1000).when(n >= F.lit(10**11), 1_000_000).otherwise(1_000_000_000)
    return F.when(n > F.lit(-9223372036), F.try_multiply(n, scale.cast("bigint")))


def time_field(col: Column) -> Column:
    """``ts_ns`` of a time field of JSON or YAML: eight digits that are a date, else an
    epoch number, else one of the layouts."""
    day = F.when(col.rlike(r"\A[0-9]{8}\z"), F.unix_date(F.concat_ws("-", F.substring(col, 1, 4), F.substring(col, 5, 2), F.substring(col, 7, 2)).try_cast("date")))
    return F.coalesce(day.cast("bigint") * 86_400_000_000_000, epoch_ns(col), parse_time(col))


def display_time(ts_ns: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC, whatever the session's zone."""
    return F.replace(F.replace(rfc3339(ts_ns), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))


def rfc3339(ts_ns: Column) -> Column:
    """RFC 3339 in UTC to whole seconds, whatever the session's zone."""
    seconds = F.floor(ts_ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("bigint")
    of_day = F.pmod(seconds, F.lit(86400))
    day = F.date_from_unix_date(((seconds - of_day) / 86400).cast("int"))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(F.floor(of_day / 3600)), F.lit(":"), two(F.floor(of_day % 3600 / 60)), F.lit(":"), two(of_day % 60), F.lit("Z"))


#: Units of a duration in nanoseconds.
_UNITS = {"ns": 1, "us": 1000, "µs": 1000, "μs": 1000, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def parse_duration(text: str) -> int:
    """Nanoseconds of a duration like ``1h30m`` or ``1.5s``; ValueError if it is none."""
    sign, rest = (-1 if text[:1] == "-" else 1), text.lstrip("+-") if text[:1] in "+-" else text
    if rest == "0":
        return 0
    parts = re.findall(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)", rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"invalid duration {text!r}")
    from fractions import Fraction

    return sign * int(sum(Fraction(a.rstrip(".")) * _UNITS[b] for a, b in parts))


def since_seconds(text: str) -> int:
    """Whole seconds of a positive duration, part of a second rounded up."""
    ns = parse_duration(text)
    if ns <= 0:
        raise ValueError("a duration must be above 0")
    return -(-ns // 10**9)
