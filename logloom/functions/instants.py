"""Instants of time texts of many shapes, in microseconds of UTC.

A text is read first: into an instant if it names its zone or is an epoch number, else into
a local time. A local time is placed by the offset history of its zone: one that occurs
twice means the earlier instant, a skipped one is read with the offset in force before the
change.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from functools import lru_cache
from zoneinfo import ZoneInfo

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_MON, _DAY = r"(?P<mon>[A-Za-z]{3})", r"(?:mon|tue|wed|thu|fri|sat|sun)"
_CLOCK = r"(?P<H>[0-9]{2}):(?P<M>[0-9]{2}):(?P<S>[0-9]{2})(?:[.,](?P<f>[0-9]+))?"
_ZONE = r"(?P<z>Z|(?:UTC|GMT)?[+-][0-9]{2}(?::?[0-9]{2})?|[A-Z]{2,5})"
_SHAPES = [
    re.compile(x, re.I | re.A)
    for x in (
        rf"(?P<y>[0-9]{{4}})(?P<s>[-/])(?P<m>[0-9]{{2}})(?P=s)(?P<d>[0-9]{{2}})(?:(?:T| +)(?P<H>[0-9]{{2}}):(?P<M>[0-9]{{2}})(?::(?P<S>[0-9]{{2}})(?:[.,](?P<f>[0-9]+))?)?(?: *{_ZONE})?)?",
        rf"(?P<y>[0-9]{{4}})(?P<m>[0-9]{{2}})(?P<d>[0-9]{{2}})(?:T(?P<H>[0-9]{{2}})(?P<M>[0-9]{{2}})(?P<S>[0-9]{{2}})(?:[.,](?P<f>[0-9]+))?(?: *{_ZONE})?)?",
        rf"{_DAY} +{_MON} +(?P<d>[0-9]{{1,2}}) +{_CLOCK}(?: +{_ZONE})? +(?P<y>[0-9]{{4}})",
        rf"(?:{_DAY}, +)?(?P<d>[0-9]{{1,2}}) +{_MON} +(?P<y>[0-9]{{4}}) +{_CLOCK}(?: *{_ZONE})?",
        rf"(?P<d>[0-9]{{1,2}})/{_MON}/(?P<y>[0-9]{{4}}):{_CLOCK}(?: *{_ZONE})?",
        rf"{_MON} +(?P<d>[0-9]{{1,2}}), +(?P<y>[0-9]{{4}}) +(?P<H>[0-9]{{1,2}}):(?P<M>[0-9]{{2}})(?::(?P<S>[0-9]{{2}})(?:[.,](?P<f>[0-9]+))?)? +(?P<half>[AP])M(?: *{_ZONE})?",
    )
]
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?")
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_zone = lru_cache(maxsize=None)(ZoneInfo)


def _epoch(text: str) -> int | None:
    """Seconds, or from 1e11 on milli-, from 1e15 micro- and from 1e18 nanoseconds."""
    if len(text) > 40:
        return None
    value = Decimal(text)
    if value >= 1 << 63:
        return None
    scale = Decimal("0.001") if value >= 10**18 else 1 if value >= 10**15 else 1000 if value >= 10**11 else 1_000_000
    return int(value * scale // 1)


def _offset(zone: str, words: dict[str, int]) -> timedelta | None:
    zone = zone.upper()
    if zone == "Z":
        return timedelta(0)
    sign = max(zone.find("+"), zone.find("-"))
    if sign < 0:
        return timedelta(minutes=words[zone]) if zone in words else None
    digits = zone[sign + 1 :].replace(":", "").ljust(4, "0")
    hours, minutes = int(digits[:2]), int(digits[2:])
    if hours > 18 or minutes > 59:
        return None
    return timedelta(hours=hours, minutes=minutes) * (-1 if zone[sign] == "-" else 1)


def read_time(text: str | None, words: dict[str, int]) -> tuple[int, bool] | None:
    """Microseconds of a time text, and whether they are an instant (else a local time as if
    it were UTC). None if the text is no real time. ``words`` are minutes by zone word."""
    text = (text or "").strip()
    found = next((m for shape in _SHAPES if (m := shape.fullmatch(text))), None)
    if not found:
        at = _epoch(text) if _NUMBER.fullmatch(text) else None
        return None if at is None else (at, True)
    part = {"H": None, "M": None, "S": None, "f": None, "z": None, "half": None, "m": None, "mon": None} | found.groupdict()
    month = int(part["m"]) if part["m"] else _MONTHS.get(part["mon"].lower(), 0)
    hour = int(part["H"] or 0)
    if part["half"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (part["half"] in "Pp")
    try:
        local = datetime(int(part["y"]), month, int(part["d"]), hour, int(part["M"] or 0), int(part["S"] or 0), int((part["f"] or "")[:6].ljust(6, "0")), tzinfo=UTC)
    except ValueError:
        return None
    offset = _offset(part["z"], words) if part["z"] else timedelta(0)
    if local.year == 1 or offset is None:
        return None
    return (local - _EPOCH - offset) // timedelta(microseconds=1), bool(part["z"])


def known_zone(zone: str | None) -> bool:
    """Whether a name is a zone with an offset history."""
    try:
        return bool(zone) and _zone(zone) is not None
    except (ValueError, OSError, KeyError):  # unknown names are KeyErrors
        return False


def placed(local_us: int, zone: str | None, fold: int = 0) -> int | None:
    """Instant of a local time in a zone, UTC for none; None beyond the calendar. ``fold`` 1
    takes the other offset where a clock change leaves two to choose from."""
    if not zone or zone == "UTC":
        return local_us
    try:
        local = (_EPOCH + timedelta(microseconds=local_us)).replace(tzinfo=_zone(zone), fold=fold)
        return (local - _EPOCH) // timedelta(microseconds=1)
    except (ValueError, OverflowError):
        return None


def instant(text: str | None, zone: str | None, words: dict[str, int]) -> int | None:
    """Microseconds since 1970 UTC of a time text, or None if it is no real time. ``zone`` is
    the zone where the text names none; an unknown name is like none."""
    read = read_time(text, words)
    if read is None or read[1]:
        return read and read[0]
    return placed(read[0], zone if known_zone(zone) else None)
