"""Field predicates like ``status>=500``: a small grammar, compiled to Columns once.

Logic is two-valued: an entry without the field fails every test but ``!=``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.fields import LEVEL, TIME, key_kind, resolve
from logloom.functions.levels import level_name, word_level
from logloom.functions.names import LEVEL_NAMES
from logloom.functions.text import trim_blanks
from logloom.functions.times import text_time
from logloom.operators.patterns import check_pattern, matches_any

#: The operators.
OPERATORS = ("~=", ">=", "<=", "!=", "==", ">", "<", "=")
_FLOAT = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity|nan)"
_WHOLE = r"[+-]?[0-9]+"


def _padded(text: str) -> bool:
    digits = text[1:] if text[:1] in ("-", "+") else text
    return len(digits) > 1 and digits[0] == "0" and digits[1] != "."


def _literal_time(text: str) -> int | None:
    """Instant of a literal in a layout of log lines, or cut to the day or the minute."""
    if (ts := text_time(text)) is not None:
        return ts
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return text_time(f"{text}T00:00:00Z")
    return text_time(f"{text}:00") if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{1,2}:[0-9]{2}", text) else None


@dataclass(frozen=True)
class Predicate:
    """One test of a field: key, operator and literal."""

    key: str
    op: str
    value: str

    @property
    def kind(self) -> str:
        return key_kind(self.key)

    def column(self, e: dict[str, Column]) -> Column:
        """The test over the columns of an entry: level, message, raw_line, logger, fields
        and ts_ns. True or false, never null."""
        if self.kind == LEVEL:
            return self._level(e["level"])
        at = _literal_time(self.value) if self.kind == TIME and self.op != "~=" else None
        if at is not None:
            return F.coalesce(_compare(self.op, e["ts_ns"], F.lit(at)), F.lit(self.op == "!="))
        text = resolve(self.key, **e)
        if self.op == "~=":
            test = matches_any(text, (self.value,))
        elif self.op in ("=", "==", "!="):
            same = self._equals(text)
            test = ~same if self.op == "!=" else same
        else:
            test = self._ordered(text)
        return F.when(text.isNull(), self.op == "!=").otherwise(test)

    def _level(self, level: Column) -> Column:
        if self.op == "~=":
            return matches_any(level_name(level), (self.value,))
        wanted = word_level(self.value)
        if wanted is not None:
            return F.coalesce(_compare(self.op, level, F.lit(wanted)), F.lit(False))
        # No level word: only the name can be equal, and none of them is.
        same = self.value.upper() in LEVEL_NAMES
        return F.lit(same if self.op in ("=", "==") else not same if self.op == "!=" else False)

    def _number(self) -> float | None:
        return float(self.value) if re.fullmatch(_FLOAT, self.value) else None

    def _equals(self, text: Column) -> Column:
        text, number = trim_blanks(text), self._number()
        same = text == self.value
        if number is None or _padded(self.value):
            return same
        padded = text.rlike(r"\A[+-]?0[^.]")
        as_double = _double(text) == F.lit(number)
        if re.fullmatch(_WHOLE, self.value) and -(1 << 63) <= int(self.value) < 1 << 63:
            whole = F.when(text.rlike(rf"\A{_WHOLE}\z"), text.try_cast("bigint"))
            as_double = F.when(whole.isNotNull(), whole == F.lit(int(self.value)).cast("bigint")).otherwise(as_double)
        return same | (~padded & F.coalesce(as_double, F.lit(False)))

    def _ordered(self, text: Column) -> Column:
        number = self._number()
        if number is None or math.isnan(number):
            return F.lit(False)
        return F.coalesce(_compare(self.op, _double(trim_blanks(text)), F.lit(number)), F.lit(False))


def _double(text: Column) -> Column:
    """A text as a number; null for other texts and for NaN, which equals nothing."""
    value = F.when(text.rlike(rf"\A(?:{_FLOAT})\z"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def parse_predicate(text: str) -> Predicate:
    """Read a predicate: the left-most operator counts, the longest of those that begin
    there. ValueError if there is none, no field before it, or a regex that is none."""
    places = [(text.find(op), -len(op), op) for op in OPERATORS if text.find(op) > 0]
    if not places:
        raise ValueError(f"no operator in {text!r} (use ==, !=, >, >=, <, <=, or ~=)")
    at, _, op = min(places)
    key, value = text[:at].strip(), text[at + len(op) :].strip()
    if not key:
        raise ValueError(f"missing field name in {text!r}")
    if not key.strip("<>=!~"):
        raise ValueError(f"missing field name in {text!r}: the field name reads as an operator")
    if op == "~=":
        check_pattern(value)
    return Predicate(key, op, value)


def where_column(predicates: tuple[Predicate, ...], e: dict[str, Column]) -> Column:
    """All predicates together."""
    out = F.lit(True)
    for p in predicates:
        out = out & p.column(e)
    return out
