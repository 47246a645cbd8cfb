"""Levels: of words, of numbers, of HTTP status codes; as Columns and for kernels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.names import DEBUG, ERROR, FATAL, INFO, LEVEL_NAMES, LEVEL_WORDS, TRACE, WARN
from logloom.functions.text import trim_blanks

# Whole words and beginnings of words of each level, tried in this order.
_WORDS = (
    (TRACE, ("TRACE", "VERBOSE", "FINEST"), ()),
    (DEBUG, ("FINE",), ("DEBUG",)),
    (INFO, ("NOTICE",), ("INFO",)),
    (WARN, (), ("WARN",)),
    (FATAL, ("FATAL", "PANIC"), ()),
    (ERROR, ("CRITICAL", "CRIT"), ("ERR",)),
)
#: Small numbers of one school of loggers, then tens of another.
_SMALL, _TENS = {0: INFO, 1: WARN, 2: ERROR}, (DEBUG, TRACE, DEBUG, INFO, WARN, ERROR)
_WHOLE = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def number_level(number: int) -> int:
    """Level of a number."""
    return _SMALL[number] if number in _SMALL else _TENS[max(0, number // 10)] if number < 60 else FATAL


def word_level(text: str) -> int | None:
    """Level that a word or number names, or None."""
    text = text.strip()
    if _WHOLE.fullmatch(text):
        return number_level(int(text)) if len(text) < 20 else None
    if _FLOAT.fullmatch(text):
        value = float(text)
        return number_level(int(value)) if abs(value) < 1 << 63 and value == int(value) else None
    text = text.upper()
    return next((level for level, whole, begins in _WORDS if text in whole or text.startswith(begins or "\0")), None)


def status_level(status: int) -> int | None:
    """Level of an HTTP status by class, or None if it is no status."""
    return ERROR if status >= 500 else WARN if status >= 400 else DEBUG if status >= 100 else None


def level_of_number(number: Column) -> Column:
    """Level of a whole number as a Column."""
    out = F.when(number < 10, DEBUG)
    for i, level in enumerate(_TENS[1:], 1):
        out = out.when(number < 10 * (i + 1), level)
    small = F.when(number == 0, _SMALL[0]).when(number == 1, _SMALL[1]).when(number == 2, _SMALL[2])
    return small.otherwise(out.otherwise(FATAL))


def parse_level(col: Column) -> Column:
    """Level (0 to 5) that a text or number names; null where it names none."""
    text = trim_blanks(col)
    value = F.when(text.rlike(r"\A[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    whole = F.when(text.rlike(r"\A[+-]?[0-9]{1,19}\z"), text.try_cast("bigint"))
    number = F.coalesce(whole, F.when((value == F.floor(value)) & (F.abs(value) < 2.0**63), value.try_cast("bigint")))
    upper, words = F.upper(text), None
    for level, exact, begins in _WORDS:
        test = F.lit(False)
        if exact:
            test = test | upper.isin(*exact)
        for start in begins:
            test = test | upper.startswith(start)
        words = F.when(test, level) if words is None else words.when(test, level)
    return F.when(number.isNotNull(), level_of_number(number)).when(value.isNull(), words)


def level_name(level: Column) -> Column:
    """Name of a level; UNKNOWN outside 0 to 5, null for null."""
    return F.when(level.between(0, 5), F.element_at(F.array(*map(F.lit, LEVEL_NAMES)), level.cast("int") + 1)).when(level.isNotNull(), "UNKNOWN")


def is_level_word(col: Column) -> Column:
    """Whether a text is exactly a level keyword; a number is none."""
    return F.coalesce(F.upper(trim_blanks(col)).isin(*LEVEL_WORDS), F.lit(False))


def level_of_status(status: Column) -> Column:
    """Level of an HTTP status by class; null if it is no status."""
    return F.when(status >= 500, ERROR).when(status >= 400, WARN).when(status >= 100, DEBUG)


def level_of_syslog(priority: Column) -> Column:
    """Level of a syslog priority number 0 to 191; null beyond."""
    severity = F.pmod(priority, F.lit(8))
    return F.when(priority.between(0, 191), F.when(severity <= 3, ERROR).when(severity == 4, WARN).when(severity <= 6, INFO).otherwise(DEBUG))
