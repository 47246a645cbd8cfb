"""Looking up fields of decoded entries as Columns.

``fields`` maps names and dotted paths to text. A name is looked up exactly first and
then, if it holds no dot, whatever its case; of several spellings the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.levels import level_name
from logloom.functions.names import DEFAULT_NAMES, HTTP_CONTEXT, HTTP_STATUS, LEVEL_KEYS, LOGGER_KEYS, MESSAGE_KEYS, TIME_KEYS, FieldNames
from logloom.functions.text import trim_blanks
from logloom.functions.times import rfc3339

STRUCTURED, LEVEL, MESSAGE, LOGGER, TIME = "structured", "level", "message", "logger", "timestamp"


def key_kind(key: str) -> str:
    """Which column of an entry a key means, else that it is a field of its own."""
    low = key.lower()
    return next((kind for kind, keys in ((LEVEL, LEVEL_KEYS), (MESSAGE, MESSAGE_KEYS), (LOGGER, LOGGER_KEYS), (TIME, TIME_KEYS)) if low in keys), STRUCTURED)


def field_exact(fields: Column, key: str) -> Column:
    """Text of a field by its exact name or path; null if it is not there."""
    return F.try_element_at(fields, F.lit(key))


def field(fields: Column, key: str) -> Column:
    """Text of a field by name or path, then whatever the case; null if it is not there."""
    if "." in key:
        return field_exact(fields, key)
    low = key.lower()
    # The smallest spelling; paths have dots and are no match for a name without.
    name = F.array_min(F.filter(F.map_keys(fields), lambda k: F.lower(k) == low))
    return F.coalesce(field_exact(fields, key), F.try_element_at(fields, name))


def first_field(fields: Column, keys: tuple[str, ...]) -> Column:
    """Text of the first of ``keys`` that is there."""
    return F.coalesce(*[field(fields, k) for k in keys])


def first_exact(fields: Column, keys: tuple[str, ...]) -> Column:
    """Text of the first of ``keys`` that is there by exact name."""
    return F.coalesce(*[field_exact(fields, k) for k in keys])


def whole_number(text: Column) -> Column:
    """A text as a whole number; null for any other text, such as ``500.0`` or ``0x1F``."""
    trimmed = trim_blanks(text)
    return F.when(trimmed.rlike(r"\A[+-]?[0-9]+\z"), trimmed.try_cast("bigint"))


def shows_request(fields: Column) -> Column:
    """Whether a bag of fields shows an HTTP request."""
    return F.coalesce(F.exists(F.map_keys(fields), lambda k: k.isin(*HTTP_CONTEXT)), F.lit(False))


def status_of(fields: Column) -> Column:
    """HTTP status that a bag of fields holds, 100 to 599; null if none."""
    status = whole_number(first_field(fields, HTTP_STATUS))
    return F.when(status.between(100, 599), status)


def status_class(fields: Column) -> Column:
    """First digit of the HTTP status, 1 to 5; null if there is none."""
    return F.floor(status_of(fields) / 100).cast("int")


def resolve(key: str, level: Column, message: Column, raw_line: Column, logger: Column, fields: Column, ts_ns: Column) -> Column:
    """Text that a key means for an entry; null where the entry has nothing for it."""
    kind = key_kind(key)
    if kind == LEVEL:
        return level_name(level)
    if kind == MESSAGE:
        return F.coalesce(F.nullif(message, F.lit("")), F.nullif(raw_line, F.lit("")))
    if kind == LOGGER:
        return F.coalesce(field(fields, key), F.nullif(logger, F.lit("")))
    if kind == TIME:
        return rfc3339(ts_ns)
    return field(fields, key)


def extra_fields(fields: Column, names: FieldNames = DEFAULT_NAMES) -> Column:
    """Fields that the entry's own columns do not show, without dotted paths into maps that
    are fields themselves."""
    shown = names.shown_elsewhere
    return F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*shown))


def sorted_pairs(fields: Column) -> Column:
    """(key, value) of a bag in order of keys."""
    return F.array_sort(F.map_entries(fields))
