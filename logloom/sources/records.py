"""Records of declared formats: valid ones as typed columns, the others with the reason.

Rows are read permissively under an explicit schema that keeps the raw text of what does
not fit: CSV and JSON by Spark's readers, logfmt by one possessive pattern. Those readers
are laxer than the formats, so a row counts as read only if its raw text also fits the
strict shape of its format and all its columns are valid. All other rows, with their raw
text, are classified anew by quoting, column count and cast, in that order, in one Arrow
UDF that gets null for rows already read.
"""

from __future__ import annotations

import json
import re
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import is_blank
from logloom.runtime import ship

COLUMNS = ("time", "level", "logger", "status", "duration_ms", "message")
_LEVELS = {"TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL"}
_TIME = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]+)?(?:Z|[+-]([0-9]{2}):([0-9]{2}))")
_STATUS, _PLAIN = re.compile(r"0*[1-5][0-9]{2}"), re.compile(r"[0-9]+(?:\.[0-9]+)?")
_QUOTED_CSV, _BARE_CSV = re.compile(r'"((?:[^"]|"")*+)"'), re.compile(r'[^",]*+')
_GAP, _BARE, _QUOTED = re.compile(r"\s*+"), re.compile(r'[^\s"=]*+'), re.compile(r'"((?:[^"\\]|\\.)*+)"', re.S)
_VALUE = re.compile(r'[^\s"]*+')


class Unsplit(Exception):
    """The record cannot be split."""


class _Number(str):
    """A JSON number as written."""


def _csv(line: str) -> list[tuple[str, str]]:
    values, at = [], 0
    while True:
        found = (_QUOTED_CSV if line[at : at + 1] == '"' else _BARE_CSV).match(line, at)
        if not found:
            raise Unsplit
        values.append(found[1].replace('""', '"') if found.re is _QUOTED_CSV else found[0])
        at = found.end()
        if at == len(line):
            break
        if line[at] != ",":
            raise Unsplit
        at += 1
    names = COLUMNS if len(values) == len(COLUMNS) else range(len(values))
    return [(str(n), v) for n, v in zip(names, values, strict=True)]


def _no_constant(name: str) -> None:
    raise ValueError(name)


_json = json.JSONDecoder(object_pairs_hook=tuple, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


def _object(line: str) -> list[tuple[str, object]]:
    try:
        pairs = _json.decode(line)
    except (ValueError, RecursionError):
        raise Unsplit from None
    if not isinstance(pairs, tuple):
        raise Unsplit
    return list(pairs)


_ESCAPED = re.compile(r"\\(.)", re.S)
_SPELT = {"n": "\n", "t": "\t", "r": "\r"}


def _spelt(found: re.Match) -> str:
    return _SPELT.get(found[1], found[1])


def _logfmt(line: str) -> list[tuple[str, str | None]]:
    pairs, at = [], _GAP.match(line).end()
    while at < len(line):
        key = _BARE.match(line, at)
        at, value = key.end(), None
        if line[at : at + 1] == "=":
            found = (_QUOTED if line[at + 1 : at + 2] == '"' else _VALUE).match(line, at + 1)
            if not found:
                raise Unsplit
            value, at = _ESCAPED.sub(_spelt, found[1]) if found.re is _QUOTED else found[0], found.end()
        gap = _GAP.match(line, at).end()
        if gap == at < len(line):
            raise Unsplit
        pairs.append((key[0], value))
        at = gap
    return pairs


_SPLIT = {"csv": _csv, "json": _object, "logfmt": _logfmt}


def _real_time(text: str) -> bool:
    found = _TIME.fullmatch(text)
    if not found:
        return False
    hours, minutes = int(found[2] or 0), int(found[3] or 0)
    if minutes > 59 or hours * 60 + minutes > 18 * 60:
        return False
    try:
        return bool(datetime.strptime(found[1], "%Y-%m-%dT%H:%M:%S")) and found[1][-2:] < "60"
    except ValueError:
        return False


def _valid(row: dict, typed: bool) -> bool:
    if typed:
        if not all(type(row[c]) is str for c in ("time", "level", "logger", "message")):
            return False
        if not all(row[c] is None or type(row[c]) is _Number for c in ("status", "duration_ms")):
            return False
    status, duration = row["status"] or "", row["duration_ms"] or ""
    return (
        _real_time(row["time"])
        and row["level"].upper() in _LEVELS
        and bool(row["logger"].strip())
        and (status == "" or bool(_STATUS.fullmatch(status)))
        and (duration == "" or bool(_PLAIN.fullmatch(duration)))
    )


def classified(line: str | None, kind: str | None) -> tuple[str | None, dict]:
    """Why a record fails (quoting, column_count, value; None if it fits) and its columns.
    A record of an unknown format cannot be split."""
    if line is None or not line.strip():
        return "column_count", {}
    try:
        pairs = _SPLIT[kind](line)
    except (Unsplit, KeyError):
        return "quoting", {}
    if sorted(k for k, _ in pairs) != sorted(COLUMNS) or (kind == "logfmt" and any(v is None for _, v in pairs)):
        return "column_count", {}
    row = dict(pairs)
    if not _valid(row, kind == "json"):
        return "value", {}
    return None, row


def reason(line: str | None, kind: str | None) -> str | None:
    """Why a record fails, or None."""
    return classified(line, kind)[0]


_STRUCT = "struct<reason:string," + ",".join(f"{c}:string" for c in COLUMNS) + ">"


def _structs(lines: list[str | None], kinds: list[str | None], known: list[bool]) -> pa.Array:
    """Classes of the rows that are not known to fit."""
    rows = [(None, {}) if fits else classified(line, kind) for line, kind, fits in zip(lines, kinds, known, strict=True)]
    columns = [pa.array([why for why, _ in rows], pa.string())]
    columns += [pa.array([None if (v := row.get(c)) is None else str(v) for _, row in rows], pa.string()) for c in COLUMNS]
    return pa.StructArray.from_arrays(columns, names=["reason", *COLUMNS])


def _classifier():
    @F.arrow_udf(_STRUCT)
    def classes(lines: pa.Array, kinds: pa.Array, known: pa.Array) -> pa.Array:
        return _structs(lines.to_pylist(), kinds.to_pylist(), known.to_pylist())

    # So that a filter on the reason stays above it and the records go to Python once.
    return classes.asNondeterministic()


# The strict shapes of whole records; all loops are possessive, so long records do not recurse.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_CSV_SHAPE = rf"\A(?:{_FIELD},){{5}}{_FIELD}\z"
_TEXT = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1F]*+)*+"'
_B = r"[ \t\n\r]*+"
_MEMBER = rf'(?:"(?:time|level|logger|message)"{_B}:{_B}{_TEXT}|"(?:status|duration_ms)"{_B}:{_B}(?:null|(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+))'
_JSON_SHAPE = rf"\A{_B}\{{{_B}{_MEMBER}(?:{_B},{_B}{_MEMBER}){{5}}{_B}\}}{_B}\z"
_PAIR = rf'({"|".join(COLUMNS)})=("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^ \t\n\r\f"]*+)'
_LOGFMT_SHAPE = rf"(?s)\A *+{_PAIR}(?: ++{_PAIR}){{5}} *+\z"
_SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", _corrupt string"


def _column_checks(c: dict[str, Column]) -> Column:
    """Whether six text columns are all valid; empty and null stand for no number."""
    time = c["time"]
    shape = time.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:(?:0[0-9]|1[0-7]):[0-5][0-9]|18:00))\z")
    real = F.substring(time, 1, 10).try_cast("date").isNotNull() & (F.substring(time, 1, 4) != "0000")
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    good = (
        shape
        & real
        & F.upper(c["level"]).isin(*sorted(_LEVELS))
        & ~is_blank(c["logger"])
        & (empty(c["status"]) | c["status"].rlike(r"\A0*[1-5][0-9]{2}\z"))
        & (empty(c["duration_ms"]) | c["duration_ms"].rlike(r"\A[0-9]+(?:\.[0-9]+)?\z"))
        & c["message"].isNotNull()
    )
    return F.coalesce(good, F.lit(False))


def classify_records(raw_records: DataFrame, raw: str = "raw_line", kind: str = "format") -> DataFrame:
    """``raw_records`` with ``reason`` (null if a record fits) and the six columns typed:
    ``time`` TIMESTAMP, ``level``, ``logger``, ``status`` INT, ``duration_ms`` DOUBLE,
    ``message``, all null where it fails.

    Null and blank records fail by column_count, records of a null or unknown format by
    quoting. Given columns with the names of new ones are replaced; an empty table gives no
    rows. Records of any length are read whole.
    """
    ship(raw_records.sparkSession)
    new = {"reason", *COLUMNS}
    given = raw_records.select([c for c in raw_records.columns if c not in new or c in (raw, kind)])
    text, form = F.col(raw), F.col(kind)
    by_kind = lambda name, made: F.when(form == name, made)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    csv_options = options | {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\0", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}
    read = given.withColumns(
        {
            "_csv": F.from_csv(by_kind("csv", F.when(text.rlike(_CSV_SHAPE), text)), _SCHEMA, csv_options),
            "_json": F.from_json(by_kind("json", F.when(text.rlike(_JSON_SHAPE), text)), _SCHEMA, options),
            "_pairs": by_kind("logfmt", F.when(text.rlike(_LOGFMT_SHAPE), F.regexp_extract_all(text, F.lit(f"(?s){_PAIR}"), F.lit(0)))),
        }
    )
    distinct = F.size(F.array_distinct(F.transform("_pairs", lambda p: F.substring_index(p, "=", 1)))) == len(COLUMNS)
    every = F.lit(True)
    for name in COLUMNS:
        every = every & text.rlike(rf'"{name}"[ \t\n\r]*:')

    def pair(name: str) -> Column:
        found = F.get(F.filter("_pairs", lambda p: p.startswith(f"{name}=")), F.lit(0))
        value = F.substr(found, F.lit(len(name) + 2))
        bare = F.substr(value, F.lit(2), F.length(value) - 2)
        inner = bare
        for letter, char in _SPELT.items():
            inner = F.regexp_replace(inner, rf"(?<!\\)((?:\\\\)*+)\\{letter}", f"$1{char}")
        undone = F.when(bare.contains("\\"), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(bare)
        return F.when(value.startswith('"'), undone).otherwise(value)

    columns = {c: F.coalesce(by_kind("csv", F.col(f"_csv.{c}")), by_kind("json", F.col(f"_json.{c}")), by_kind("logfmt", pair(c))) for c in COLUMNS}
    corrupt = F.coalesce(F.col("_csv._corrupt"), F.col("_json._corrupt")).isNotNull()
    whole = F.when(form == "csv", F.col("_csv").isNotNull()).when(form == "json", F.col("_json").isNotNull() & every).when(form == "logfmt", distinct)
    read = read.withColumns({f"_c_{c}": made for c, made in columns.items()})
    fits = F.coalesce(whole, F.lit(False)) & ~corrupt & _column_checks({c: F.col(f"_c_{c}") for c in COLUMNS})
    read = read.withColumn("_fits", fits)
    again = _classifier()(F.when(~F.col("_fits"), text), form, F.col("_fits"))
    read = read.withColumn("_again", again)
    value = {c: F.when(F.col("_fits"), F.col(f"_c_{c}")).otherwise(F.col(f"_again.{c}")) for c in COLUMNS}
    typed = {
        "time": F.when(value["time"] != "", value["time"].try_cast("timestamp")),
        "status": F.nullif(value["status"], F.lit("")).try_cast("int"),
        "duration_ms": F.nullif(value["duration_ms"], F.lit("")).try_cast("double"),
    }
    return read.select(*given.columns, F.col("_again.reason").alias("reason"), *[typed.get(c, value[c]).alias(c) for c in COLUMNS])


def valid_records(raw_records: DataFrame) -> DataFrame:
    """``record_id`` and the six typed columns of every record that fits, each once."""
    read = classify_records(raw_records.select("record_id", "format", "raw_line"))
    return read.where(F.col("reason").isNull()).select("record_id", *COLUMNS).distinct()


def failing_records(raw_records: DataFrame) -> DataFrame:
    """``record_id`` and ``reason`` of every record that does not fit its format, each once."""
    read = classify_records(raw_records.select("record_id", "format", "raw_line"))
    return read.where(F.col("reason").isNotNull()).select("record_id", "reason").distinct()
