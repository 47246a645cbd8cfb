"""Entries of raw log lines: record starts, and time, level, component and message.

A cascade of line shapes, from the most structured to plain text, reads each line. A
line without a level that is indented or belongs to a stack trace continues the entry
before it. Streams are cut into blocks; entries that cross a block edge are joined in a
second pass over the first and last entries of the blocks only.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import is_blank
from logloom.functions.instants import instant
from logloom.operators.blocks import TARGET_ROWS, block_between, order_cuts
from logloom.runtime import ship

Parts = tuple[int | None, str, str, str]

_WORDS = {"UTC": 0, "GMT": 0}
_DAY = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}"
_STAMP = _DAY + r"[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?: ?(?:Z|UTC)|[+-][0-9]{2}:?[0-9]{2})?"
_LEVEL = "(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)"
_COLLECTOR = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z) ")
_TRACE = re.compile(r"(Traceback \(most recent call last\):|goroutine [0-9]+|Caused by:|\(?[\w./*-]+\.\w+\(.*\)|[\w.$]*?(Error|Exception|Panic)\b\s*:)", re.I | re.A)
_ANYWHERE = re.compile(r"(?<![A-Za-z0-9_])(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)(?![A-Za-z0-9_])", re.I)
_ACCESS = re.compile(r'.*"(?:GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|CONNECT|TRACE) [^"]*HTTP/[0-9.]+"\s+([0-9]{3})\b', re.S)
_ACCESS_TIME = re.compile(r"\[([0-9]{2}/[A-Za-z]{3}/[0-9]{4}:[0-9:]{8} [+-][0-9]{4})\]")
_XML = re.compile(r'<([A-Za-z][\w.-]*)((?:\s+[\w.:-]+="[^"]*")*)\s*(?:/>|>(.*)</\1>)', re.S)
_ATTRIBUTE = re.compile(r'([\w.:-]+)="([^"]*)"')
_KLOG = re.compile(r"([IWEF])([0-9]{2})([0-9]{2}) ([0-9:]{8}\.[0-9]+)\s+[0-9]+\s+(\S+):[0-9]+\]\s?(.*)", re.S)
_SYSLOG = re.compile(r"<([0-9]{1,3})>(?:([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9:]{8}) \S+ ([^\s\[:]+)(?:\[[0-9]+\])?: ?)?(.*)", re.S)
_YAML_PAIR = re.compile(r"""\s*([\w.@-]+):\s+("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,{}\[\]"']*?)\s*(?:,|$)""", re.S)
_LOGFMT_PAIR = re.compile(r' *([A-Za-z0-9_.-]+)=(?:"((?:[^"\\]|\\.)*)"|([^" ][^ ]*|))(?= |$)', re.S)
#: Shapes with time (t), level (l) and component (c) ahead of the message (m).
_SHAPES = [
    re.compile(x, re.S | re.A)
    for x in (
        r"\[(?P<t>[^\]]+)\]\s+\[(?P<l>[^\]]+)\]\s+\[(?P<c>[^\]]+)\]\s*(?P<m>.*)",
        rf"\[(?P<t>{_STAMP}) (?P<l>[A-Za-z]+) +(?P<c>[\w:.-]+)\] (?P<m>.*)",
        rf"(?P<t>{_STAMP}) \[[0-9]+\] (?P<c>\S+) (?P<l>[A-Za-z]+): *(?P<m>.*)",
        rf"(?P<t>{_STAMP}) \[[^\]]+\] (?P<l>[A-Za-z]+) +(?P<c>\S+) - (?P<m>.*)",
        rf"(?P<t>{_STAMP}) - (?P<c>\S+) - (?P<l>[A-Za-z]+) - (?P<m>.*)",
        r"(?P<l>[A-Z]+):(?P<c>[A-Za-z_][\w.-]*):(?P<m>.*)",
    )
]
_CSV_HEAD = re.compile(_STAMP + " *,")
_TIME_LEVEL = re.compile(rf"(?P<t>{_STAMP})\s+(?P<l>(?i:{_LEVEL}))(?:\s+|: *)(?P<m>.*)", re.S)
_LEVEL_TIME = re.compile(rf"(?P<l>(?i:{_LEVEL}))\s+(?P<t>{_STAMP})\s+(?P<m>.*)", re.S)
_LEVEL_ONLY = re.compile(r"\[?(?P<l>TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)(?:\]:?|:)?\s+(?P<m>.*)", re.S)
_TIME_ONLY = re.compile(rf"(?P<t>{_STAMP})\s+(?P<m>.*)", re.S)
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_TIMES = ("time", "timestamp", "ts", "@timestamp", "date")
_LEVELS = ("level", "severity", "log_level", "loglevel", "log.level", "severity_text", "severityText", "@level", "levelname", "LEVEL", "lvl")
_MESSAGES = ("msg", "message", "log", "@message")
_LOGGERS = ("logger", "component", "logger_name", "source", "module", "category", "name")
_HTTP = ("method", "path", "route", "uri", "url", "request", "requestMethod", "requestPath", "controller", "action", "http.method", "http.route", "http.target", "http.url")
_STATUSES = ("status", "status_code", "statusCode", "http.status_code", "response.status", "responseStatusCode")


def level_of(word: object) -> str:
    """Level that a word or number names, or ''."""
    text = str(word).strip()
    try:
        number = float(text)
        if number != int(number):
            return ""
    except (ValueError, OverflowError):
        text = text.upper()
        for name, whole, start in (("TRACE", ("TRACE", "VERBOSE", "FINEST"), "\0"), ("DEBUG", ("FINE",), "DEBUG"), ("INFO", ("NOTICE",), "INFO"), ("WARN", (), "WARN"), ("FATAL", ("FATAL", "PANIC"), "\0"), ("ERROR", ("CRITICAL", "CRIT"), "ERR")):
            if text in whole or text.startswith(start):
                return name
        return ""
    if number in (0, 1, 2):
        return ("INFO", "WARN", "ERROR")[int(number)]
    return "DEBUG" if number < 10 else ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")[int(number) // 10 - 1] if number < 60 else "FATAL"


def _status_level(status: int) -> str:
    return "ERROR" if status >= 500 else "WARN" if status >= 400 else "DEBUG" if status >= 100 else ""


def _fields(data: dict, line: str) -> Parts:
    fold = {str(k).lower(): v for k, v in sorted(data.items(), key=lambda kv: str(kv[0]), reverse=True)}

    def first(names: tuple[str, ...]) -> object:
        return next((v for n in names if (v := data.get(n, fold.get(n.lower()))) is not None), None)

    level = level_of(first(_LEVELS)) if first(_LEVELS) is not None else ""
    if not level and any(n in data for n in _HTTP) and re.fullmatch("[0-9]{3}", str(first(_STATUSES))):
        level = _status_level(int(str(first(_STATUSES))))
    time, message, logger = first(_TIMES), first(_MESSAGES), first(_LOGGERS)
    us = instant(str(time), None, _WORDS) if isinstance(time, (str, int, float)) else None
    return us, level, "" if logger is None else str(logger), line if message is None else str(message)


def _braces(line: str) -> Parts | None:
    text = line.strip()
    if not (text.startswith("{") and text.endswith("}")):
        return None
    try:
        data = json.loads(text, parse_float=str)
        return _fields(data, line)
    except (ValueError, RecursionError):
        pass
    data, at, inner = {}, 0, text[1:-1]
    while at < len(inner):
        found = _YAML_PAIR.match(inner, at)
        if not found:
            return None
        value, at = found[2], found.end()
        if value[:1] == '"':
            try:
                value = json.loads(value, strict=False)
            except ValueError:
                value = value[1:-1]
        elif value[:1] == "'":
            value = value[1:-1].replace("''", "'")
        data[found[1]] = value
    if not any(n in data for n in _LEVELS + _MESSAGES):
        return None
    return _fields(data, line)


def _logfmt(line: str) -> Parts | None:
    data, at, text = {}, 0, line.rstrip(" ")
    while at < len(text):
        found = _LOGFMT_PAIR.match(text, at)
        if not found:
            return None
        data[found[1]], at = re.sub(r'\\(["\\])', r"\1", found[2]) if found[2] is not None else found[3], found.end()
    return _fields(data, line) if data else None


def _xml(line: str) -> Parts | None:
    found = _XML.fullmatch(line.strip())
    if not found:
        return None
    data = {k: unescape(v) for k, v in _ATTRIBUTE.findall(found[2])}
    inner = (found[3] or "").strip()
    if not data and not inner:
        return None
    us, level, logger, message = _fields(data, line)
    return us, level, logger, unescape(inner) if inner else message


def _csv(line: str) -> Parts | None:
    if not _CSV_HEAD.match(line):
        return None
    row = next(csv.reader([line]), [])
    us = instant(row[0], None, _WORDS) if len(row) > 2 else None
    at = next((i for i in range(1, len(row)) if level_of(row[i]) and re.fullmatch("[A-Za-z]+", row[i].strip())), None)
    if us is None or at is None:
        return None
    rest = [x for i, x in enumerate(row) if i not in (0, at)]
    return us, level_of(row[at]), rest[0].strip() if len(rest) > 1 else "", ",".join(rest[1:] if len(rest) > 1 else rest)


def parts(line: str, year: int) -> Parts:
    """Time in microseconds or None, level, component and message of a line."""
    if line[:1] in "{ \t" and (found := _braces(line)):
        return found
    if line[:1] == "<":
        if found := _xml(line):
            return found
        if (m := _SYSLOG.fullmatch(line)) and int(m[1]) <= 191:
            us = instant(f"{year:04d}-{_MONTHS.get(m[2], 0):02d}-{int(m[3]):02d}T{m[4]}", None, _WORDS) if m[2] else None
            return us, ("ERROR", "ERROR", "ERROR", "ERROR", "WARN", "INFO", "INFO", "DEBUG")[int(m[1]) % 8], m[5] or "", m[6]
    if m := _KLOG.fullmatch(line):
        return instant(f"{year:04d}-{m[2]}-{m[3]}T{m[4]}", None, _WORDS), {"I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL"}[m[1]], m[5], m[6]
    if (m := _ACCESS.match(line)) and _status_level(int(m[1])):
        at = _ACCESS_TIME.search(line)
        return instant(at[1], None, _WORDS) if at else None, _status_level(int(m[1])), "", line
    if found := _logfmt(line) or _csv(line):
        return found
    for shape in _SHAPES:
        if (m := shape.fullmatch(line)) and (level := level_of(m["l"])):
            return instant(m["t"], None, _WORDS) if "t" in m.groupdict() else None, level, m["c"], m["m"]
    for shape in (_TIME_LEVEL, _LEVEL_TIME, _LEVEL_ONLY):
        if m := shape.fullmatch(line):
            return instant(m["t"], None, _WORDS) if "t" in m.groupdict() else None, level_of(m["l"]), "", m["m"]
    word = _ANYWHERE.search(line)
    level = level_of(word[1]) if word else ""
    if (m := _TIME_ONLY.fullmatch(line)) and (us := instant(m["t"], None, _WORDS)) is not None:
        return us, level, "", m["m"]
    return None, level, "", line


def read_line(raw: str, year: int) -> tuple[bool, int, str, str, str]:
    """Whether a line starts an entry, then time (-1 for none), level, component, message."""
    line = raw.removesuffix("\r")
    prefix = _COLLECTOR.match(line)
    if prefix:
        line = line[prefix.end() :]
    us, level, component, message = parts(line, year)
    if prefix:
        us = instant(prefix[1], None, _WORDS)
    goes_on = not level and (line[:1] in (" ", "\t") or bool(_TRACE.match(line)))
    return not goes_on, -1 if us is None else us, level, component, message


_READ = "stream_id string, line_no bigint, start boolean, ts_us bigint, level string, component string, message string"


def _reader() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_line(r, y) for r, y in zip(batch.column("raw").to_pylist(), batch.column("year").to_pylist(), strict=True)]
            kinds = (pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([x[i] for x in read], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("line_no"), *columns], names=["stream_id", "line_no", "start", "ts_us", "level", "component", "message"])

    return run


def line_entries(log_lines: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per entry of each stream: ``stream_id``, ``first_line``, ``last_line``,
    ``ts_us`` (-1 for none), ``level``, ``component`` and ``message`` ('' for none).

    Null and blank lines belong to no entry, nor do rows without stream or number. A line
    delivered again counts once. A line before any entry that could go on with one starts
    one. Without ``ingest_ts`` a time without year is of 1970. Other columns are ignored,
    lines of any length are read whole, an empty table gives no rows. Blocks of about
    ``target_rows`` rows are cut at quantiles of the numbers, so neither a hot stream nor a
    stray number makes a large one.
    """
    ship(log_lines.sparkSession)
    number = F.col("line_no").cast("bigint")
    given = log_lines.where(F.col("stream_id").isNotNull() & number.isNotNull() & ~is_blank(F.col("raw")))
    cuts = order_cuts(log_lines, number, target_rows)  # reads the numbers only
    rows = given.select("stream_id", number.alias("line_no"), "raw", F.coalesce(F.year("ingest_ts"), F.lit(1970)).alias("year"))
    read = rows.mapInArrow(_reader(), _READ).withColumn("_block", block_between(F.col("line_no"), F.lit(None).cast("bigint"), cuts, target_rows))
    along = Window.partitionBy("stream_id", "_block").orderBy("line_no")
    once = read.withColumn("_again", F.coalesce(F.lag("line_no").over(along) == F.col("line_no"), F.lit(False))).where(~F.col("_again"))
    counted = once.withColumn("_n", F.sum(F.col("start").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.struct("line_no", "ts_us", "level", "component", "message")
    groups = counted.groupBy("stream_id", "_block", "_n").agg(F.min(said).alias("_said"), F.max("line_no").alias("_last"))
    # Only an entry that is the last of its block can go on in the next, as its group 0.
    tail = F.max("_n").over(Window.partitionBy("stream_id", "_block")) == F.col("_n")
    marked = groups.withColumn("_edge", tail | (F.col("_n") == 0))
    inner = marked.where(~F.col("_edge")).select("stream_id", "_said", "_last")
    across = Window.partitionBy("stream_id").orderBy("_block", "_n")
    edges = marked.where("_edge").withColumn("_island", F.sum((F.col("_n") > 0).cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edges.groupBy("stream_id", "_island").agg(F.min("_said").alias("_said"), F.max("_last").alias("_last")).drop("_island")
    found = inner.unionByName(joined)
    return found.select("stream_id", F.col("_said.line_no").alias("first_line"), F.col("_last").alias("last_line"), "_said.ts_us", "_said.level", "_said.component", "_said.message")
