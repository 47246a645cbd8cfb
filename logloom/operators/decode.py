"""Decoding raw lines into entries: one pass, one cascade of line grammars.

Grammars are tried from the most to the least structured and the first that fits wins:
JSON, YAML flow map, bracketed, logfmt, klog, syslog, access log, XML element, CSV row,
plain text. A line that a collector put a time in front of is decoded behind it, and that
time is the entry's time.

The grammars run in one Arrow kernel (``mapInArrow``): JSON lexemes, YAML scalars and
lazy CSV quotes cannot be said with built-in functions, and one pass over a line is
cheaper than a dozen native patterns. All that follows is built-in functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.functions.bags import MISSING, Bag, Number, json_object, json_text, text_form, yaml_flow_map
from logloom.functions.levels import number_level, status_level, word_level
from logloom.functions.names import DEBUG, DEFAULT_NAMES, ERROR, FATAL, INFO, LEVEL_NAMES, LEVEL_WORDS, LOGFMT_LOGGER, WARN, XML_LOGGER, XML_MESSAGE, XML_TIME, FieldNames
from logloom.functions.times import scaled, text_time
from logloom.runtime import ship

#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_W = r"[\t\n\f\r ]"
# The patterns of the grammars.
_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z"
_STAMP = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
_PREFIX = re.compile(rf"({_TIME}){_W}+([^\n]*)")
_ONE_BLANK = re.compile(rf"{_TIME} ")
_TRACE = re.compile(r"Traceback \(most recent call last\):|goroutine [0-9]+|Caused by:|\(?[\w./*-]+\.\w+\(.*\)|[\w.$]*?(?:Error|Exception|Panic)\b[\t\n\f\r ]*:", re.I | re.A)
_LEAD_TIME = re.compile(rf"[\t\n\f\r \[]*+(?:(?i:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\]?{_W}+\[?)?({_STAMP})(?:[\t\n\f\r \]:]|\Z)")
_LEAD_LEVEL = re.compile(rf"[\t\n\f\r \[]*+(?:{_STAMP}(?:[\t\n\f\r \]:]|\Z))?[\t\n\f\r \]\[]*+((?i:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL))(?:[\t\n\f\r \]:]|\Z)")
_ANY_LEVEL = re.compile(r"(?:\A|[^A-Za-z0-9_])((?i:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL))(?:[^A-Za-z0-9_]|\Z)")
_BRACKETED = re.compile(rf"\[([^\]]+)\]{_W}+\[([^\]]+)\]{_W}+\[([^\]]+)\]{_W}*([^\n]*)")
_KEY = re.compile(r"[A-Za-z0-9_.-]+")
_KLOG = re.compile(rf"([IWEF])[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\.[0-9]+{_W}+[0-9]+{_W}+[^\t\n\f\r ]+:[0-9]+\]{_W}?([^\n]*)")
_PRIORITY = re.compile(r"<([0-9]{1,3})>")
_ACCESS = re.compile(rf'"(?:GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|CONNECT|TRACE) [^"]*HTTP/[0-9.]+"{_W}+([0-9]{{3}})(?![A-Za-z0-9_])')
_XML_OPEN = re.compile(r"<([A-Za-z][A-Za-z0-9_.-]*)")
_XML_ATTRIBUTE = re.compile(rf'{_W}+([A-Za-z0-9_.:-]+)="([^"]*)"')
_XML_END = re.compile(rf"{_W}*(/>\Z|>)")
_XML_CLOSE = re.compile(r"</([A-Za-z][A-Za-z0-9_.-]*)>\Z")
_KLOG_LEVELS = {"I": INFO, "W": WARN, "E": ERROR, "F": FATAL}
_SEVERITIES = (ERROR, ERROR, ERROR, ERROR, WARN, INFO, INFO, DEBUG)

#: level or None, message, format, logger, bag or None, ts_ns or None, JSON text of the bag
#: where it has types, else None
Decoded = tuple[int | None, str, str, str, dict | None, int | None, str | None]


def _epoch_text(text: str) -> int | None:
    text = text.strip(WHITE)
    if re.fullmatch(r"[+-]?[0-9]{1,19}", text):
        return scaled(int(text))
    if re.fullmatch(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) and abs(float(text)) < 1 << 63:
        return scaled(int(float(text)))
    return None


def _bag_time(bag: Bag, names: tuple[str, ...]) -> int | None:
    for value in bag.present(names):
        found = None
        if isinstance(value, Number):
            found = _epoch_text(value)
        elif isinstance(value, str):
            if len(value) == 8 and value.isascii() and value.isdigit():
                found = text_time(f"{value[:4]}-{value[4:6]}-{value[6:]}T00:00:00Z")
            if found is None:
                found = _epoch_text(value)
            if found is None:
                found = text_time(value)
        elif isinstance(value, int) and not isinstance(value, bool):
            found = scaled(value)
        if found is not None:
            return found
    return None


def _bag_level(bag: Bag, names: tuple[str, ...]) -> int | None:
    for value in bag.present(names):
        if (level := word_level(text_form(value))) is not None:
            return level
    status = bag.status()
    return None if status is None else status_level(status)


def _braces(line: str, names: FieldNames) -> Decoded | None:
    text = line.strip(WHITE)
    if text[:1] != "{" or text[-1:] != "}":
        return None
    read = json_object(text)
    if read:
        data, written = read[0], text[: read[1]]
    else:
        data = yaml_flow_map(text)
        if data is None or all(Bag(data).exact(n) is MISSING for n in names.json_level + names.json_message):
            return None
        written = json_text(data)
    bag = Bag(data)
    message = next((s for v in bag.present(names.json_message) if (s := text_form(v))), "") or text_form(data.get("error")) or text
    return _bag_level(bag, names.json_level), message, "json", bag.logger(), data, _bag_time(bag, names.json_time), written


def trailing_fields(message: str) -> tuple[str, dict | None]:
    """Message and the ``key=value`` words it ends with; the last of equal keys counts."""
    words = message.split()
    fields: dict[str, str] = {}
    while words and "=" in words[-1]:
        key, _, value = words[-1].partition("=")
        if not value or not _KEY.fullmatch(key):
            break
        fields.setdefault(key, value.strip('"'))
        words.pop()
    return (" ".join(words), fields) if fields else (message.strip(WHITE), None)


def _bracketed(line: str) -> Decoded | None:
    found = _BRACKETED.fullmatch(line)
    level = word_level(found[2]) if found else None
    if level is None:
        return None
    message, fields = trailing_fields(found[4])
    return level, message, "bracketed", found[3], fields, text_time(found[1]), None


_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*+)("?)', re.S)
_PAIR = re.compile(r"([A-Za-z0-9_.-]+)=")
_UNESCAPED = re.compile(r'\\(["\\])')


def _logfmt(line: str, names: FieldNames) -> Decoded | None:
    fields: dict[str, str] = {}
    at, end = 0, len(line)
    while True:
        while at < end and line[at] == " ":
            at += 1
        if at == end:
            break
        pair = _PAIR.match(line, at)
        if not pair:
            return None
        at = pair.end()
        if line[at : at + 1] == '"':
            quoted = _QUOTED.match(line, at)
            value, at = quoted[1], quoted.end()
            if not quoted[2]:  # open to the end of the line, which may be a backslash
                value, at = line[quoted.start() + 1 :], end
            value = _UNESCAPED.sub(r"\1", value) if "\\" in value else value
        else:
            stop = line.find(" ", at)
            stop = end if stop < 0 else stop
            value, at = line[at:stop], stop
        fields[pair[1]] = value
    if not fields:
        return None
    bag = Bag(fields)
    named = bag.first_exact(names.logfmt_level)
    message, time = bag.first_exact(names.logfmt_message), bag.first_exact(names.logfmt_time)
    return None if named is None else word_level(named), line if message is None else message, "logfmt", bag.first_exact(LOGFMT_LOGGER) or "", fields, None if time is None else text_time(time), None


def _xml(line: str, names: FieldNames) -> Decoded | None:
    text = line.strip(WHITE)
    opened = _XML_OPEN.match(text)
    if not opened:
        return None
    fields, at = {}, opened.end()
    while found := _XML_ATTRIBUTE.match(text, at):
        fields[found[1]] = found[2]
        at = found.end()
    end = _XML_END.match(text, at)
    if not end:
        return None
    inner = ""
    if end[1] == ">":
        close = _XML_CLOSE.search(text, text.rfind("</"))if "</" in text else None
        if not close or close[1] != opened[1] or close.start() < end.end() or "\n" in text:
            return None
        inner = text[end.end() : close.start()].strip(WHITE)
    if not fields and not inner:
        return None
    bag = Bag(fields)
    named = bag.first_exact(XML_MESSAGE)
    message = inner or (line if named is None else named)
    time = bag.first_exact(XML_TIME)
    return _bag_level(bag, names.json_level), message, "xml", bag.first_exact(XML_LOGGER) or "", fields, None if time is None else text_time(time), None


def csv_columns(line: str) -> list[str]:
    """Columns of a CSV row whose quotes need not be right."""
    out, at, end = [], 0, len(line)
    while True:
        if line[at : at + 1] != '"':
            stop = line.find(",", at)
            out.append(line[at:] if stop < 0 else line[at:stop])
            if stop < 0:
                return out
            at = stop + 1
            continue
        at += 1
        value = []
        while True:
            stop = line.find('"', at)
            if stop < 0:  # open to the end
                value.append(line[at:])
                at = end + 1
                break
            value.append(line[at:stop])
            after = line[stop + 1 : stop + 2]
            if after in ("", ","):
                at = stop + 2
                break
            value.append('"')
            at = stop + (2 if after == '"' else 1)
        out.append("".join(value))
        if at > end:
            return out


def _csv(line: str) -> Decoded | None:
    comma = line.find(",")
    head = line[:comma].strip(WHITE) if line[:1] != '"' else None
    if head is not None and text_time(head) is None:
        return None
    columns = csv_columns(line)
    ts = text_time(columns[0].strip(WHITE))
    at = next((i for i, c in enumerate(columns[1:], 1) if c.strip(WHITE).upper() in LEVEL_WORDS), None)
    if len(columns) < 3 or ts is None or at is None:
        return None
    message = ", ".join(c.strip(WHITE) for i, c in enumerate(columns) if i not in (0, at))
    return word_level(columns[at]), message, "text", "", None, ts, None


def _without(text: str, word: str) -> str:
    """``text`` without ``word``, bare or in brackets, at its start."""
    rest = text.lstrip(" \t")
    for token in (f"[{word}]", word):
        if rest.startswith(token):
            behind = rest[len(token) :]
            if token[0] == "[" or behind[:1] in ("", " ", "\t"):
                return behind.lstrip(" \t")
    return text


def _plain(line: str) -> Decoded:
    time, word = _LEAD_TIME.match(line), _LEAD_LEVEL.match(line) or _ANY_LEVEL.search(line)
    said = line
    for _ in range(2):
        said = _without(said, time[1]) if time else said
        said = _without(said, word[1]) if word else said
    return word_level(word[1]) if word else None, said.strip(WHITE) or line.strip(WHITE), "text", "", None, text_time(time[1]) if time else None, None


def decode_payload(line: str, names: FieldNames = DEFAULT_NAMES) -> Decoded:
    """Decode one line by the first grammar that fits. Cheap tests of the line's characters
    skip grammars that cannot fit it."""
    lead = line.lstrip(WHITE)[:1]
    if lead == "{" and (found := _braces(line, names)):
        return found
    first = line[:1]
    if first == "[" and (found := _bracketed(line)):
        return found
    if "=" in line and (found := _logfmt(line, names)):
        return found
    if first in ("I", "W", "E", "F") and (klog := _KLOG.fullmatch(line)):
        return _KLOG_LEVELS[klog[1]], klog[2], "text", "", None, None, None
    if first == "<" and (priority := _PRIORITY.match(line)) and int(priority[1]) <= 191:
        return _SEVERITIES[int(priority[1]) % 8], line[priority.end() :].strip(WHITE), "text", "", None, None, None
    if "HTTP/" in line and (access := _ACCESS.search(line)) and (level := status_level(int(access[1]))) is not None:
        return level, line, "text", "", None, None, None
    if lead == "<" and (found := _xml(line, names)):
        return found
    if "," in line and (found := _csv(line)):
        return found
    return _plain(line)


def decode_line(line: str, names: FieldNames = DEFAULT_NAMES) -> tuple[Decoded, str]:
    """An entry and the raw text it falls back to, of a line with or without the time of
    a collector in front."""
    if line[:1].isdigit() and (prefix := _PREFIX.fullmatch(line)) and (ts := text_time(prefix[1])) is not None:
        found = decode_payload(prefix[2], names)
        found, payload = (*found[:5], ts, found[6]), prefix[2]
    else:
        found, payload = decode_payload(line, names), line
    return found, payload.strip(WHITE) if found[2] == "json" else payload


def continues(line: str) -> bool:
    """Whether a line is indented, or opens, chains or closes a stack trace, behind a
    collector's time and one blank."""
    if line[:1].isdigit() and (prefix := _ONE_BLANK.match(line)):
        line = line[prefix.end() :]
    return line[:1] in (" ", "\t") or bool(_TRACE.match(line))


SCHEMA = "level int, level_detected boolean, message string, format string, logger string, fields map<string,string>, fields_json string, ts_ns bigint, raw_line string, may_continue boolean"
_LONE = re.compile("[\ud800-\udfff]")


def _texts(texts: list[str | None]) -> pa.Array:
    """Texts as an array; halves of surrogate pairs, which UTF-8 cannot hold, replaced."""
    try:
        return pa.array(texts, pa.string())
    except UnicodeEncodeError:
        return pa.array([x and _LONE.sub("\ufffd", x) for x in texts], pa.string())


def _kernel(column: str, names: FieldNames, with_bags: bool = True) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels, messages, formats, loggers, bags, times, raws, goes_on = [], [], [], [], [], [], [], []
            keys, values, offsets = [], [], [0]
            for line in batch.column(column).to_pylist():
                (level, message, form, logger, data, ts, written), raw = decode_line(line or "", names)
                levels.append(level)
                messages.append(message)
                formats.append(form)
                loggers.append(logger)
                times.append(ts)
                raws.append(raw)
                goes_on.append(level is None and continues(line or ""))
                bags.append(written if with_bags else None)
                if data is None or not with_bags:
                    offsets[-1] = None
                else:
                    flat = Bag(data).flat()
                    keys += flat
                    values += flat.values()
                offsets.append(len(keys))
            ready = [
                pa.array([DEBUG if x is None else x for x in levels], pa.int32()),
                pa.array([x is not None for x in levels], pa.bool_()),
                _texts(messages),
                pa.array(formats, pa.string()),
                _texts(loggers),
                pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), _texts(keys), _texts(values)),
                _texts(bags),
                pa.array(times, pa.int64()),
                pa.array(raws, pa.string()),
                pa.array(goes_on, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *ready], names=[*batch.schema.names, *_NAMES])

    return run


_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def decode(lines: DataFrame, column: str = "raw", names: FieldNames = DEFAULT_NAMES, bags: bool = True) -> DataFrame:
    """Entries of raw lines: all columns of ``lines`` and those of ``SCHEMA``.

    A null line is like an empty one: DEBUG, no level, no fields. ``level`` is DEBUG where
    the line names none and ``level_detected`` says so. ``fields`` holds the text of every
    field and dotted path and is null for grammars without fields; ``fields_json`` is the
    JSON text of bags with types (JSON and YAML lines), null for others; without ``bags``
    both are null for all, which saves time where nobody looks at them. ``may_continue`` marks lines without a level that may belong to the entry
    before. Columns of ``lines`` with names of ``SCHEMA`` are replaced.
    """
    ship(lines.sparkSession)
    given = lines.select([c for c in lines.columns if c == column or c not in _NAMES])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(_kernel(column, names, bags), f"{schema}, {SCHEMA}")


__all__ = ["LEVEL_NAMES", "SCHEMA", "decode", "decode_line", "number_level"]
