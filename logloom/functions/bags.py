"""Field bags of lines: reading braces, and the text form of values.

A bag maps field names to values as read. JSON numbers keep their spelling, so that
``500.0`` and integers of 23 digits stay what they were.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from logloom.functions.names import HTTP_CONTEXT, HTTP_STATUS, LOGGER_KEYS


class Number(str):
    """A JSON number as written."""


def _reject(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_reject)


def json_object(text: str) -> tuple[dict[str, Any], int] | None:
    """The one JSON object that a text is, and its length, or None. A closing bracket right
    behind it is overlooked, other content is not."""
    try:
        data, end = _decoder.raw_decode(text)
    except (ValueError, RecursionError):
        return None
    rest = text[end:].lstrip(" \t\r\n")
    return (data, end) if isinstance(data, dict) and (not rest or rest[0] in "}]") else None


_PLAIN = re.compile(r"[^\s,\[\]{}:#&*!|>'\"%@`-](?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<!\s)#)*|-(?:[^\s,\[\]{}:#](?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<!\s)#)*)?|:(?![\s,\[\]{}]|\Z)(?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|\Z)|(?<!\s)#)*")
_DOUBLE, _SINGLE, _GAP = re.compile(r'"((?:[^"\\]|\\.)*+)"', re.S), re.compile(r"'((?:[^']|'')*+)'", re.S), re.compile(r"\s*")
#: Words that YAML 1.1 reads as null, true and false.
_NULL = frozenset(("", "~", "null", "Null", "NULL"))
_TRUE = frozenset("y Y yes Yes YES true True TRUE on On ON".split())
_FALSE = frozenset("n N no No NO false False FALSE off Off OFF".split())
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": " ", "P": " "}
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", re.S)
_YAML_INT = re.compile(r"[+-]?(?:0|[1-9][0-9_]*|0x[0-9a-fA-F_]+|0b[01_]+|0o?[0-7_]+)")
_YAML_FLOAT = re.compile(r"[+-]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?")


class _Bad(ValueError):
    pass


def _unescape(found: re.Match) -> str:
    code = found[1] or found[2] or found[3]
    if code:
        return chr(int(code, 16))
    if found[4] not in _ESCAPES:
        raise _Bad
    return _ESCAPES[found[4]]


def _scalar(word: str) -> Any:
    if word in _NULL:
        return None
    if word in _TRUE or word in _FALSE:
        return word in _TRUE
    bare = word.replace("_", "")
    if _YAML_INT.fullmatch(word):
        digits = bare.lstrip("+-")
        base = {"0x": 16, "0b": 2, "0o": 8}.get(digits[:2].lower(), 8 if len(digits) > 1 and digits[0] == "0" else 10)
        return int(bare, base) if base != 8 or digits[1:2] in "oO" else int(bare.replace("0", "0o", 1), 8)
    if _YAML_FLOAT.fullmatch(word):
        return float(bare)
    special = word.lower().lstrip("+-")
    if special in (".inf", ".nan") and word.lstrip("+-") in (".inf", ".Inf", ".INF", ".nan", ".NaN", ".NAN"):
        return float(bare.lower().replace(".", ""))
    return word


class _Flow:
    """Reader of one flow collection."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def skip(self) -> str:
        self.at = _GAP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0) -> Any:
        first = self.skip()
        if depth > 200:
            raise _Bad
        if first == "{":
            return self.collection("}", depth)
        if first == "[":
            return self.collection("]", depth)
        for quoted in (_DOUBLE, _SINGLE) if first in "\"'" and first else ():
            if found := quoted.match(self.text, self.at):
                self.at = found.end()
                return _ESCAPE.sub(_unescape, found[1]) if quoted is _DOUBLE else found[1].replace("''", "'")
        if first in ",]}":
            return None
        found = _PLAIN.match(self.text, self.at)
        if not found or not found[0] or (found[0].rstrip() == "-" and self.text[self.at + 1 : self.at + 2] in (" ", "\t")):
            raise _Bad
        self.at = found.end()
        return _scalar(found[0].rstrip())

    def collection(self, close: str, depth: int) -> Any:
        self.at += 1
        pairs: dict[str, Any] = {}
        items: list[Any] = []
        while self.skip() != close:
            start = self.at
            key = self.value(depth + 1)
            raw = self.text[start : self.at].strip()
            named = self.skip() == ":"
            if not raw and not named:
                raise _Bad  # a comma with nothing before it
            if named:
                self.at += 1
                value = None if self.skip() in (",", close) else self.value(depth + 1)
            else:
                value = None
            if close == "}":
                pairs[key if isinstance(key, str) else raw] = value
            else:
                items.append({key if isinstance(key, str) else raw: value} if named else key)
            after = self.skip()
            if after == ",":
                self.at += 1
            elif after != close:
                raise _Bad
        self.at += 1
        return pairs if close == "}" else items


#: A pair of a simple map: a plain key and a plain word or a text in quotes without escapes.
_SIMPLE = re.compile(r"""\s*([A-Za-z_][A-Za-z0-9_.]*):\s+(?:"([^"\\]*)"|((?:[A-Za-z0-9_.+]|-(?=[0-9.]))[A-Za-z0-9_.+/ -]*))\s*(?:,|\Z)""")


def _simple_map(text: str) -> dict[str, Any] | None:
    """A flow map of simple pairs alone, read pair by pair; None for any other."""
    data, at, inner = {}, 0, text[1:-1]
    while at < len(inner):
        found = _SIMPLE.match(inner, at)
        if not found or found[1] in _NULL or found[1] in _TRUE or found[1] in _FALSE or " -" in (found[3] or ""):
            return None
        data[found[1]] = found[2] if found[3] is None else _scalar(found[3].rstrip())
        at = found.end()
    return data or None


def yaml_flow_map(text: str) -> dict[str, Any] | None:
    """The one YAML flow map that a text is, or None."""
    if (simple := _simple_map(text)) is not None:
        return simple
    flow = _Flow(text)
    try:
        data = flow.value()
    except (ValueError, OverflowError):
        return None
    rest = text[flow.at :].strip()
    return data if isinstance(data, dict) and data and (not rest or rest.startswith("#")) else None


def _number_text(value: float) -> str:
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    # shortest form, with an exponent below 1e-4 and from 1e21 on
    if value and not 1e-4 <= abs(value) < 1e21:
        head, _, tail = repr(value).partition("e") if "e" in repr(value) else f"{value:e}".partition("e")
        head = head.rstrip("0").rstrip(".") if "." in head else head
        return f"{head}e{tail[0] if tail[0] in '+-' else '+'}{tail.lstrip('+-').zfill(2)}"
    return str(int(value)) if value == int(value) else repr(value)


def text_form(value: Any, inner: bool = False) -> str:
    """Text of a value: texts as they are, null as nothing, others as printed."""
    if isinstance(value, str):
        return str(value)
    if value is None:
        return "<nil>" if inner else ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return _number_text(value)
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{text_form(value[k], True)}" for k in sorted(value)) + "]"
    if isinstance(value, list):
        return "[" + " ".join(text_form(v, True) for v in value) + "]"
    return str(value)


_MISSING = object()


class Bag:
    """Look-ups in one field bag."""

    def __init__(self, data: dict[str, Any]) -> None:
        self.data = data
        self._folded: dict[str, Any] | None = None

    def exact(self, name: str) -> Any:
        """By exact name, then as a path of names joined by dots; _MISSING if there is none."""
        if name in self.data:
            return self.data[name]
        if "." not in name:
            return _MISSING
        value: Any = self.data
        for part in name.split("."):
            if not isinstance(value, dict) or part not in value:
                return _MISSING
            value = value[part]
        return value

    def get(self, name: str) -> Any:
        """By exact name or path, then, for a name without dot, whatever the case."""
        value = self.exact(name)
        if value is not _MISSING or "." in name:
            return value
        folded = self._folded
        if folded is None:
            names = "".join(self.data)
            folded = self._folded = self.data if names == names.lower() else {key.lower(): self.data[key] for key in sorted(self.data, reverse=True)}
        return folded.get(name.lower(), _MISSING)

    def present(self, names: tuple[str, ...]) -> list[Any]:
        """Values of those names that are there, in order."""
        return [v for n in names if (v := self.get(n)) is not _MISSING]

    def first_exact(self, names: tuple[str, ...]) -> str | None:
        """Text of the first of these names that is there by exact name."""
        return next((text_form(self.data[n]) for n in names if n in self.data), None)

    def status(self) -> int | None:
        """HTTP status, if the bag shows a request."""
        if _CONTEXT.isdisjoint(self.data) and all(self.exact(n) is _MISSING for n in _CONTEXT_PATHS):
            return None
        value = next((v for n in HTTP_STATUS if (v := self.get(n)) is not _MISSING), None)
        if isinstance(value, float):
            return int(value) if math.isfinite(value) else None
        text = text_form(value)
        text = text if isinstance(value, Number) else text.strip()
        return int(text) if re.fullmatch(r"[+-]?[0-9]{1,18}", text) else None

    def logger(self) -> str:
        """Logger that the bag names, else the library that its shape betrays, else ''."""
        if named := self.first_exact(LOGGER_KEYS):
            return named
        for fields, library in _LIBRARIES:
            if all(self.data.get(f) is not None for f in fields):
                return library
        return ""

    def flat(self) -> dict[str, str]:
        """Text of every field, and of every dotted path into nested maps."""
        if dict not in map(type, self.data.values()):
            return {k: v if type(v) is str else text_form(v) for k, v in self.data.items()}
        out: dict[str, str] = {}
        todo = [("", self.data)]
        while todo:
            prefix, data = todo.pop()
            for key, value in data.items():
                if prefix and "." in key:
                    continue
                name = prefix + key
                if not prefix or name not in out:
                    out[name] = text_form(value)
                if isinstance(value, dict) and "." not in key:
                    todo.insert(0, (name + ".", value))
        return out


MISSING = _MISSING
_CONTEXT, _CONTEXT_PATHS = frozenset(HTTP_CONTEXT), tuple(n for n in HTTP_CONTEXT if "." in n)
# Fields whose presence betrays a logging library, in this order.
_LIBRARIES = (
    (("caller", "ts"), "zap"),
    (("@level", "@timestamp"), "bunyan"),
    (("log.level",), "winston"),
    (("levelname",), "python"),
    (("stream", "log"), "docker"),
    (("pid", "level", "time"), "pino"),
    (("level", "msg"), "logrus"),
)


def json_text(value: Any) -> str:
    """Canonical JSON of a value: sorted keys, numbers as written, NaN as text."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    if isinstance(value, float) and not math.isfinite(value):
        return f'"{_number_text(value)}"'
    if isinstance(value, float):
        return _number_text(value)
    return "null" if value is None else "true" if value is True else "false" if value is False else str(value)
