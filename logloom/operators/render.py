"""Entries as lines: text, projections, NDJSON; colors and highlights for terminals.

Texts are built from built-in functions. Only bags with types (``fields_json`` of JSON and
YAML lines) go through an Arrow UDF, which gets null for all other rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.bags import MISSING, Bag, Number, json_text, text_form
from logloom.functions.fields import LEVEL, LOGGER, MESSAGE, STRUCTURED, TIME, extra_fields, key_kind, resolve, sorted_pairs
from logloom.functions.levels import level_name
from logloom.functions.names import DEFAULT_NAMES, LOGGER_KEYS, FieldNames
from logloom.functions.text import UNSAFE, needs_attention, quoted, sanitize
from logloom.functions.times import display_time, rfc3339
from logloom.options import QueryOptions
from logloom.runtime import ship

_UNSAFE = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", UNSAFE) + "]")
_QUOTE = frozenset(" =,\"'[]{}()")


def sanitized(text: str) -> str:
    """A text with unsafe characters spelt out."""
    return _UNSAFE.sub(lambda m: f"\\x{ord(m[0]):02X}" if ord(m[0]) <= 0xFF else f"\\u{ord(m[0]):04X}", text)


def shown_value(value: object) -> str:
    """A value of a bag as a line shows it."""
    if isinstance(value, Number):
        return f"{float(value):.2f}" if set(value) & set(".eE") else str(value)
    if isinstance(value, str):
        safe = sanitized(value)
        return f'"{safe}"' if not safe or _QUOTE & set(safe) else safe
    if isinstance(value, dict):
        return "{" + " ".join(f"{sanitized(k)}={shown_value(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + " ".join(map(shown_value, value)) + "]"
    return "null" if value is None else text_form(value)


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number)


def _bag(text: str) -> dict:
    data = _decoder.decode(text)
    return _whole(data) if "\\ud" in text or "\\uD" in text else data


def _whole(value: object) -> object:
    """A value without halves of surrogate pairs."""
    if isinstance(value, dict):
        return {_whole(k): _whole(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return value if isinstance(value, Number) or not isinstance(value, str) else re.sub("[\ud800-\udfff]", "\ufffd", value)


def _safe_values(value: object) -> object:
    if isinstance(value, dict):
        return {sanitized(k): _safe_values(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_safe_values(v) for v in value]
    return value if isinstance(value, Number) or not isinstance(value, str) else sanitized(value)


def _bag_udf(names: FieldNames, as_json: bool):
    hidden, loggers = frozenset(names.shown_elsewhere), frozenset(LOGGER_KEYS)

    @F.arrow_udf("string")
    def shown(bags: pa.Array, logger: pa.Array) -> pa.Array:
        out = []
        for bag, named in zip(bags.to_pylist(), logger.to_pylist(), strict=True):
            if bag is None:
                out.append(None)
                continue
            data = {k: v for k, v in _bag(bag).items() if k.lower() not in hidden}
            if as_json:
                out.append(json_text(_safe_values(data)) if data else None)
                continue
            pairs = (f"{sanitized(k)}={shown_value(data[k])}" for k in sorted(data) if not (named and k.lower() in loggers and text_form(data[k]) == named))
            out.append(" ".join(pairs))
        return pa.array(out, pa.string())

    return shown


def _typed(df: DataFrame) -> bool:
    """Whether bags come with types; if so, workers will need this package."""
    if "fields_json" not in df.columns:
        return False
    ship(df.sparkSession)
    return True


def _fields_text(df: DataFrame, names: FieldNames) -> Column:
    """Sorted ``key=value`` of an entry's own fields; '' if there are none."""
    is_json = F.col("format") == "json"
    hidden_logger = F.when(is_json, F.nullif("logger", F.lit("")))
    kept = F.map_filter(extra_fields(F.col("fields"), names), lambda k, v: ~F.coalesce(F.lower(k).isin(*LOGGER_KEYS) & (v == hidden_logger), F.lit(False)))
    pairs = F.transform(sorted_pairs(kept), lambda p: F.concat(sanitize(p["key"]), F.lit("="), quoted(p["value"])))
    native = F.coalesce(F.array_join(pairs, " "), F.lit(""))
    if not _typed(df):
        return native
    typed = _bag_udf(names, False)(F.when(is_json, F.col("fields_json")), hidden_logger)
    return F.when(is_json, F.coalesce(typed, F.lit(""))).otherwise(native)


def details(df: DataFrame, names: FieldNames = DEFAULT_NAMES) -> Column:
    """What a line shows behind time, level and logger, by format of the entry."""
    raw = F.col("raw_line") if "raw_line" in df.columns else F.lit("")
    message = F.coalesce("message", F.lit(""))
    own = F.when((message != "") & (message != raw), sanitize(message))
    fields = F.nullif(_fields_text(df, names), F.lit(""))
    plain = sanitize(F.coalesce(F.nullif(message, F.lit("")), raw))
    parts = F.concat_ws(" ", own, fields)
    as_json = F.when(F.col("fields").isNull(), sanitize(raw)).otherwise(parts)
    return F.when(F.col("format") == "json", as_json).when(F.col("format").isin("bracketed", "logfmt", "xml") & (parts != ""), parts).otherwise(plain)


def text_line(df: DataFrame, level: str = "eff_level", names: FieldNames = DEFAULT_NAMES) -> Column:
    """``[time] [LEVEL] [logger] details`` of an entry; the logger of JSON entries only."""
    logger = F.when((F.col("format") == "json") & (F.col("logger") != ""), F.concat(F.lit("["), sanitize(F.col("logger")), F.lit("]")))
    time = F.when(F.col("ts_ns").isNotNull(), F.concat(F.lit("["), display_time(F.col("ts_ns")), F.lit("]")))
    return F.concat_ws(" ", time, F.concat(F.lit("["), level_name(F.col(level)), F.lit("]")), logger, details(df, names))


def _own(df: DataFrame, level: str) -> dict[str, Column]:
    raw = F.col("raw_line") if "raw_line" in df.columns else F.lit(None).cast("string")
    return {"level": F.col(level), "message": F.col("message"), "raw_line": raw, "logger": F.col("logger"), "fields": F.col("fields"), "ts_ns": F.col("ts_ns")}


def _values(text: str | None, keys: tuple[str, ...], as_json: bool) -> list[str | None]:
    if text is None:
        return [None] * len(keys)
    found = map(Bag(_bag(text)).get, keys)
    return [None if v is MISSING else json_text(_safe_values(v)) if as_json else shown_value(v) for v in found]


def _typed_values(keys: tuple[str, ...], as_json: bool):
    """Values of fields with their types, in order of ``keys``."""

    @F.arrow_udf("array<string>")
    def values(bags: pa.Array) -> pa.Array:
        return pa.array([_values(bag, keys, as_json) for bag in bags.to_pylist()], pa.list_(pa.string()))

    return values


def projected_text(df: DataFrame, keys: tuple[str, ...], level: str = "eff_level") -> Column:
    """``key=value`` of the keys that an entry has, in the order asked for; null if none."""
    own, parts = _own(df, level), []
    typed = _typed_values(keys, False)(F.col("fields_json")) if _typed(df) and any(key_kind(k) == STRUCTURED for k in keys) else None
    for i, key in enumerate(keys):
        kind, text = key_kind(key), resolve(key, **own)
        value = {LEVEL: text, TIME: display_time(F.col("ts_ns")), LOGGER: sanitize(text), MESSAGE: quoted(text)}.get(kind)
        if value is None:
            value = quoted(text) if typed is None else F.coalesce(F.get(typed, F.lit(i)), quoted(text))
        parts.append(F.concat(F.lit(sanitized(key) + "="), value))
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def _json_string(text: Column) -> Column:
    """A text as a JSON string, with the signs of HTML spelt out."""
    inside = F.to_json(F.struct(text.alias("v")))
    plain = F.when(text.isNotNull(), F.substr(inside, F.lit(6), F.length(inside) - 6))
    for sign, spelt in (("<", r"\\u003c"), (">", r"\\u003e"), ("&", r"\\u0026")):
        plain = F.regexp_replace(plain, sign, spelt)
    return plain


def projected_json(df: DataFrame, keys: tuple[str, ...], level: str = "eff_level") -> Column:
    """A flat JSON object of the keys that an entry has, keys sorted; null if none."""
    own, parts = _own(df, level), []
    ordered = tuple(sorted(dict.fromkeys(keys), key=lambda k: k.encode()))
    typed = _typed_values(ordered, True)(F.col("fields_json")) if _typed(df) and any(key_kind(k) in (STRUCTURED, LOGGER) for k in ordered) else None
    for i, key in enumerate(ordered):
        value = _json_string(sanitize(resolve(key, **own)))
        if typed is not None and key_kind(key) in (STRUCTURED, LOGGER):
            value = F.coalesce(F.get(typed, F.lit(i)), value)
        parts.append(F.concat(F.lit(json.dumps(sanitized(key), ensure_ascii=False) + ":"), value))
    inner = F.concat_ws(",", *parts)
    return F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}")))


def ndjson_line(df: DataFrame, level: str = "eff_level", names: FieldNames = DEFAULT_NAMES) -> Column:
    """An entry as one JSON object: time, level, logger, message, format, fields; what is
    empty is left out."""
    raw = F.col("raw_line") if "raw_line" in df.columns else F.lit("")
    message = F.nullif(F.coalesce(F.nullif("message", F.lit("")), raw), F.lit(""))
    extra = sorted_pairs(extra_fields(F.col("fields"), names))
    bag = F.array_join(F.transform(extra, lambda p: F.concat(_json_string(sanitize(p["key"])), F.lit(":"), _json_string(sanitize(p["value"])))), ",")
    bag = F.when(F.size(extra) > 0, F.concat(F.lit("{"), bag, F.lit("}")))
    if _typed(df):
        typed = _bag_udf(names, True)(F.when(F.col("format") == "json", F.col("fields_json")), F.lit(None).cast("string"))
        bag = F.when(F.col("format") == "json", typed).otherwise(bag)
    parts = [
        F.concat(F.lit('"time":'), _json_string(rfc3339(F.col("ts_ns")))),
        F.concat(F.lit('"level":'), _json_string(level_name(F.col(level)))),
        F.concat(F.lit('"logger":'), _json_string(sanitize(F.nullif("logger", F.lit(""))))),
        F.concat(F.lit('"message":'), _json_string(sanitize(message))),
        F.concat(F.lit('"format":'), _json_string(F.col("format"))),
        F.concat(F.lit('"fields":'), bag),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def render(kept: DataFrame, options: QueryOptions, level: str = "eff_level") -> DataFrame:
    """``kept`` with its ``line``; rows for which a projection finds nothing are dropped."""
    if options.output == "json":
        line = projected_json(kept, options.project, level) if options.project else ndjson_line(kept, level, options.names)
    else:
        line = projected_text(kept, options.project, level) if options.project else text_line(kept, level, options.names)
    if options.highlight and options.include and options.output == "text":
        line = highlight(line, options.include)
    return kept.withColumn("line", line).where(F.col("line").isNotNull())


# Switching reverse video on and off, and codes of the themes' colors.
_ON, _OFF, _RESET = "\x1b[7m", "\x1b[27m", "\x1b[0m"
_DARK = {"TRACE": "90", "DEBUG": "36", "INFO": "32", "WARN": "33", "ERROR": "31", "FATAL": "37;41;1", "timestamp": "34", "logger": "35", "key": "36", "value": "37", "quote": "90", "error": "31;1"}
THEMES = {"dark": _DARK, "light": _DARK | {"DEBUG": "34", "key": "34", "value": "30"}}
PREFIX_COLORS = ("96", "92", "93", "95", "94", "91")
_ESCAPE = re.compile("\x1b\\[[0-?]*[ -/]*[@-~]")


def theme(name: str) -> dict[str, str]:
    """Colors of a theme; ValueError for an unknown one."""
    low = name.strip().lower()
    if low not in ("", "auto", *THEMES):
        raise ValueError(f"unknown theme {name!r} (valid: dark, light)")
    return THEMES["light" if low == "light" else "dark"]


def color_mode(name: str) -> str:
    """``auto``, ``always`` or ``never``; ValueError for other words."""
    for mode, words in (("auto", ("", "auto")), ("always", ("always", "force", "on", "true")), ("never", ("never", "off", "false", "none"))):
        if name.strip().lower() in words:
            return mode
    raise ValueError(f"unknown color mode {name!r} (valid: auto, always, never)")


def painted(col: Column, code: str) -> Column:
    """A text in a color; null stays null."""
    return F.concat(F.lit(f"\x1b[{code}m"), col, F.lit(_RESET))


def colored_line(df: DataFrame, level: str = "eff_level", names: FieldNames = DEFAULT_NAMES, theme_name: str = "dark") -> Column:
    """``text_line`` with time, level, logger and alarming details in colors."""
    colors, shown = theme(theme_name), details(df, names)
    label = F.concat(F.lit("["), level_name(F.col(level)), F.lit("]"))
    code = F.element_at(F.create_map(*[F.lit(x) for n in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL") for x in (n, colors[n])]), level_name(F.col(level)))
    by_level = F.concat(F.lit("\x1b["), code, F.lit("m"), label, F.lit(_RESET))
    time = F.when(F.col("ts_ns").isNotNull(), painted(F.concat(F.lit("["), display_time(F.col("ts_ns")), F.lit("]")), colors["timestamp"]))
    logger = F.when((F.col("format") == "json") & (F.col("logger") != ""), painted(F.concat(F.lit("["), sanitize(F.col("logger")), F.lit("]")), colors["logger"]))
    alarming = (level_name(F.col(level)) == "ERROR") | needs_attention(F.col("message"))
    return F.concat_ws(" ", time, by_level, logger, F.when(alarming, painted(shown, colors["error"])).otherwise(shown))


def highlighted(text: str, patterns: list[re.Pattern]) -> str:
    """A text with all matches of the patterns in reverse video; escape sequences are no
    part of what is matched, and overlapping or touching matches become one."""
    at, plain, starts = 0, [], []
    for found in [*_ESCAPE.finditer(text), None]:
        stop = found.start() if found else len(text)
        starts += range(at, stop)
        plain.append(text[at:stop])
        at = found.end() if found else stop
    shown = "".join(plain)
    marks = sorted((starts[m.start()], starts[m.end() - 1] + 1) for p in patterns for m in p.finditer(shown) if m.end() > m.start())
    merged: list[list[int]] = []
    for a, b in marks:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], _ON, text[a:b], _OFF]
        at = b
    return "".join(out) + text[at:]


def highlight(col: Column, patterns: tuple[str, ...]) -> Column:
    """A line with matches in reverse video (display only)."""

    @F.arrow_udf("string")
    def marked(lines: pa.Array) -> pa.Array:
        ready = [re.compile(p) for p in patterns]
        return pa.array([None if x is None else highlighted(x, ready) for x in lines.to_pylist()], pa.string())

    return marked(col)
