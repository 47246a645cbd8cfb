"""The queries of ``core`` as SQL for DuckDB, written from the semantics, not from the Columns.

Raw lines are parsed again here with RE2 patterns; small builders spell out what SQL has to
repeat, such as the level of a word or the instant of a text.
"""

from __future__ import annotations

from logloom.functions.names import HTTP_CONTEXT, HTTP_STATUS, JSON_LEVEL, JSON_MESSAGE, JSON_TIME
from logloom.operators.cluster import MAX_EVENTS
from logloom.plans.core import NOW_NS

WS = r"[\t\n\f\r ]"
NAMES = "['TRACE','DEBUG','INFO','WARN','ERROR','FATAL']"


def level(x: str) -> str:
    """Level of a word or number."""
    t = f"trim({x}, ' ' || chr(9) || chr(13))"
    n = f"try_cast({t} AS BIGINT)"
    by_number = (
        f"CASE WHEN {n} = 0 THEN 2 WHEN {n} = 1 THEN 3 WHEN {n} = 2 THEN 4 WHEN {n} < 10 THEN 1 WHEN {n} < 20 THEN 0 WHEN {n} < 30 THEN 1 "
        f"WHEN {n} < 40 THEN 2 WHEN {n} < 50 THEN 3 WHEN {n} < 60 THEN 4 ELSE 5 END"
    )
    u = f"upper({t})"
    return (
        f"CASE WHEN regexp_matches({t}, '^[+-]?[0-9]+$') THEN {by_number} WHEN {u} IN ('TRACE','VERBOSE','FINEST') THEN 0 WHEN starts_with({u}, 'DEBUG') OR {u} = 'FINE' THEN 1 "
        f"WHEN starts_with({u}, 'INFO') OR {u} = 'NOTICE' THEN 2 WHEN starts_with({u}, 'WARN') THEN 3 WHEN {u} IN ('FATAL','PANIC') THEN 5 "
        f"WHEN starts_with({u}, 'ERR') OR {u} IN ('CRITICAL','CRIT') THEN 4 END"
    )


def name(x: str) -> str:
    """Name of a level."""
    return f"{NAMES}[{x} + 1]"


def instant(x: str) -> str:
    """Nanoseconds of a text in a layout of log lines."""
    months = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
    unix = rf"regexp_matches({x}, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) [A-Z][a-z][a-z]  ?[0-9]{{1,2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?( [A-Z]{{3,4}})? [0-9]{{4}}$')"
    iso = rf"regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$')"
    blank = rf"regexp_matches({x}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}) [0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}}([.,][0-9]+)?$')"
    month = f"lpad(list_position({months}, substr({x}, 5, 3))::VARCHAR, 2, '0')"
    day = f"CASE WHEN {unix} THEN right({x}, 4) || '-' || {month} || '-' || lpad(trim(substr({x}, 9, 2)), 2, '0') ELSE replace(substr({x}, 1, 10), '/', '-') END"
    hms = rf"regexp_extract({x}, '[T ]([0-9]{{1,2}}:[0-9]{{2}}:[0-9]{{2}})', 1)"
    hour_ok = f"try_cast(split_part({hms}, ':', 1) AS INT) < 24"
    seconds = f"epoch(try_cast(({day}) || ' ' || lpad({hms}, 8, '0') AS TIMESTAMP))::BIGINT"
    digits = rf"rpad(substr(regexp_extract({x}, ':[0-9]{{2}}[.,]([0-9]+)', 1), 1, 9), 9, '0')::BIGINT"
    zone = rf"regexp_extract({x}, 'T[^+-]*([+-][0-9]{{2}}):?([0-9]{{2}})$', "
    offset = f"CASE WHEN {iso} AND {zone}1) <> '' THEN {zone}1)::INT * 3600 + CASE WHEN starts_with({zone}1), '-') THEN -1 ELSE 1 END * {zone}2)::INT * 60 ELSE 0 END"
    return f"CASE WHEN ({iso} OR {blank} OR {unix}) AND {hour_ok} AND {seconds} BETWEEN -9214560000 AND 9214646399 THEN ({seconds} - ({offset})) * 1000000000 + {digits} END"


def epoch(x: str) -> str:
    """Nanoseconds of an epoch number."""
    whole = f"CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+$') THEN try_cast(trim({x}) AS BIGINT) END"
    number = rf"CASE WHEN regexp_matches(trim({x}), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') AND abs(try_cast(trim({x}) AS DOUBLE)) < 9.2e18 THEN trunc(try_cast(trim({x}) AS DOUBLE))::BIGINT END"
    n = f"coalesce({whole}, {number})"
    scaled = f"{n}::HUGEINT * CASE WHEN {n} >= 1000000000000000000 THEN 1 WHEN {n} >= 1000000000000000 THEN 1000 WHEN {n} >= 100000000000 THEN 1000000 ELSE 1000000000 END"
    return f"CASE WHEN {n} > -9223372036 THEN try_cast({scaled} AS BIGINT) END"


def shown(ns: str, sep: str = " ", end: str = "") -> str:
    """A time to whole seconds."""
    return f"strftime(make_timestamp(CAST(floor({ns} / 1000000000::DECIMAL(20,0)) AS BIGINT) * 1000000), '%Y-%m-%d{sep}%H:%M:%S{end}')"


def safe(x: str) -> str:
    """Sanitized text: of the unsafe characters those that occur in the tables."""
    for code in (*range(9), *range(10, 32), 127, *range(128, 160), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x2028, 0x2029, 0xFEFF):
        if code in (7, 8, 10, 13, 27, 0x85, 0x200B, 0x2028, 0xFEFF):
            x = f"replace({x}, chr({code}), '\\{'x' if code < 256 else 'u'}{code:0{2 if code < 256 else 4}X}')"
    return x


def quoted(x: str) -> str:
    """A value in quotes where it could be misread."""
    return f"""CASE WHEN {x} = '' THEN '""' WHEN regexp_matches({x}, '[ =,"''\\[\\]{{}}()]') THEN '"' || {x} || '"' ELSE {x} END"""


def json_string(x: str) -> str:
    """A text as a JSON string."""
    return f"""replace(replace(replace(to_json({x})::VARCHAR, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"""


LINES = r"lines AS (SELECT DISTINCT stream_id, line_no, regexp_replace(raw, '\r$', '') AS raw FROM log_lines)"
SOME = f"{LINES}, present AS (SELECT * FROM lines WHERE raw IS NOT NULL AND regexp_matches(raw, '[^\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))"
STAMP = r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
COLLECTOR = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z"
_PAIR = r'[A-Za-z0-9_.-]+=(?:"(?:[^"\\]|\\.)*"|[^" ][^ ]*|)'
LOGFMT = rf"^ *{_PAIR}(?: +{_PAIR})* *$"
BRACKETED = rf"^\[([^\]]+)\]{WS}+\[([^\]]+)\]{WS}+\[([^\]]+)\]{WS}*(.*)$"
KLOG = rf"^([IWEF])[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\.[0-9]+{WS}+[0-9]+{WS}+\S+:[0-9]+\]{WS}?(.*)$"
ACCESS = rf'"(?:GET|HEAD|POST|PUT|DELETE|PATCH|OPTIONS|CONNECT|TRACE) [^"]*HTTP/[0-9.]+"{WS}+([0-9]{{3}})\b'
XML = rf'^<([A-Za-z][\w.-]*)((?:{WS}+[\w.:-]+="[^"]*")*){WS}*(?:/>|>(.*)</([A-Za-z][\w.-]*)>)$'
_item = r'[A-Za-z@_.-]+: *(?:"(?:[^"\\]|\\.)*"|[^",{}\[\]]*)'
YAML = rf"^\s*\{{ *{_item}(?:, *{_item})*\}}\s*$"
LEAD = r"^[\t\n\f\r \[]*"
LEAD_TIME = LEAD + rf"(?:(?i:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\]?{WS}+\[?)?({STAMP})(?:[\t\n\f\r \]:]|$)"
LEAD_LEVEL = LEAD + rf"(?:{STAMP}(?:[\t\n\f\r \]:]|$))?[\t\n\f\r \]\[]*((?i:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL))(?:[\t\n\f\r \]:]|$)"
ANY_LEVEL = r"(?:^|[^A-Za-z0-9_])((?i:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL))(?:[^A-Za-z0-9_]|$)"


def _json(key: str, x: str = "p") -> str:
    return f"""json_extract_string({x}, '$."{key}"')"""


def _attribute(key: str) -> str:
    return f"""CASE WHEN regexp_matches(regexp_extract(p, '{XML}', 2), '[\\t\\n\\f\\r ]{key}="') THEN regexp_extract(regexp_extract(p, '{XML}', 2), '[\\t\\n\\f\\r ]{key}="([^"]*)"', 1) END"""


def _pair(key: str) -> str:
    found = rf"(?:^| ){key.replace('.', '[.]')}=(?:\"((?:[^\"\\]|\\.)*)\"|([^\" ][^ ]*|))"
    value = rf"regexp_replace(regexp_extract(p, '{found}', 1), '\\([\\\"])', '\1', 'g') || regexp_extract(p, '{found}', 2)".replace(r"\"", '"')
    return rf"CASE WHEN regexp_matches(p, '(?:^| ){key.replace('.', '[.]')}=') THEN {value} END"


def _yaml(key: str) -> str:
    return rf"""CASE WHEN regexp_matches(p, '[{{,] *{key}: ') THEN CASE WHEN regexp_matches(p, '[{{,] *{key}: "') THEN regexp_replace(regexp_extract(p, '[{{,] *{key}: "((?:[^"\\]|\\.)*)"', 1), '\\(.)', '\1', 'g') ELSE trim(regexp_extract(p, '[{{,] *{key}: ([^,}}"]*)', 1)) END END"""


# What each line is, in order of detection. p is the line behind a collector's time.
PARSED = rf"""{SOME},
cut AS (SELECT *, CASE WHEN regexp_matches(raw, '^{COLLECTOR}{WS}') THEN regexp_extract(raw, '^({COLLECTOR})', 1) END AS stamp,
  regexp_replace(raw, '^{COLLECTOR}{WS}+', '') AS p FROM present),
kinds AS (SELECT *, trim(p, ' ' || chr(9)) AS t, CASE
  WHEN regexp_matches(p, '^\s*\{{.*\}}\s*$') AND json_valid(p) THEN 'json'
  WHEN regexp_matches(p, '^\s*\{{.*\}}\s*$') AND regexp_matches(p, '[{{,] *(level|severity|message|msg|log|text|body): ') AND regexp_matches(p, '{YAML}') THEN 'yaml'
  WHEN regexp_matches(p, '{BRACKETED}') AND {level(f"regexp_extract(p, '{BRACKETED}', 2)")} IS NOT NULL THEN 'bracketed'
  WHEN regexp_matches(p, '{LOGFMT}') THEN 'logfmt'
  WHEN regexp_matches(p, '{KLOG}') THEN 'klog'
  WHEN regexp_matches(p, '^<[0-9]{{1,3}}>') AND try_cast(regexp_extract(p, '^<([0-9]{{1,3}})>', 1) AS INT) <= 191 THEN 'syslog'
  WHEN regexp_matches(p, '{ACCESS}') AND try_cast(regexp_extract(p, '{ACCESS}', 1) AS INT) >= 100 THEN 'access'
  WHEN regexp_matches(p, '{XML}') AND (regexp_extract(p, '{XML}', 4) IN ('', regexp_extract(p, '{XML}', 1))) AND regexp_extract(p, '{XML}', 2) || trim(regexp_extract(p, '{XML}', 3)) <> '' THEN 'xml'
  WHEN regexp_matches(p, '^[^,"]*,') AND len(string_split(p, ',')) >= 3 AND {instant("trim(split_part(p, ',', 1))")} IS NOT NULL
    AND regexp_matches(p, '(?i),\s*(TRACE|VERBOSE|FINEST|DEBUG|FINE|INFO|INFORMATION|NOTICE|WARN|WARNING|ERROR|ERR|CRITICAL|CRIT|FATAL|PANIC)\s*(,|$)') THEN 'csv'
  ELSE 'plain' END AS kind FROM cut)"""


def _statused(get) -> str:
    status = f"try_cast(coalesce({', '.join(get(k) for k in HTTP_STATUS)}) AS INT)"
    context = " OR ".join(f"{get(k)} IS NOT NULL" for k in HTTP_CONTEXT)
    return f"CASE WHEN {context} THEN CASE WHEN {status} >= 500 THEN 4 WHEN {status} >= 400 THEN 3 WHEN {status} >= 100 THEN 1 END END"


def _first(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


_jkeys = [k for k in JSON_LEVEL if k != "LEVEL"]
_json_level = _first(*[level(_json(k)) for k in _jkeys], _statused(_json))
_json_time = _first(*[f"coalesce({instant(_json(k))}, {epoch(_json(k))})" for k in JSON_TIME[:4]])
_json_message = _first(*[f"nullif({_json(k)}, '')" for k in JSON_MESSAGE], "nullif(json_extract_string(p, '$.error'), '')", "t")
_json_logger = f"CASE WHEN {_first(*[_json(k) for k in ('logger', 'component', 'source')])} IS NOT NULL THEN {_first(*[_json(k) for k in ('logger', 'component', 'source')])} WHEN {_json('log.level')} IS NOT NULL THEN 'winston' WHEN {_json('level')} IS NOT NULL AND {_json('msg')} IS NOT NULL THEN 'logrus' ELSE '' END"
_csv_level = "regexp_extract(p, '(?i),\\s*(TRACE|VERBOSE|FINEST|DEBUG|FINE|INFO|INFORMATION|NOTICE|WARN|WARNING|ERROR|ERR|CRITICAL|CRIT|FATAL|PANIC)\\s*(,|$)', 1)"
# CSV rows here are time, level, source, message, the message in quotes where it needs them.
_csv_rest = r"""regexp_extract(p, '^[^,]*,[^,]*,([^,]*),', 1) || ', ' || CASE WHEN regexp_matches(p, '^[^,]*,[^,]*,[^,]*,"') THEN replace(regexp_extract(p, '^[^,]*,[^,]*,[^,]*,"(.*)"$', 1), '""', '"') ELSE replace(regexp_extract(p, '^[^,]*,[^,]*,[^,]*,(.*)$', 1), ',', ', ') END"""
_lead_level = f"CASE WHEN regexp_matches(p, '{LEAD_LEVEL}') THEN regexp_extract(p, '{LEAD_LEVEL}', 1) WHEN regexp_matches(p, '{ANY_LEVEL}') THEN regexp_extract(p, '{ANY_LEVEL}', 1) END"
_fields_end = r"(?: +[A-Za-z0-9_.-]+=[^ ]+)+$"
_bracket_rest = f"regexp_extract(p, '{BRACKETED}', 4)"


def entries_sql() -> str:
    """level (null if none), message, logger, ts_ns of each line by kind."""
    levels = {
        "json": _json_level,
        "yaml": level(_yaml("level")),
        "bracketed": level(f"regexp_extract(p, '{BRACKETED}', 2)"),
        "logfmt": level(_first(*[_pair(k) for k in ("level", "severity", "log_level", "lvl")])),
        "klog": "CASE p[1] WHEN 'I' THEN 2 WHEN 'W' THEN 3 WHEN 'E' THEN 4 ELSE 5 END",
        "syslog": "[4,4,4,4,3,2,2,1][regexp_extract(p, '^<([0-9]{1,3})>', 1)::INT % 8 + 1]",
        "access": f"CASE regexp_extract(p, '{ACCESS}', 1)[1] WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '3' THEN 1 WHEN '4' THEN 3 ELSE 4 END",
        "xml": _first(*[level(_attribute(k)) for k in ("level", "severity")]),
        "csv": level(_csv_level),
        "plain": level("word"),
    }
    said = r"trim(p, ' ' || chr(9))"
    strip = lambda x, w: f"CASE WHEN {w} IS NULL THEN {x} WHEN starts_with(ltrim({x}, ' ' || chr(9)), '[' || {w} || ']') THEN ltrim(substr(ltrim({x}, ' ' || chr(9)), length({w}) + 3), ' ' || chr(9)) WHEN starts_with(ltrim({x}, ' ' || chr(9)), {w}) AND (substr(ltrim({x}, ' ' || chr(9)), length({w}) + 1, 1) IN ('', ' ', chr(9))) THEN ltrim(substr(ltrim({x}, ' ' || chr(9)), length({w}) + 1), ' ' || chr(9)) ELSE {x} END"
    messages = {
        "json": _json_message,
        "yaml": _first(*[f"nullif({_yaml(k)}, '')" for k in ("message", "msg")], "t"),
        "bracketed": f"CASE WHEN regexp_matches({_bracket_rest}, '{_fields_end}') THEN regexp_replace(regexp_replace({_bracket_rest}, '{_fields_end}', ''), '\\s+', ' ', 'g') ELSE trim({_bracket_rest}) END",
        "logfmt": _first(*[_pair(k) for k in ("msg", "message", "log")], "p"),
        "klog": f"regexp_extract(p, '{KLOG}', 2)",
        "syslog": "trim(regexp_replace(p, '^<[0-9]{1,3}>', ''))",
        "access": "p",
        "xml": f"coalesce(nullif(trim(regexp_extract(p, '{XML}', 3)), ''), {_attribute('message')}, {_attribute('msg')}, p)",
        "csv": _csv_rest,
        "plain": f"coalesce(nullif(trim(s4, ' ' || chr(9)), ''), {said})",
    }
    loggers = {
        "json": _json_logger,
        "yaml": f"coalesce({_first(*[_yaml(k) for k in ('logger', 'component', 'source')])}, CASE WHEN {_yaml('level')} IS NOT NULL AND {_yaml('msg')} IS NOT NULL THEN 'logrus' ELSE '' END)",
        "bracketed": f"regexp_extract(p, '{BRACKETED}', 3)",
        "logfmt": _first(*[_pair(k) for k in ("component", "logger", "logger_name", "source")], "''"),
        "xml": _first(*[_attribute(k) for k in ("logger", "name", "source", "category")], "''"),
    }
    times = {
        "json": _json_time,
        "yaml": _first(*[f"coalesce({epoch(_yaml(k))}, {instant(_yaml(k))})" for k in ("time", "timestamp", "ts")]),
        "bracketed": instant(f"regexp_extract(p, '{BRACKETED}', 1)"),
        "logfmt": instant(_first(*[_pair(k) for k in ("time", "timestamp", "ts")])),
        "xml": instant(_first(*[_attribute(k) for k in ("time", "timestamp", "ts", "date")])),
        "csv": instant("trim(split_part(p, ',', 1))"),
        "plain": instant("head"),
    }
    case = lambda by, other: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in by.items()) + f" ELSE {other} END"
    return rf"""WITH {PARSED},
heads AS (SELECT *, CASE WHEN kind = 'plain' AND regexp_matches(p, '{LEAD_TIME}') THEN regexp_extract(p, '{LEAD_TIME}', 1) END AS head, CASE WHEN kind = 'plain' THEN {_lead_level} END AS word FROM kinds),
s1 AS (SELECT *, {strip("p", "head")} AS s1 FROM heads), s2 AS (SELECT *, {strip("s1", "word")} AS s2 FROM s1), s3 AS (SELECT *, {strip("s2", "head")} AS s3 FROM s2), s4 AS (SELECT *, {strip("s3", "word")} AS s4 FROM s3),
read AS (SELECT stream_id, line_no, raw, p, stamp, kind, {case(levels, "NULL")} AS found, {case(messages, "p")} AS message, {case(loggers, "''")} AS logger,
  CASE WHEN stamp IS NOT NULL THEN {instant("stamp")} ELSE {case(times, "NULL")} END AS ts_ns FROM s4),
entry AS (SELECT *, coalesce(found, 1)::INT AS level, found IS NOT NULL AS level_detected, CASE WHEN kind IN ('json', 'yaml') THEN 'json' WHEN kind IN ('bracketed', 'logfmt', 'xml') THEN kind ELSE 'text' END AS format FROM read)"""


ENTRIES = entries_sql()
_SHOWN = "SELECT stream_id, line_no, level, level_detected, message, logger, ts_ns FROM entry WHERE kind = "
SQL: dict[str, str] = {f"b{n}_{title}": f"{ENTRIES} {_SHOWN}'{kind}'" for n, title, kind in ((2, "json", "json"), (3, "yaml_flow", "yaml"), (4, "bracketed", "bracketed"), (5, "logfmt", "logfmt"), (6, "klog", "klog"), (7, "syslog", "syslog"), (8, "access", "access"), (9, "xml", "xml"), (10, "csv", "csv"), (11, "plain", "plain"))}

# Groups: what continues, and the state along a stream.
BOUNDARY = r"(?i)^(?:Traceback \(most recent call last\):|goroutine \d+|Caused by:|\(?[\w./*-]+\.\w+\(.*\)|[\w.$]*?(?:Error|Exception|Panic)\b[\t\n\f\r ]*:)"
_w = "(PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
GROUPS = rf"""{ENTRIES}, tested AS (SELECT *, regexp_replace(raw, '^{COLLECTOR} ', '') AS q FROM entry),
parents AS (SELECT *, last_value(found IGNORE NULLS) OVER {_w} AS parent FROM tested),
grouped AS (SELECT *, found IS NULL AND parent IS NOT NULL AND (regexp_matches(q, '^[ \t]') OR regexp_matches(q, '{BOUNDARY}')) AS is_cont FROM parents),
lvl AS (SELECT *, CASE WHEN is_cont THEN parent ELSE level END::INT AS eff_level FROM grouped)"""


def _kept(floor: int, line: str = "true", where: str = "true", include: bool = False) -> str:
    join = "(line_ok AND where_a) OR kept_a" if include else "(line_ok AND where_a) AND kept_a"
    return rf"""{GROUPS}, ok AS (SELECT *, ({line}) AS line_ok, ({where}) AS where_ok FROM lvl),
state AS (SELECT *, last_value(CASE WHEN NOT is_cont AND eff_level >= {floor} THEN where_ok END IGNORE NULLS) OVER {_w} AS where_a,
  last_value(CASE WHEN NOT is_cont THEN eff_level >= {floor} AND line_ok AND where_ok END IGNORE NULLS) OVER {_w} AS kept_a FROM ok),
kept AS (SELECT * FROM state WHERE eff_level >= {floor} AND CASE WHEN is_cont THEN {join} ELSE kept_a END)"""


_OUT = " SELECT stream_id, line_no, eff_level, is_cont FROM "
_m = lambda *p: "(" + " OR ".join(f"regexp_matches(raw, '{x}')" for x in p) + ")"
_tail = ", numbered AS (SELECT *, sum(CASE WHEN is_cont THEN 0 ELSE 1 END) OVER " + _w + " AS g FROM kept), last AS (SELECT *, max(g) OVER (PARTITION BY stream_id) AS tot FROM numbered)"
_three = ("amber", r"timed out after \d+", "RelayHub")
SQL |= {
    "b1_collector_time": f"{ENTRIES} SELECT stream_id, line_no, ts_ns FROM entry WHERE stamp IS NOT NULL",
    "b_formats": f"{ENTRIES} SELECT format, level, level_detected, count(*) AS n FROM entry GROUP BY ALL",
    "d10_logger": f"{ENTRIES} SELECT format, logger, count(*) AS n FROM entry WHERE format <> 'text' GROUP BY ALL",
    "e1_level_floor": _kept(3) + _OUT + "kept",
    "e2_grep": _kept(0, _m(*_three), include=True) + _OUT + "kept",
    "e3_exclude": _kept(0, "NOT " + _m(*_three)) + _OUT + "kept",
    "f1_groups": GROUPS + _OUT + "lvl",
    "f2_group_filter": _kept(2, _m("price", "Error:", "table") + " AND NOT " + _m("wharf", "opal"), "eff_level >= 4", True) + _OUT + "kept",
    "f2_group_where": _kept(1, "NOT " + _m("amber"), "eff_level >= 2 AND contains(LOGGER_OF, 'e')".replace("LOGGER_OF", "CASE WHEN kind = 'logfmt' AND logger = '' THEN '' ELSE logger END")) + _OUT + "kept",
    "f3_tail": _kept(2) + _tail + _OUT + "last WHERE g = 0 OR g > tot - 3",
    "f3_tail_filtered": _kept(3, _m("price|timed"), include=True) + _tail + _OUT + "last WHERE g = 0 OR g > tot - 2",
    "f4_tail_digest": _kept(0) + _tail + f" SELECT eff_level AS level, {name('eff_level')} AS level_name, count(*) AS n FROM last WHERE g = 0 OR g > tot - 5 GROUP BY 1, 2",
    "g6_digest_lines": GROUPS + f" SELECT eff_level AS level, {name('eff_level')} AS level_name, count(*) AS n FROM lvl GROUP BY 1, 2",
    "l1_follow": _kept(3, "NOT " + _m("amber")) + _OUT + "kept",
    "c7_leading_meta": f"{ENTRIES} SELECT stream_id, line_no, message, ts_ns FROM entry WHERE kind = 'plain' AND regexp_matches(p, '^(?:[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} [0-9:]+ |(?i:debug|info|warn|warning|error|fatal|trace) [0-9]{{4}}-)')",
    "c6_trailing_fields": rf"""{ENTRIES}, tails AS (SELECT stream_id, line_no, message, string_split(trim(regexp_extract({_bracket_rest}, '({_fields_end})', 1)), ' ') AS words FROM entry WHERE kind = 'bracketed' AND regexp_matches({_bracket_rest}, '{_fields_end}')),
      each AS (SELECT stream_id, line_no, message, unnest(words) AS word FROM tails) SELECT stream_id, line_no, message, split_part(word, '=', 1) AS key, trim(substr(word, strpos(word, '=') + 1), '"') AS value FROM each WHERE word <> ''""",
}

E = "e AS (SELECT DISTINCT stream_id, line_no, level, level_name, message, format, logger, fields, ts_ns FROM entries)"
SHARD = "fields['shard']"
_streams = "SELECT s.stream_id, s.namespace, s.pod, s.container FROM streams s JOIN (SELECT DISTINCT namespace, pod FROM pods WHERE SELECTED) USING (namespace, pod) WHERE coalesce(s.instance, 'current') = 'current'"
_SELECTED = "coalesce(labels['tier'], '') IN ('edge', 'core') AND coalesce(labels['app'], '') <> 'quota'"
CHOSEN = f"chosen AS ({_streams.replace('SELECTED', _SELECTED)}), labelled AS (SELECT stream_id, namespace || '/' || pod || CASE WHEN count(*) OVER (PARTITION BY namespace, pod) > 1 THEN '/' || container ELSE '' END AS label FROM chosen)"
RANK = "CASE coalesce(kind, '') WHEN '' THEN 0 WHEN 'init' THEN 1 WHEN 'ephemeral' THEN 2 ELSE 3 END"
STATE = "CASE WHEN state.running THEN 'Running' WHEN state.waiting IS NOT NULL THEN 'Waiting' || CASE WHEN coalesce(state.waiting.reason, '') = '' THEN '' ELSE ' (' || state.waiting.reason || ')' END WHEN state.terminated IS NOT NULL THEN 'Terminated' || CASE WHEN coalesce(state.terminated.reason, '') = '' THEN '' ELSE ' (' || state.terminated.reason || ')' END ELSE 'Unknown' END"
EVENTS = "ev AS (SELECT DISTINCT * FROM pod_events)"
PODS_EVENTS = f"{EVENTS}, own AS (SELECT ev.* FROM ev WHERE coalesce(object_kind, '') IN ('', 'Pod') AND EXISTS (SELECT 1 FROM pods p WHERE p.namespace = ev.namespace AND p.pod = ev.object_name)), ranked AS (SELECT *, row_number() OVER (PARTITION BY namespace, object_name ORDER BY pos, event_id) AS place, count(*) OVER (PARTITION BY namespace, object_name) AS n_all FROM own)"
EVENT_US = "epoch_us(coalesce(event_time, last_ts, first_ts, created_ts))"
REASON = "coalesce(nullif(reason, ''), 'Event')"
EVENT_N = "CASE WHEN series_count > 0 THEN series_count ELSE coalesce(count, 0) END"
EVENT_TEXT = f"coalesce(nullif(regexp_replace(message, '^\\s+|\\s+$', '', 'g'), ''), {REASON})"
EVENT_LINE = (
    f"'[' || {shown(f'({EVENT_US} * 1000)')} || '] [EVENT] [' || coalesce(nullif(type, ''), 'Normal') || ']' || CASE WHEN coalesce(object_kind, '') || coalesce(object_name, '') = '' THEN '' ELSE ' ' || lower(coalesce(object_kind, '')) || CASE WHEN coalesce(object_kind, '') <> '' AND coalesce(object_name, '') <> '' THEN '/' ELSE '' END || coalesce(object_name, '') END"
    f" || ' ' || {REASON} || ': ' || {EVENT_TEXT} || CASE WHEN {EVENT_N} > 1 THEN ' (x' || ({EVENT_N}) || ')' ELSE '' END"
)
FIELDS_TEXT = f"coalesce(CASE WHEN {SHARD} IS NOT NULL THEN 'shard=' || {quoted(SHARD)} END, '')"
DETAILS = f"CASE WHEN format = 'json' THEN CASE WHEN fields IS NULL THEN '' ELSE concat_ws(' ', nullif({safe('message')}, ''), nullif({FIELDS_TEXT}, '')) END WHEN format IN ('bracketed', 'logfmt', 'xml') AND concat_ws(' ', nullif(message, ''), nullif({FIELDS_TEXT}, '')) <> '' THEN concat_ws(' ', nullif({safe('message')}, ''), nullif({FIELDS_TEXT}, '')) ELSE coalesce({safe('message')}, '') END"
BLANK = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LOG_LINE = f"coalesce('[' || {shown('ts_ns')} || ']', '[no timestamp]') || ' [LOG] [' || {name('level')} || '] ' || CASE WHEN regexp_replace({DETAILS}, '{BLANK}', '', 'g') <> '' THEN {DETAILS} ELSE coalesce({safe('message')}, '') END"
_ended = lambda st, prev: f"SELECT namespace, pod, name, {RANK} AS kind_rank, {prev} AS previous, unnest([{st}.terminated], max_depth := 1) AS t FROM container_statuses WHERE {st}.terminated IS NOT NULL"
TERMS = f"terms AS ({_ended('last_state', 'true')} UNION ALL {_ended('state', 'false')})"
TERM_LINE = f"""coalesce('[' || {shown('(epoch_us(t.finished_at) * 1000)')} || ']', '[no timestamp]') || ' [TERM]' || CASE WHEN previous THEN ' (previous)' ELSE '' END || ' container "' || name || '" exited with code ' || coalesce(t.exit_code, 0) || CASE WHEN coalesce(t.signal, 0) <> 0 THEN ' (signal ' || t.signal || ')' ELSE '' END || CASE WHEN coalesce(t.reason, '') <> '' THEN ' — ' || t.reason ELSE '' END || CASE WHEN trim(coalesce(t.message, '')) <> '' THEN ': ' || trim(t.message) ELSE '' END"""
TEMPLATE = rf"regexp_replace(regexp_replace(regexp_replace(message, '^{BLANK}+|{BLANK}+$', '', 'g'), '\b[0-9a-fA-F]{{8,}}\b', '#', 'g'), '[0-9]+', '#', 'g')"
_where = lambda test: f"WITH {E} SELECT stream_id, line_no FROM e WHERE {test}"
_n_shard = f"try_cast({SHARD} AS DOUBLE)"
SQL |= {
    "a1_text_files": "WITH l AS (SELECT DISTINCT stream_id, line_no, regexp_replace(raw, '\\r$', '') AS raw FROM log_lines WHERE raw IS NOT NULL) SELECT count(*) AS n_lines, sum(length(raw))::BIGINT AS n_chars FROM l",
    "a2_bounded_lines": f"WITH {LINES} SELECT stream_id, line_no, raw FROM lines",
    "a3_container_lines": f"WITH {LINES} SELECT stream_id, line_no FROM lines WHERE stream_id IN (SELECT stream_id FROM streams WHERE namespace = 'harbor' AND pod = 'gate-hotpath-0' AND container = 'app' AND coalesce(instance, 'current') = 'current')",
    "a5_previous_instances": "SELECT stream_id FROM streams s WHERE instance = 'previous' AND EXISTS (SELECT 1 FROM container_statuses c WHERE c.namespace = s.namespace AND c.pod = s.pod AND c.name = s.container AND c.restart_count > 0)",
    "a6_container_order": f"SELECT namespace, pod, coalesce(kind, '') AS kind, name, row_number() OVER (PARTITION BY namespace, pod ORDER BY {RANK}, pos)::INT AS place FROM container_statuses",
    "a7_selected_lines": f"WITH {LINES}, {CHOSEN} SELECT stream_id, label, count(*) AS n FROM lines JOIN labelled USING (stream_id) GROUP BY ALL",
    "a8_event_scan": f"WITH {PODS_EVENTS} SELECT event_id, namespace, object_name, n_all > {MAX_EVENTS} AS truncated FROM ranked WHERE place <= {MAX_EVENTS}",
    "a9_did_you_mean": "WITH w AS (SELECT DISTINCT namespace, left(pod, length(pod) - 1) || 'zz' AS wanted FROM pods), d AS (SELECT w.namespace, wanted, pod, levenshtein(wanted, pod) AS distance FROM w JOIN pods USING (namespace)) SELECT namespace, wanted, arg_min(pod, (distance, pod)) AS suggestion, min(distance)::INT AS distance FROM d WHERE distance < greatest(2, strlen(wanted) // 3) GROUP BY 1, 2",
    "a12_since": f"SELECT DISTINCT stream_id, line_no FROM log_lines WHERE epoch_us(ingest_ts) >= {NOW_NS // 1000 - (480 * 3600 + 1) * 1_000_000}",
    "a13_stamped_lines": "WITH l AS (SELECT DISTINCT stream_id, line_no, regexp_replace(raw, '\\r$', '') AS raw, epoch_us(ingest_ts) AS us FROM log_lines) SELECT stream_id, line_no, coalesce(strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((us % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z ' || raw, raw) AS raw FROM l",
    "c1_key_kinds": f"WITH {E} SELECT stream_id, line_no, {name('level')} AS as_level, nullif(message, '') AS as_message, nullif(logger, '') AS as_logger, {shown('ts_ns', 'T', 'Z')} AS as_time, {SHARD} AS as_field FROM e",
    "c2_field_lookup": f"WITH {E} SELECT stream_id, line_no, {SHARD} AS folded, fields['Shard'] AS exact, {SHARD} AS first_of FROM e",
    "c8_project_text": f"WITH {E} SELECT stream_id, line_no, concat_ws(' ', 'shard=' || {quoted(SHARD)}, 'logger=' || nullif(logger, '')) AS line FROM e WHERE {SHARD} IS NOT NULL OR nullif(logger, '') IS NOT NULL",
    "c8_project_text_all": f"WITH {E} SELECT stream_id, line_no, concat_ws(' ', 'level=' || {name('level')}, 'ts=' || {shown('ts_ns')}, 'shard=' || {quoted(SHARD)}, 'Logger=' || nullif(logger, ''), 'msg=' || {quoted(safe('nullif(message, {q}{q})'.format(q=chr(39))))}) AS line FROM e",
    "c9_project_json": f"""WITH {E} SELECT stream_id, line_no, '{{' || concat_ws(',', '"level":"' || {name('level')} || '"', '"logger":' || {json_string("nullif(logger, '')")}, '"shard":' || {json_string(SHARD)}) || '}}' AS line FROM e""",
    "d1_parse_level": f"WITH w AS (SELECT level_name AS word FROM (SELECT DISTINCT * EXCLUDE (ts, fields, is_cont) FROM entries) UNION ALL SELECT type FROM pod_events UNION ALL SELECT (user_id % 71)::VARCHAR FROM events) SELECT word, count(*) AS n, ({level('word')})::INT AS level, coalesce(upper(trim(word)) IN ('TRACE','VERBOSE','FINEST','DEBUG','FINE','INFO','INFORMATION','NOTICE','WARN','WARNING','ERROR','ERR','CRITICAL','CRIT','FATAL','PANIC'), false) AS is_word FROM w GROUP BY word",
    "d4_status_level": f"WITH {LINES}, s AS (SELECT try_cast(regexp_extract(raw, 'HTTP/[0-9.]+\" ([0-9]{{3}})', 1) AS INT) AS status FROM lines) SELECT status, count(*) AS n, CASE WHEN status >= 500 THEN 4 WHEN status >= 400 THEN 3 WHEN status >= 100 THEN 1 END::INT AS level, CASE WHEN status BETWEEN 100 AND 599 THEN status // 100 END::INT AS status_class, true AS is_request FROM s WHERE status IS NOT NULL GROUP BY status",
    "d8_parse_time": f"WITH j AS (SELECT DISTINCT rec_id, time FROM json_entries) SELECT rec_id, {instant('time')} AS layout_ns, coalesce(CASE WHEN regexp_matches(time, '^[0-9]{{8}}$') THEN epoch(try_cast(time[1:4] || '-' || time[5:6] || '-' || time[7:8] AS DATE))::BIGINT * 1000000000 END, {epoch('time')}, {instant('time')}) AS field_ns FROM j",
    "d9_epoch": f"WITH j AS (SELECT DISTINCT rec_id, stamp FROM timeline_items WHERE regexp_matches(stamp, '^[0-9]{{9,19}}$')) SELECT rec_id, {epoch('stamp')} AS ts_ns FROM j",
    "d11_template": f"WITH {E} SELECT stream_id, line_no, {TEMPLATE} AS template FROM e WHERE message IS NOT NULL",
    "d13_sanitize": f"WITH l AS (SELECT DISTINCT stream_id, line_no, raw FROM log_lines WHERE raw IS NOT NULL), s AS (SELECT stream_id, line_no, raw, {safe('raw')} AS safe FROM l) SELECT stream_id, line_no, safe, {quoted('safe')} AS shown, regexp_matches(lower(raw), 'error|failed|warn') AS attention FROM s",
    "d16_display_time": f"WITH {E} SELECT stream_id, line_no, {shown('ts_ns')} AS shown, {shown('ts_ns', 'T', 'Z')} AS machine FROM e",
    "d17_line_tests": f"WITH l AS (SELECT DISTINCT stream_id, line_no, raw, regexp_replace(raw, '^{COLLECTOR} ', '') AS q FROM log_lines) SELECT stream_id, line_no, coalesce(regexp_matches(q, '^[ \\t]'), false) AS indented, coalesce(regexp_matches(q, '{BOUNDARY}'), false) AS boundary, coalesce(regexp_full_match(raw, '{BLANK}*'), true) AS blank FROM l",
    "d20_edit_distance": "SELECT namespace, pod, levenshtein(pod, reverse(pod))::INT AS distance FROM pods",
    "d21_container_state": f"SELECT namespace, pod, name, {STATE} AS status FROM container_statuses",
    "d22_normal_events": f"WITH {EVENTS} SELECT event_id, {EVENT_US} AS ts_us, coalesce(nullif(type, ''), 'Normal') AS type, lower(coalesce(object_kind, '')) || CASE WHEN coalesce(object_kind, '') <> '' AND coalesce(object_name, '') <> '' THEN '/' ELSE '' END || coalesce(object_name, '') AS object, {REASON} AS reason, {EVENT_TEXT} AS message, ({EVENT_N})::INT AS n FROM ev",
    "d25_stream_labels": f"WITH {CHOSEN} SELECT stream_id, label FROM labelled",
    "d26_whole_numbers": f"WITH {E}, x AS (SELECT stream_id, line_no, unnest(map_entries(fields)) AS f FROM e) SELECT stream_id, line_no, f.key AS key, CASE WHEN regexp_matches(trim(f.value), '^[+-]?[0-9]+$') THEN try_cast(trim(f.value) AS BIGINT) END AS number FROM x",
    "e4_where": _where(f"level >= 3 AND coalesce({_n_shard} >= 8, false) AND coalesce(nullif(logger, '') <> 'sync', true)"),
    "e6_where_level": _where("level > 2"),
    "e6_where_level_name": _where("level IN (3, 4)"),
    "e7_where_time": _where("ts_ns >= epoch(TIMESTAMP '2026-05-01')::BIGINT * 1000000000 AND ts_ns < epoch(TIMESTAMP '2026-06-01 12:30:00')::BIGINT * 1000000000"),
    "e8_where_equal": _where(f"{SHARD} = '7.0' OR ({_n_shard} = 7 AND NOT regexp_matches({SHARD}, '^[+-]?0[^.]'))"),
    "e8_where_padded": _where(f"{SHARD} = '07'"),
    "e9_where_order": _where(f"{_n_shard} > 7 AND {_n_shard} <= 12"),
    "e10_where_regex": _where("regexp_matches(message, '^(job|request) [0-9a-f]+') AND regexp_matches(nullif(logger, ''), 'e')"),
    "e11_where_missing": _where(f"coalesce({_n_shard} <> 7, true)"),
    "e12_not_blank": f"WITH {SOME} SELECT stream_id, line_no FROM present",
    "g1_totals": f"WITH {E} SELECT count(*) AS lines, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM e",
    "g2_levels": f"WITH {E} SELECT level, count(*) AS n, {name('level')} AS level_name FROM e GROUP BY level",
    "g3_status_classes": f"WITH {LINES}, s AS (SELECT try_cast(regexp_extract(raw, 'HTTP/[0-9.]+\" ([0-9]{{3}})', 1) AS INT) AS status FROM lines) SELECT (status // 100)::INT AS status_class, count(*) AS n FROM s WHERE status BETWEEN 100 AND 599 GROUP BY 1",
    "g5_top_templates": f"WITH {E} SELECT {TEMPLATE} AS template, count(*) AS n FROM e WHERE {TEMPLATE} <> '' GROUP BY 1 ORDER BY n DESC, template LIMIT 5",
    "h1_containers": f"WITH st AS (SELECT namespace, pod, name, ready, {STATE} AS status, row_number() OVER (PARTITION BY namespace, pod, name ORDER BY {RANK} DESC, pos DESC) AS k FROM container_statuses) SELECT c.namespace, c.pod, c.pos, coalesce(c.kind, '') AS kind, c.name, '' AS image, coalesce(st.ready, false) AS ready, st.status FROM container_statuses c JOIN st ON st.namespace = c.namespace AND st.pod = c.pod AND st.name = c.name AND st.k = 1",
    "h2_events_of_pods": f"WITH {PODS_EVENTS} SELECT event_id FROM own",
    "h4_selected_streams": "SELECT stream_id FROM streams s JOIN (SELECT DISTINCT namespace, pod FROM pods WHERE labels['tier'] = 'edge') USING (namespace, pod) WHERE coalesce(instance, 'current') = 'current'",
    "i1_merged_streams": _kept(4) + f", {CHOSEN} SELECT stream_id, line_no, label || ' ' || concat_ws(' ', '[' || {shown('ts_ns')} || ']', '[' || {name('eff_level')} || ']', {safe('message')}) AS line FROM kept JOIN labelled USING (stream_id) WHERE format = 'text'",
    "i2_timeline": f"WITH {E}, {PODS_EVENTS}, {TERMS} SELECT s.namespace, s.pod, ts_ns, 0 AS src_rank, {LOG_LINE} AS line FROM e JOIN streams s USING (stream_id) WHERE coalesce(instance, 'current') = 'current' UNION ALL SELECT namespace, object_name, {EVENT_US} * 1000, 1, {EVENT_LINE} FROM ranked WHERE place <= {MAX_EVENTS} UNION ALL SELECT namespace, pod, epoch_us(t.finished_at) * 1000, 2, {TERM_LINE} FROM terms",
    "i3_terminations": f"WITH {TERMS} SELECT namespace, pod, name, kind_rank, previous, t.exit_code AS exit_code FROM terms",
    "k1_text_lines": f"WITH {E} SELECT stream_id, line_no, concat_ws(' ', '[' || {shown('ts_ns')} || ']', '[' || {name('level')} || ']', CASE WHEN format = 'json' AND coalesce(logger, '') <> '' THEN '[' || logger || ']' END, {DETAILS}) AS line FROM e",
    "k3_ndjson": f"""WITH {E} SELECT stream_id, line_no, '{{' || concat_ws(',', '"time":"' || {shown('ts_ns', 'T', 'Z')} || '"', '"level":"' || {name('level')} || '"', '"logger":' || {json_string("nullif(logger, '')")}, '"message":' || {json_string(safe("nullif(message, '')"))}, '"format":"' || format || '"', '"fields":{{"shard":' || {json_string(SHARD)} || '}}') || '}}' AS line FROM e""",
    "k5_event_lines": f"WITH {PODS_EVENTS} SELECT namespace, object_name AS pod, {EVENT_US} * 1000 AS ts_ns, {EVENT_LINE} AS line FROM own",
    "k5_log_lines": f"WITH {E} SELECT s.namespace, s.pod, ts_ns, {LOG_LINE} AS line FROM e JOIN streams s USING (stream_id) WHERE coalesce(instance, 'current') = 'current'",
    "k5_term_lines": f"WITH {TERMS} SELECT namespace, pod, epoch_us(t.finished_at) * 1000 AS ts_ns, {TERM_LINE} AS line FROM terms",
    "k5_notices": f"WITH {PODS_EVENTS} SELECT DISTINCT namespace, object_name AS pod, '[notice] event list truncated to the first {MAX_EVENTS} events' AS line FROM ranked WHERE n_all > {MAX_EVENTS}",
    "k6_container_rows": f"WITH st AS (SELECT namespace, pod, name, coalesce(ready, false) AS ready, {STATE} AS status, row_number() OVER (PARTITION BY namespace, pod, name ORDER BY {RANK} DESC, pos DESC) AS k FROM container_statuses) SELECT c.namespace, c.pod, c.pos, CASE WHEN st.ready THEN '✓' ELSE '✗' END || ' ' || c.name || CASE WHEN coalesce(c.kind, '') <> '' THEN ' [' || c.kind || ']' ELSE '' END || ' [' || st.status || '] ()' AS row FROM container_statuses c JOIN st ON st.namespace = c.namespace AND st.pod = c.pod AND st.name = c.name AND st.k = 1",
}

# Records: how each splits, its six columns as text, and the first reason that applies.
_F = r'(?:"(?:[^"]|"")*"|[^",]*)'
_TOKEN = r'(?:[^\s"=]*=(?:"(?:[^"\\]|\\(?s:.))*"|[^\s"]*)|[^\s"=]+)'
_SIX = ("time", "level", "logger", "status", "duration_ms", "message")
_names = "['duration_ms', 'level', 'logger', 'message', 'status', 'time']"


def _csv_column(i: int) -> str:
    parts = ",".join(f"({_F})" if k == i else _F for k in range(6))
    value = f"regexp_extract(raw_line, '^{parts}$', 1)"
    return f"""CASE WHEN starts_with({value}, '"') THEN replace(substr({value}, 2, length({value}) - 2), '""', '"') ELSE {value} END"""


def _json_column(name: str) -> str:
    if name in ("status", "duration_ms"):
        return rf"""CASE WHEN json_type(j, '$.{name}') = 'NULL' THEN '' WHEN json_type(j, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN regexp_extract(raw_line, '"{name}"\s*:\s*([^,}}\s]+)', 1) END"""
    return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN json_extract_string(j, '$.{name}') END"


def _logfmt_column(name: str) -> str:
    value = f"substr(list_filter(tokens, lambda t: starts_with(t, '{name}='))[1], {len(name) + 2})"
    return rf"""CASE WHEN starts_with({value}, '"') THEN regexp_replace(substr({value}, 2, length({value}) - 2), '(?s)\\(.)', '\1', 'g') ELSE {value} END"""


_columns = ", ".join(f"CASE format WHEN 'csv' THEN {_csv_column(i)} WHEN 'json' THEN {_json_column(c)} ELSE {_logfmt_column(c)} END AS c_{c}" for i, c in enumerate(_SIX))
_zone = "(?:Z|[+-](?:(?:0[0-9]|1[0-7]):[0-5][0-9]|18:00))"
_clock = "(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"
SQL["p2_found"] = rf"""WITH r AS (SELECT DISTINCT record_id, format, raw_line FROM raw_records),
split AS (SELECT *, coalesce(regexp_full_match(raw_line, '{BLANK}*'), true) AS empty, CASE WHEN format = 'json' AND json_valid(raw_line) THEN raw_line::JSON END AS j, CASE WHEN format = 'logfmt' THEN regexp_extract_all(raw_line, '{_TOKEN}') END AS tokens FROM r),
counted AS (SELECT *, CASE format WHEN 'csv' THEN regexp_full_match(raw_line, '{_F}(?:,{_F})*') WHEN 'json' THEN j IS NOT NULL AND json_type(j) = 'OBJECT' ELSE regexp_full_match(raw_line, '\s*{_TOKEN}(?:\s+{_TOKEN})*\s*') END AS splits,
  CASE format WHEN 'csv' THEN regexp_full_match(raw_line, '{_F}(?:,{_F}){{5}}') WHEN 'json' THEN list_sort(json_keys(j)) = {_names} ELSE list_sort(list_transform(tokens, lambda t: split_part(t, '=', 1))) = {_names} AND len(list_filter(tokens, lambda t: NOT contains(t, '='))) = 0 END AS fits FROM split),
cols AS (SELECT record_id, empty, splits, fits, {_columns} FROM counted),
why AS (SELECT record_id, CASE WHEN empty THEN 'column_count' WHEN NOT splits THEN 'quoting' WHEN NOT fits THEN 'column_count'
  WHEN coalesce(regexp_full_match(c_time, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_clock}(?:\.[0-9]+)?{_zone}') AND try_cast(substr(c_time, 1, 10) AS DATE) IS NOT NULL AND upper(c_level) IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'FATAL')
    AND NOT regexp_full_match(c_logger, '{BLANK}*') AND regexp_full_match(c_status, '(?:0*[1-5][0-9]{{2}})?') AND regexp_full_match(c_duration_ms, '(?:[0-9]+(?:\.[0-9]+)?)?') AND c_message IS NOT NULL, false) THEN NULL ELSE 'value' END AS reason FROM cols)
SELECT record_id, reason FROM why WHERE reason IS NOT NULL"""
