import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import levels, text, times
from logloom.functions.bags import text_form, yaml_flow_map
from logloom.functions.levels import word_level
from logloom.functions.names import DEBUG, DEFAULT_NAMES, ERROR, FATAL, INFO, TRACE, WARN
from logloom.functions.times import text_time
from logloom.operators.decode import csv_columns, decode, decode_line, trailing_fields

AT = 1_782_295_200_000_000_000  # 2026-06-24 10:00:00 UTC
T = "2026-06-24T10:00:00Z"


@pytest.mark.parametrize(
    ("line", "want"),
    [  # level, message, format, logger, ts
        ('{"level":"error","msg":"m","time":"%s"}' % T, (ERROR, "m", "json", "logrus", AT)),
        ('{"level":30,"msg":"m","time":1782295200000,"pid":1}', (INFO, "m", "json", "pino", AT)),
        ('{"Level":"Warning","Msg":"m","Timestamp":"%s"}' % T, (WARN, "m", "json", "", AT)),
        ('{"level":"bogus","severity":"crit","message":"","msg":"m"}', (ERROR, "m", "json", "logrus", None)),
        ('{"logger":"pay","level":"info","msg":"m","ts":"20260624"}', (INFO, "m", "json", "pay", AT - 36_000_000_000_000)),
        ('{"method":"GET","status":503,"message":"m"}', (ERROR, "m", "json", "", None)),
        ('{"request":{"method":"GET"},"status":"404"}', (WARN, '{"request":{"method":"GET"},"status":"404"}', "json", "", None)),
        ('{"method":"GET","status":500.0,"message":"m"}', (None, "m", "json", "", None)),
        ('{"Method":"GET","status":500,"message":"m"}', (None, "m", "json", "", None)),
        ('{"a":1} trailing', (None, '{"a":1} trailing', "text", "", None)),
        ('{"msg":"a"}{"msg":"b"}', (None, '{"msg":"a"}{"msg":"b"}', "text", "", None)),
        ('{"message":null,"error":"e"}', (None, "e", "json", "", None)),
        ("{level: info, msg: hi, ts: 1782295200}", (INFO, "hi", "json", "logrus", AT)),
        ("{note: nothing to see}", (None, "{note: nothing to see}", "text", "", None)),
        (f"[{T}] [WRN] [c] m", (None, "[WRN] [c] m", "text", "", AT)),
        (f"[{T}] [warn] [c] m n=1 k=\"v\" n=2", (WARN, "m", "bracketed", "c", AT)),
        ("[no time] [info] [c]   m", (INFO, "m", "bracketed", "c", None)),
        (f'time={T} level=WARN msg="a \\"b\\" \\t" source=s', (WARN, 'a "b" \\t', "logfmt", "s", AT)),
        ("level=bogus lvl=error msg=m", (None, "m", "logfmt", "", None)),
        ("method=GET status=500 msg=m", (None, "m", "logfmt", "", None)),
        ("https://host/a?level=error", (ERROR, "https://host/a?level=error", "text", "", None)),
        ("E0624 10:00:00.123456   12 server.go:42] failed", (ERROR, "failed", "text", "", None)),
        ("<12>warned", (WARN, "warned", "text", "", None)),
        ("<192>no priority", (None, "<192>no priority", "text", "", None)),
        ('1.2.3.4 - - [x] "GET /a HTTP/1.1" 404 6', (WARN, '1.2.3.4 - - [x] "GET /a HTTP/1.1" 404 6', "text", "", None)),
        (f'<log level="ERROR" ts="{T}" logger="l">a &lt; b</log>', (ERROR, "a &lt; b", "xml", "l", AT)),
        ('<log message="m" />', (None, "m", "xml", "", None)),
        ("<a>x</b>", (None, "<a>x</b>", "text", "", None)),
        (f'{T},ERROR,svc,"a, ""b"""', (ERROR, 'svc, a, "b"', "text", "", AT)),
        (f"{T},svc,m", (None, f"{T},svc,m", "text", "", None)),
        (f"{T} ERROR boom", (ERROR, "boom", "text", "", AT)),
        ("ERROR 2026-06-24 10:00:00 boom", (ERROR, "boom", "text", "", AT)),
        (f"[{T}] [TRACE] boom", (TRACE, "boom", "text", "", AT)),
        (f"{T[:-1]}Zerror boom", (None, f"{T}error boom", "text", "", None)),
        ("stack TRACE follows", (None, "stack TRACE follows", "text", "", None)),
        ("an Error: happened", (ERROR, "an Error: happened", "text", "", None)),
        ("next backup for 2026-12-25 10:00:00", (None, "next backup for 2026-12-25 10:00:00", "text", "", None)),
        ("2026-06-24 10:00:00Z INFO m", (INFO, "m", "text", "", None)),
        (f"2026-06-24T10:00:01.5Z   {T} ERROR boom", (ERROR, "boom", "text", "", AT + 1_500_000_000)),
        ("", (None, "", "text", "", None)),
    ],
)
def test_decode_line(line, want):
    (level, message, form, logger, _, ts, _), _ = decode_line(line)
    assert (level, message, form, logger, ts) == want


def test_trailing_fields():
    assert trailing_fields('a  b x=1 y="2"') == ("a b", {"x": "1", "y": "2"})
    assert trailing_fields(" a  b ") == ("a  b", None)
    assert trailing_fields("see http://h/?q=1") == ("see http://h/?q=1", None)


def test_csv_columns_with_lazy_quotes():
    assert csv_columns('a,"b ""c"" d",e"f,"g" h",') == ["a", 'b "c" d', 'e"f', 'g" h', ""]
    assert csv_columns('"open, to the end') == ["open, to the end"]


def test_yaml_values():
    got = yaml_flow_map('{a: 1, b: 0x1F, c: yes, d: ~, e: [x, 1.5], f: {g: "h, i"}, j: \'k\'\'l\', m: 2026-06-24, n: .inf}')
    assert got == {"a": 1, "b": 31, "c": True, "d": None, "e": ["x", 1.5], "f": {"g": "h, i"}, "j": "k'l", "m": "2026-06-24", "n": float("inf")}
    assert yaml_flow_map("{a: 1} {b: 2}") is None and yaml_flow_map("{}") is None and yaml_flow_map("{a: [1}") is None
    assert text_form(got["e"]) == "[x 1.5]" and text_form(got["f"]) == "map[g:h, i]" and text_form(1e21) == "1e+21"


@given(st.text(max_size=60))
def test_any_line_is_decoded(line):
    found, raw = decode_line(line)
    assert found[2] in ("json", "bracketed", "logfmt", "xml", "text") and isinstance(found[1], str) and isinstance(raw, str)


@given(st.dictionaries(st.text(max_size=5), st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6), max_size=5))
def test_any_json_object_is_json(data):
    line = json.dumps(data)
    found, _ = decode_line(line)
    assert found[2] == ("text" if "NaN" in line or "Infinity" in line else "json") or "\\" in line or '"' in json.dumps(list(data))


LEVELS = {"info": INFO, " WARNING ": WARN, "Err": ERROR, "critical": ERROR, "panic": FATAL, "fine": DEBUG, "finest": TRACE, "verbose": TRACE, "notice": INFO, "0": INFO, "1": WARN, "2": ERROR, "3": DEBUG, "-1": DEBUG, "10": TRACE, "20": DEBUG, "30.0": INFO, "40": WARN, "5e1": ERROR, "60": FATAL, "1000": FATAL, "30.5": None, "": None, "nothing": None, "tracer": None, "fatal!": None, "informational": INFO, "errno": ERROR}


def test_levels_of_words_and_columns(spark):
    assert {w: word_level(w) for w in LEVELS} == LEVELS
    df = spark.createDataFrame([(w,) for w in [*LEVELS, None]], "w string")
    got = {r.w: (r.level, r.word) for r in df.select("w", levels.parse_level(df.w).alias("level"), levels.is_level_word(df.w).alias("word")).collect()}
    assert {w: v[0] for w, v in got.items()} == LEVELS | {None: None}
    assert {w for w, v in got.items() if v[1]} == {"info", " WARNING ", "Err", "critical", "panic", "fine", "finest", "verbose", "notice"}
    named = spark.range(-1, 7).select(levels.level_name(F.col("id")).alias("n")).collect()
    assert [r.n for r in named] == ["UNKNOWN", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN"]


TIMES = {T: AT, "2026-06-24T10:00:00.123456789Z": AT + 123_456_789, "2026-06-24T12:00:00+0200": AT, "2026-06-24T12:00:00.5+02:00": AT + 500_000_000, "2026-06-24T04:30:00-05:30": AT, "2026-06-24T10:00:00": AT, "2026-06-24 10:00:00,25": AT + 250_000_000, "2026/06/24 10:00:00": AT, "Wed Jun 24 10:00:00 UTC 2026": AT, "Wed Jun 24 10:00:00 2026": AT, "2026-06-24 10:00:00Z": None, "2026/06/24T10:00:00": None, "2026-02-30T10:00:00Z": None, "2026-06-24T24:00:00Z": None, "2026-06-24T10:00:60Z": None, "2026-06": None, "": None, "0001-01-01T00:00:00Z": None, "1969-12-31T23:59:59.5Z": -500_000_000}


def test_times_of_texts_and_columns(spark):
    assert {t: text_time(t) for t in TIMES} == TIMES
    df = spark.createDataFrame([(t,) for t in [*TIMES, None]], "t string")
    rows = df.select("t", times.parse_time(df.t).alias("ns")).collect()
    assert {r.t: r.ns for r in rows} == TIMES | {None: None}
    shown = df.select(times.parse_time(df.t).alias("ns")).where("ns is not null").select(times.display_time(F.col("ns")).alias("s")).distinct().collect()
    assert {r.s for r in shown} == {"2026-06-24 10:00:00", "1969-12-31 23:59:59"}


def test_epochs(spark):
    cases = {"1782295200": AT, "1782295200000": AT, "1782295200000000": AT, "1782295200000000001": AT + 1, "1782295200.9": AT, "20260624": AT - 36_000_000_000_000, "20261399": 20261399 * 10**9, "x": None, T: AT}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.ns for r in df.select("t", times.time_field(df.t).alias("ns")).collect()} == cases


def test_durations():
    assert times.since_seconds("1h30m") == 5400 and times.since_seconds("1.2s") == 2 and times.since_seconds("1ns") == 1
    for bad in ("0s", "-5m", "5", "m", "", "5x"):
        with pytest.raises(ValueError):
            times.since_seconds(bad)


def test_text_columns(spark):
    marker = " …[line truncated]"
    rows = ["a\x1b[0m\tb​﻿", " x", "\tx", f"{T} \tx", f"{T}  x", "at", "Caused by: x", "java.lang.RuntimeException: x", "errors were found:", "pkg.Func(0x1)", "goroutine 7 [running]:", "traceback (most recent call last):", "y" * 30 + "\r", "é" * 20, "", "　", "a=b", None]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    got = df.select(text.sanitize(df.r).alias("safe"), text.is_indented(df.r).alias("ind"), text.is_trace_boundary(df.r).alias("bound"), text.bounded_line(df.r, 20).alias("cut"), text.is_blank(df.r).alias("blank"), text.quoted(df.r).alias("shown"), text.needs_attention(df.r).alias("att")).collect()
    assert got[0].safe == "a\\x1B[0m\tb\\u200B\\uFEFF" and got[-1].safe is None
    assert [r.ind for r in got] == [False, True, True, True, True] + [False] * 13
    assert [i for i, r in enumerate(got) if r.bound] == [6, 7, 9, 10, 11]
    assert got[12].cut == "y" * 20 + marker and got[13].cut == "é" * 10 + marker and got[1].cut == " x"
    assert [r.blank for r in got[-4:]] == [True, True, False, True] and got[-4].shown == '""' and got[-2].shown == '"a=b"'
    assert [i for i, r in enumerate(got) if r.att] == [8]
    again = df.select(text.sanitize(text.sanitize(df.r)).alias("x"), text.sanitize(df.r).alias("y")).where("not x <=> y").count()
    assert again == 0


def test_long_lines_and_clashing_names(spark):
    lines = ["k=v " * 100_000, '{"msg":"' + "x" * 2_000_000 + '"}', "<a " + 'b="c" ' * 50_000 + "/>", 'msg="' + "\\\\" * 200_000 + '"', "{" * 100_000 + "}", None, '{"a":"\\ud800"}', "a." * 100_000 + "b(", "[" * 100_000]
    df = spark.createDataFrame([(i, line, "x") for i, line in enumerate(lines)], "level int, raw string, ts_ns string")
    got = decode(df).collect()
    assert [r.format for r in got] == ["logfmt", "json", "xml", "logfmt", "text", "text", "json", "text", "text"]
    assert dict(decode(df).dtypes)["ts_ns"] == "bigint" and got[6].fields == {"a": "�"}
    assert df.select(text.is_trace_boundary(df.raw).alias("b")).where("b").count() == 0
    assert decode(df.where("false")).count() == 0


def test_aliases_come_after_built_in_names():
    names = DEFAULT_NAMES.with_aliases(level=("sev", "level"), message=("said",), time=("at",))
    (level, message, _, _, _, ts, _), _ = decode_line('{"sev":"warn","said":"m","at":"%s"}' % T, names)
    assert (level, message, ts) == (WARN, "m", AT)
    (level, message, _, _, _, ts, _), _ = decode_line(f"sev=warn said=m at={T}", names)
    assert (level, message, ts) == (WARN, "m", AT)
    assert names.json_level[-1] == "sev" and "sev" in names.shown_elsewhere
