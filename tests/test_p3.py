import pytest

import __spark_entry__ as driver
from logloom.operators.entries import line_entries, read_line
from logloom.runtime import table

AT = 1_772_971_200_000_000  # 2026-03-08 12:00:00 UTC
P = "2026-03-08T12:00:00.000000999Z "


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"log.level":"NOTICE","@timestamp":1772971200,"message":"a \\"b\\"","logger":"x.Y"}\r', (True, AT, "INFO", "x.Y", 'a "b"')),
        ('{level: err, ts: 1772971200000, logger: pool, msg: "a, b: c"}', (True, AT, "ERROR", "pool", "a, b: c")),
        ('time=2026-03-08T12:00:00Z level=trace component=c msg="a \\"b\\"" k=1', (True, AT, "TRACE", "c", 'a "b"')),
        ("[2026-03-08 12:00:00] [warn] [c] m [x]", (True, AT, "WARN", "c", "m [x]")),
        ("[2026-03-08T12:00:00Z INFO  a::b] m", (True, AT, "INFO", "a::b", "m")),
        ("E0308 12:00:00.000001    7 lease.go:478] m", (True, AT + 1, "ERROR", "lease.go", "m")),
        ("<15>Mar  8 12:00:00 node06 keeper[24]: m n", (True, AT, "DEBUG", "keeper", "m n")),
        ('<log level="Debug" ts="2026-03-08T12:00:00Z" logger="q">a &lt; b</log>', (True, AT, "DEBUG", "q", "a < b")),
        ('2026-03-08T12:00:00Z,WARN,up,"a ""b"", c"', (True, AT, "WARN", "up", 'a "b", c')),
        ("2026-03-08 12:00:00.000 [p-1] WARN  com.A - m", (True, AT, "WARN", "com.A", "m")),
        ("2026-03-08 12:00:00.000 UTC [8] courier INFO:  m", (True, AT, "INFO", "courier", "m")),
        ("2026-03-08 12:00:00,000 - pool - WARNING - m - n", (True, AT, "WARN", "pool", "m - n")),
        ("TRACE:heartbeat:m:n", (True, -1, "TRACE", "heartbeat", "m:n")),
        ("warn 2026-03-08 12:00:00 m", (True, AT, "WARN", "", "m")),
        ("2026/03/08 12:00:00 m", (True, AT, "", "", "m")),
        (P + '1.2.3.4 - - [08/Mar/2026:13:00:00 +0000] "GET /a HTTP/1.1" 404 6', (True, AT, "WARN", "", '1.2.3.4 - - [08/Mar/2026:13:00:00 +0000] "GET /a HTTP/1.1" 404 6')),
        ("opened amber damper\r", (True, -1, "", "", "opened amber damper")),
        (P + "\tat a.B.c(D.java:1)", (False, AT, "", "", "\tat a.B.c(D.java:1)")),
        ("Caused by: a.BError: x", (False, -1, "", "", "Caused by: a.BError: x")),
    ],
)
def test_read_line(raw, want):
    assert read_line(raw, 2026) == want


def grouped(rows):
    found = {}
    for stream, no, raw, year in sorted({(r.stream_id, r.line_no, r.raw, r.ingest_ts.year) for r in rows if r.raw and r.raw.strip()}):
        start, *rest = read_line(raw, year)
        if start or stream not in found:
            found.setdefault(stream, []).append([stream, no, no, *rest])
        else:
            found[stream][-1][2] = no
    return sorted(tuple(e) for entries in found.values() for e in entries)


@pytest.mark.parametrize("target_rows", [3, 1 << 16])
def test_p3_joins_lines_across_blocks(spark, small, target_rows):
    lines = table(spark, small, "log_lines")
    got = line_entries(lines, target_rows)
    assert sorted(map(tuple, got.collect())) == grouped(lines.collect())


def test_p3_columns(spark, small):
    got = driver.queries()["p3_found"](spark, small)
    assert got.dtypes == [("stream_id", "string"), ("first_line", "bigint"), ("last_line", "bigint"), ("ts_us", "bigint"), ("level", "string"), ("component", "string"), ("message", "string")]


def test_nulls_repeats_long_lines_clashing_names_and_nothing(spark):
    import datetime

    seen = datetime.datetime(2026, 3, 8, 12)
    long = "x" * 2_000_000
    rows = [("s", 1, "\tat a.B.c(D.java:1)", seen, 1), ("s", 2, "INFO: m", None, 1), ("s", 2, "INFO: m", None, 1), ("s", 3, " " + long, seen, 1), (None, 1, "INFO m", seen, 1), ("s", None, "INFO m", seen, 1), ("s", 4, None, seen, 1), ("s", 5, " \t", seen, 1), ("t", -7, "<13>Mar  8 12:00:00 h p[1]: " + long, seen, 1), ("t", 1 << 40, "<13>Mar  8 12:00:00 h p[1]: m", None, None)]
    df = spark.createDataFrame(rows, "stream_id string, line_no bigint, raw string, ingest_ts timestamp, level int")
    for target in (1, 2, 1 << 16):
        got = [(r.stream_id, r.first_line, r.last_line, r.ts_us, r.level, r.component, len(r.message)) for r in line_entries(df, target).collect()]
        assert sorted(got) == [("s", 1, 1, -1, "", "", 19), ("s", 2, 3, -1, "INFO", "", 1), ("t", -7, -7, AT, "INFO", "p", 2_000_000), ("t", 1 << 40, 1 << 40, 5_745_600_000_000, "INFO", "p", 1)], target
    assert line_entries(df.where("false")).count() == 0
