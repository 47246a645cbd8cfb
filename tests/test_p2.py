import json
import random

import pytest

import __spark_entry__ as driver
from logloom.sources.records import classified, classify_records, failing_records, reason, valid_records
from logloom.runtime import table

CSV = '2026-05-06T06:16:22.095Z,Error,cache,201,5.0,'
JSON = '{"time":"2026-05-06T06:16:22+18:00","level":"info","logger":"a","status":null,"duration_ms":0,"message":"m"}'
FMT = 'time=2026-05-06T06:16:22Z level=info logger=a status= duration_ms="5.1" '


@pytest.mark.parametrize(
    ("kind", "line", "want"),
    [
        ("csv", CSV + '"a ""b"", c\nd"', None),
        ("csv", CSV, None),
        ("csv", CSV + 'a "b"', "quoting"),
        ("csv", CSV + '"a" b', "quoting"),
        ("csv", CSV + '"a', "quoting"),
        ("csv", CSV + "a,b", "column_count"),
        ("csv", None, "column_count"),
        ("csv", CSV.replace("201", "99"), "value"),
        ("csv", CSV.replace("05-06", "02-30"), "value"),
        ("csv", CSV.replace("16:22", "16:60"), "value"),
        ("csv", CSV.replace("cache", " "), "value"),
        ("json", JSON, None),
        ("json", JSON + ",", "quoting"),
        ("json", JSON.replace("0,", "NaN,"), "quoting"),
        ("json", "[]", "quoting"),
        ("json", " \t", "column_count"),
        ("json", JSON.replace('"logger"', '"level"'), "column_count"),
        ("json", JSON.replace("null", '"200"'), "value"),
        ("json", JSON.replace('"m"', "null"), "value"),
        ("json", JSON.replace("+18:00", "+18:01"), "value"),
        ("logfmt", FMT + 'message="a \\"b\\" c"', None),
        ("logfmt", FMT + 'message="a b', "quoting"),
        ("logfmt", FMT + 'message="a"b', "quoting"),
        ("logfmt", FMT + 'message=a"b', "quoting"),
        ("logfmt", FMT + "message=a b", "column_count"),
        ("logfmt", FMT + "message=a level=info", "column_count"),
        ("logfmt", FMT.replace("5.1", "1e3") + "message=", "value"),
    ],
)
def test_reason(kind, line, want):
    assert reason(line, kind) == want


def test_p2_gives_each_failing_record_once(spark, small):
    got = driver.queries()["p2_found"](spark, small)
    assert got.dtypes == [("record_id", "bigint"), ("reason", "string")]
    rows = [tuple(r) for r in got.collect()]
    want = {(r.record_id, y) for r in table(spark, small, "raw_records").collect() if (y := reason(r.raw_line, r.format))}
    assert len(rows) == len(want) and set(rows) == want


def _random_record(rng):
    kind = rng.choice(["csv", "json", "logfmt"])
    values = {"time": rng.choice(["2026-03-08T12:00:00Z", "2026-02-30T12:00:00Z", "2026-03-08T12:00:00.5+18:00", "2026-03-08T12:00:00+18:01"]), "level": rng.choice(["info", "WARNING", "loud"]), "logger": rng.choice(["a.b", " ", "x"]), "status": rng.choice(["200", "", "600", "0200"]), "duration_ms": rng.choice(["1.5", "", "1e3", "-1", "7"]), "message": rng.choice(["plain", 'a "b", c', "", "tab\\tn=1", "line\nbreak"])}
    if kind == "csv":
        line = ",".join('"' + v.replace('"', '""') + '"' if rng.random() < 0.5 or set(v) & set('",\n') else v for v in values.values())
    elif kind == "json":
        typed = {k: (None if v == "" else v if rng.random() < 0.05 else float(v) if "." in v or "e" in v else int(v)) if k in ("status", "duration_ms") else v for k, v in values.items()}
        line = json.dumps(typed)
    else:
        line = " ".join(f"{k}=" + ('"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if set(v) & set(' "\n\\') or rng.random() < 0.3 else v) for k, v in values.items())
    for _ in range(rng.choice([0, 0, 1])):  # break it somewhere
        at = rng.randrange(len(line) + 1)
        line = line[:at] + rng.choice(['"', ",", "=", " ", "}", "\\", ""]) + line[at + rng.choice([0, 1]) :]
    return kind, line


def test_readers_agree_with_splitting_every_record(spark):
    rng = random.Random(2)
    rows = [(i, *_random_record(rng)) for i in range(6000)]
    df = spark.createDataFrame(rows, "record_id bigint, format string, raw_line string")
    got = {r.record_id: r for r in classify_records(df).collect()}
    for i, kind, line in rows:
        why, columns = classified(line, kind)
        assert got[i].reason == why, (kind, line)
        if why is None:
            assert (got[i].message, got[i].level, got[i].logger) == (columns["message"], columns["level"], columns["logger"]), line
            assert got[i].status == (int(columns["status"]) if columns["status"] else None) and got[i].time is not None
    assert len({r.reason for r in got.values()}) == 4


def test_nulls_repeats_clashing_names_and_nothing(spark):
    long = "2026-03-08T12:00:00Z,INFO,a,200,1.5," + "x" * 2_000_000
    rows = [(1, "csv", long, "r", 1), (1, "csv", long, "r", 1), (2, None, long, "r", 1), (3, "csv", None, None, 1), (None, "json", "{}", "r", 1), (4, "tsv", "a\tb", "r", 1), (5, "logfmt", "\u3000", "r", 1)]
    df = spark.createDataFrame(rows, "record_id bigint, format string, raw_line string, reason string, status int")
    assert sorted((str(r.record_id), r.reason) for r in failing_records(df).collect()) == [("2", "quoting"), ("3", "column_count"), ("4", "quoting"), ("5", "column_count"), ("None", "column_count")]
    good = valid_records(df).collect()
    assert [(r.record_id, r.status, r.duration_ms, len(r.message)) for r in good] == [(1, 200, 1.5, 2_000_000)]
    assert dict(valid_records(df).dtypes) == {"record_id": "bigint", "time": "timestamp", "level": "string", "logger": "string", "status": "int", "duration_ms": "double", "message": "string"}
    assert failing_records(df.where("false")).count() == valid_records(df.where("false")).count() == 0
