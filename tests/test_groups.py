"""Groups, filters and tails against a sequential restatement of the state machine."""

import random
import re

import pytest

from logloom.operators.decode import continues, decode_line
from logloom.operators.grouping import query_lines
from logloom.options import QueryOptions

SHAPES = ["ERROR boom {n}", "INFO all fine {n}", "WARN near limit {n}", "TRACE deep {n}", "plain words {n}", "  frame {n}", "\tat a.b.C(D.java:{n})", "Caused by: x.YError: {n}", "ValueError: {n}", "2026-06-24T10:00:00Z   frame {n}", "level=error msg=m{n} k={n}", "level=info k={n}", "", " \t"]


def stream(rng, n):
    return [rng.choice(SHAPES).format(n=rng.randint(0, 3)) for _ in range(n)]


def one_by_one(lines, floor, include=(), exclude=(), where=None, tail=-1):
    """Kept (number, level, continues) of one stream, line after line."""
    parent, anchor_where, anchor_kept, out = None, True, False, []
    for no, line in enumerate(lines):
        if not line.strip():
            continue
        (level, _, _, _, data, _, _), _ = decode_line(line)
        cont = level is None and parent is not None and continues(line)
        now = parent if cont else 1 if level is None else level
        parent = parent if level is None else level
        ok = (not include or any(re.search(p, line) for p in include)) and not any(re.search(p, line) for p in exclude)
        if now < floor:
            anchor_kept = anchor_kept and cont
            continue
        if cont:
            keep = ((ok and anchor_where) or anchor_kept) if include else (ok and anchor_where and anchor_kept)
        else:
            anchor_where = where is None or where(data, now)
            keep = anchor_kept = ok and anchor_where
        if keep:
            out.append((no, now, cont))
    if tail < 0:
        return out
    if tail == 0:
        return []
    starts = [i for i, r in enumerate(out) if not r[2]]
    head = out[: starts[0]] if starts else out
    return head + (out[starts[-tail] if len(starts) >= tail else starts[0] :] if starts else [])


CASES = [
    dict(level="TRACE"), dict(level="WARN"), dict(level="DEBUG", grep=["boom", "frame 1"]), dict(level="INFO", exclude=["fine", "2$"]),
    dict(level="DEBUG", grep=["[0-2]"], exclude=["1"], where=["k>=1"]), dict(level="INFO", where=["k!=2"]), dict(level="DEBUG", where=["level>=warn"], tail=2),
    dict(level="INFO", tail=1), dict(level="DEBUG", grep=["Error"], tail=3), dict(level="INFO", tail=0),
]
TESTS = {"k>=1": lambda d, lv: d is not None and "k" in d and int(d["k"]) >= 1, "k!=2": lambda d, lv: d is None or d.get("k") != "2", "level>=warn": lambda d, lv: lv >= 3}


@pytest.mark.parametrize("target_rows", [9, 1 << 16])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_queries_equal_the_state_machine(spark, case, target_rows):
    rng, options = random.Random(case), CASES[case]
    streams = {f"s{i}": stream(rng, rng.choice([0, 1, 5, 30, 60])) for i in range(12)}
    rows = [(s, no, line) for s, lines in streams.items() for no, line in enumerate(lines)]
    rows += rng.sample(rows, 20)  # delivered again
    rng.shuffle(rows)
    made = QueryOptions.of(**options)
    got = query_lines(spark.createDataFrame(rows, "stream_id string, line_no bigint, raw string"), made, target_rows=target_rows)
    where = TESTS[options["where"][0]] if "where" in options else None
    want = {(s, *r) for s, lines in streams.items() for r in one_by_one(lines, made.min_level, made.include, made.exclude, where, made.tail)}
    found = [(r.stream_id, r.line_no, r.eff_level, r.is_cont) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_grep_and_exclude_part_the_lines(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([("s", i, line) for i, line in enumerate(stream(rng, 300))], "stream_id string, line_no bigint, raw string")
    every, kept, dropped = ({r.line_no for r in query_lines(rows, QueryOptions.of("TRACE", **x)).collect()} for x in ({}, {"grep": ["1"]}, {"exclude": ["1"]}))
    assert kept | dropped == every and not kept & dropped


def test_levels_are_monotone_and_empty_input_is_fine(spark):
    rows = spark.createDataFrame([("s", i, line) for i, line in enumerate(stream(random.Random(4), 200))] + [("s", None, "ERROR x"), (None, 1, "ERROR y"), (None, None, None)], "stream_id string, line_no bigint, raw string")
    seen = [{(r.stream_id, r.line_no, r.raw) for r in query_lines(rows, QueryOptions.of(level)).collect()} for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")]
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and {("s", None, "ERROR x"), (None, 1, "ERROR y")} <= seen[4]
    assert query_lines(rows.where("false"), QueryOptions.of("TRACE", grep=["x"], tail=3)).count() == 0


def test_following_gives_the_rows_of_the_batch(spark, tmp_path):
    from logloom.streaming.follow import follow, start

    rng = random.Random(5)
    rows = [(f"s{i % 5}", i, line) for i, line in enumerate(stream(rng, 400))]
    options = QueryOptions.of("DEBUG", grep=["boom", "1"], where=["k!=2"])
    for part in range(4):  # four micro-batches, each of all streams
        df = spark.createDataFrame(rows[100 * part : 100 * part + 100], "stream_id string, line_no bigint, raw string").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start(follow(arriving, options), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    got = {(r.stream_id, r.line_no, r.eff_level, r.is_cont) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = query_lines(spark.createDataFrame(rows, "stream_id string, line_no bigint, raw string"), options)
    assert got == {(r.stream_id, r.line_no, r.eff_level, r.is_cont) for r in batch.collect()}
    with pytest.raises(ValueError):
        follow(arriving, QueryOptions.of(tail=3))
