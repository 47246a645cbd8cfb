from pyspark.sql import functions as F

from logloom.llm.runs import collapse_runs
from logloom.operators.blocks import block_between, order_cuts


def test_one_stray_time_leaves_blocks_even(spark):
    rows = spark.range(1000).select(F.when(F.col("id") == 999, 1 << 50).when(F.col("id") >= 900, F.lit(None)).otherwise(F.col("id")).alias("o"), F.col("id").alias("n"))
    cuts = order_cuts(rows, F.col("o"), 50)
    sizes = [r["count"] for r in rows.groupBy(block_between(F.col("o"), F.col("n"), cuts, 50)).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 110


def test_runs_across_blocks_and_rows_without_number(spark):
    rows = [("a", i if i < 60 else None, i, "x" if i % 20 else "y", i, 1) for i in range(90)] + [("b", None, None, "z", None, 1)] * 2 + [("a", 5, 5, "x", 5, 1)]
    df = spark.createDataFrame(rows, "k string, o bigint, n bigint, v string, t bigint, w int")
    want = sorted(map(tuple, collapse_runs(df, ["k"], "o", "n", "v", "t", "w").collect()), key=str)
    for size in (3, 7, 25):
        assert sorted(map(tuple, collapse_runs(df, ["k"], "o", "n", "v", "t", "w", target_rows=size).collect()), key=str) == want
    assert [r for r in want if r[0] == "b"] == [("b", None, None, 2, 2, 0)]
    assert ("a", 1, 19, 19, 19, 18) in want


def test_orders_below_zero_and_missing_ones(spark):
    rows = [("s", None, 1, "x", None, 1), ("s", -5, 2, "y", -5, 1), ("s", -4, 3, "x", -4, 1), ("s", 3, 4, "x", 3, 1), ("s", 4, 5, "x", 4, 1)]
    df = spark.createDataFrame(rows, "k string, o bigint, n bigint, v string, t bigint, w int")
    for size in (1, 2, 1 << 16):
        got = sorted(tuple(r)[1:4] for r in collapse_runs(df, ["k"], "o", "n", "v", "t", "w", target_rows=size).collect())
        assert got == [(1, 1, 1), (2, 2, 1), (3, 5, 3)], size


def test_nulls_repeats_ties_clashing_names_and_nothing(spark):
    from datetime import datetime

    from logloom.llm.runs import all_runs

    at, long = datetime(2026, 3, 8, 12), "long " * 300_000
    e = [("s", 1, "a 1", at, 0), ("s", 2, "A  b2", None, 0), ("s", 2, "A  b2", None, 0), ("s", 3, None, at, 0), ("s", 4, "a", at, 0), ("s", None, "a", at, 0), (None, 1, "n", at, 0), ("", 2, "n", at, 0), ("l", 1, long, at, 0), ("l", 2, long.upper(), at, 0)]
    entries = spark.createDataFrame(e, "stream_id string, line_no int, message string, ts timestamp, n_rows int")
    v = [("n", "p", 7, "R", "m 1", at, 3, None), ("n", "p", 8, "r", "m", at, None, 0), ("n", "p", 9, "other", "m", at, 1, 1), ("n", "p", None, "r", "m", at, 1, 1), (None, None, 1, None, "m", None, 0, 5), ("", "", 2, "", "m", None, 1, 0)]
    events = spark.createDataFrame(v, "namespace string, object_name string, event_id bigint, reason string, message string, last_ts timestamp, count int, series_count int")
    events = events.select("*", *[F.lit(None).cast("timestamp").alias(c) for c in ("event_time", "first_ts", "created_ts")], F.lit(1).alias("said"))
    want = [("entry", "", 1, 2, 2, 2, 0), ("entry", "l", 1, 2, 2, 2, 0), ("entry", "s", 1, 2, 2, 2, 0), ("event", "/", 1, 2, 2, 6, 0), ("event", "n/p", 7, 8, 2, 4, 0)]
    assert sorted(map(tuple, all_runs(entries, events).collect())) == want
    assert all_runs(entries.where("false"), events.where("false")).count() == 0


def test_many_rows_at_one_time_are_many_blocks(spark):
    # a third of the rows share one time, among them runs that cross the cuts
    rows = [("a", 500 if 300 <= i < 600 else i, (i * 7919) % 1009, i // 40 if i < 450 else "z", i, 1) for i in range(900)]
    df = spark.createDataFrame([(k, o, n, str(v), t, w) for k, o, n, v, t, w in rows], "k string, o bigint, n bigint, v string, t bigint, w int")
    cuts = order_cuts(df, F.col("o"), 50, F.col("n"))
    sizes = [r["count"] for r in df.groupBy(block_between(F.col("o"), F.col("n"), cuts, 50)).count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 130
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    at = {(r.o, r.n): r.b for r in df.select("o", "n", block_between(F.col("o"), F.col("n"), cuts, 50).alias("b")).collect()}
    placed = [at[(r[1], r[2])] for r in ordered]
    assert placed == sorted(placed)
    want = sorted(map(tuple, collapse_runs(df, ["k"], "o", "n", "v", "t", "w").collect()))
    for size in (3, 50):
        assert sorted(map(tuple, collapse_runs(df, ["k"], "o", "n", "v", "t", "w", target_rows=size).collect())) == want
