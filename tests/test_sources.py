import datetime

import pytest
from pyspark.sql import functions as F

from logloom.sources import lines as sources


def test_files_keep_their_order_whatever_the_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.log", 3000), ("b.log", 7), ("c.log", 900), ("empty.log", 0)):
        body = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_bytes(b"".join(x.encode() + (b"\r\n" if i % 3 else b"\n") for i, x in enumerate(body)))
        want[name] = body
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "16m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = sources.read_lines(spark, str(tmp_path)).orderBy("stream_id", "line_no").collect()
            got = {}
            for r in rows:
                got.setdefault(r.stream_id.rpartition("/")[2], []).append(r)
            assert {k: [r.raw for r in v] for k, v in got.items()} == {k: v for k, v in want.items() if v}
            assert all(len({r.line_no for r in v}) == len(v) for v in got.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ends_of_lines_and_bounds(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"a\rb\n\n" + b"y" * 100 + b"\r\nlast\xff")
    rows = [r.raw for r in sources.source(spark, str(tmp_path / "x")).orderBy("line_no").collect()]
    assert rows == ["a\rb", "", "y" * 100, "last�"]
    cut = [r.raw for r in sources.read_lines(spark, str(tmp_path / "x"), 10).orderBy("line_no").collect()]
    assert cut[2] == "y" * 10 + " …[line truncated]"
    assert [r.raw for r in sources.source(spark, "-", "a\r\n\nb\n").orderBy("line_no").collect()] == ["a", "", "b"]
    assert sources.source(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        sources.source(spark, str(tmp_path / "none"))


def test_since_and_stamps(spark):
    day = datetime.datetime(2026, 6, 24, 10, tzinfo=datetime.UTC)
    rows = [("s", 1, "a", day), ("s", 2, "b", day - datetime.timedelta(seconds=61, microseconds=-120_000)), ("s", 3, "c", None)]
    df = spark.createDataFrame(rows, "stream_id string, line_no bigint, raw string, ingest_ts timestamp")
    now = 1_782_295_200_000_000_000
    numbers = lambda text: sorted(r.line_no for r in sources.since(df, text, now).collect())
    assert numbers("") == [1, 2, 3] and numbers("60s") == [1] and numbers("60.5s") == [1, 2] and numbers("2026-06-24T09:00:00Z") == [1, 2]
    assert [r.raw for r in sources.stamped(df).orderBy("line_no").collect()] == ["2026-06-24T10:00:00Z a", "2026-06-24T09:58:59.12Z b", "c"]


def test_filters_reach_the_scan(spark, small):
    lines = spark.read.parquet(f"{small}/log_lines.parquet")
    plan = sources.since(lines, "1h", 1_782_295_200_000_000_000).select("line_no")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ingest_ts), GreaterThanOrEqual(ingest_ts" in plan and "raw" not in plan.split("ReadSchema:")[1]


def test_one_container(spark, small):
    lines, streams = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("log_lines", "streams"))
    first = streams.where("instance = 'current'").orderBy("stream_id").first()
    own = sources.one_container(lines, streams, first.namespace, first.pod, first.container)
    assert {r.stream_id for r in own.select("stream_id").distinct().collect()} == {first.stream_id}
    label = sources.labelled_lines(lines, spark.read.parquet(f"{small}/pods.parquet"), streams, "app").select(sources.prefixed(F.col("label"), F.col("raw")).alias("x"))
    assert label.where("x like '%/% %'").count() > 0


def test_a_digest_survives_a_stream_that_fails(spark, tmp_path):
    import gzip

    from logloom.operators.digest import totals
    from logloom.operators.grouping import query_lines
    from logloom.options import QueryOptions

    (tmp_path / "a.log").write_text("INFO one\nERROR two\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"WARN three\n" * 9)[:-12] + b"broken")
    lines = sources.read_lines(spark, str(tmp_path), skip_failed=True)
    kept = query_lines(lines, QueryOptions.of("TRACE"))
    assert {r.raw for r in kept.collect()} >= {"INFO one", "ERROR two"} and totals(kept).first().lines >= 2
    with pytest.raises(Exception):  # noqa: B017
        sources.read_lines(spark, str(tmp_path)).collect()
