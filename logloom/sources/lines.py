"""Raw lines: text files with an order of their own, bounds, time windows, stamps."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import bounded_line
from logloom.operators.cluster import previous_streams, selected_streams, small
from logloom.options import since_start

MAX_LINE = 1 << 20


def read_lines(spark: SparkSession, path: str, most: int = MAX_LINE, skip_failed: bool = False) -> DataFrame:
    """Lines of text files as ``stream_id`` (the file), ``line_no`` and ``raw``.

    Lines end at a line feed only; a carriage return before it goes, longer lines than
    ``most`` bytes are cut and marked. ``line_no`` rises along a file but has gaps: it is
    made of the byte at which the file's split begins and the count of lines in it. A file that
    does not exist is an error; an empty one gives no rows. With ``skip_failed`` a file that
    breaks off gives the lines read so far and the others go on, so a digest survives it.
    """
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", str(skip_failed).lower())
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("stream_id"), F.col("_metadata.file_block_start").alias("_at"))
    # Within a split lines come in order and the lower 33 bits count them; a split holds
    # fewer lines than bytes, so the place of the split plus the count rises along the file.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counted = lines.withColumn("_n", number)
    return counted.select("stream_id", (F.col("_at") + F.col("_n")).alias("line_no"), bounded_line(F.col("value"), most).alias("raw"))


def read_stdin(spark: SparkSession, text: str, most: int = MAX_LINE) -> DataFrame:
    """Lines of a text that came through a pipe, as ``read_lines`` gives them."""
    body = text.removesuffix("\n").split("\n") if text else []
    df = spark.createDataFrame([("-", i, line) for i, line in enumerate(body)], "stream_id string, line_no bigint, raw string")
    return df.withColumn("raw", bounded_line(F.col("raw"), most))


def source(spark: SparkSession, path: str | None, stdin: str = "") -> DataFrame:
    """Lines of a file or folder; of ``stdin`` for no path or ``-``. A missing file is an error."""
    if path in (None, "", "-"):
        return read_stdin(spark, stdin)
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    return read_lines(spark, path)


def lines_of(lines: DataFrame, streams: DataFrame) -> DataFrame:
    """Lines of given streams; streams go to all executors if they are few."""
    return lines.join(small(streams.select("stream_id").distinct()), "stream_id", "left_semi")


def one_container(lines: DataFrame, streams: DataFrame, namespace: str, pod: str, container: str, previous: bool = False) -> DataFrame:
    """Lines of one container, of its present or its earlier instance."""
    want = (F.col("namespace") == namespace) & (F.col("pod") == pod) & (F.col("container") == container)
    instance = F.coalesce("instance", F.lit("current")) == ("previous" if previous else "current")
    return lines_of(lines, streams.where(want & instance))


def labelled_lines(lines: DataFrame, pods: DataFrame, streams: DataFrame, selector: str) -> DataFrame:
    """Lines of all pods that a selector fits, each behind its ``label``; a union without
    an order across streams."""
    chosen = selected_streams(pods, streams, selector)
    return lines.join(small(chosen.select("stream_id", "label")), "stream_id")


def prefixed(label: Column, line: Column) -> Column:
    """A shown line behind the label of its stream."""
    return F.concat(label, F.lit(" "), line)


def since(lines: DataFrame, text: str, now_ns: int, column: str = "ingest_ts") -> DataFrame:
    """Lines from ``since`` on: a duration before ``now_ns`` or an RFC 3339 time. Rows
    without a time drop out where a bound is given. The filter reaches the scan."""
    start = since_start(text, now_ns)
    if start is None:
        return lines
    return lines.where(F.col(column) >= F.timestamp_micros(F.lit(-(-start // 1000))))


def stamped(lines: DataFrame, column: str = "ingest_ts", raw: str = "raw") -> DataFrame:
    """Lines with their ingest time in front, as a collector writes it; without one as they are."""
    us = F.unix_micros(F.col(column).cast("timestamp"))
    seconds = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"))
    fraction = F.regexp_replace(F.concat(F.lit("."), fraction), r"\.?0+\z", "")
    return lines.withColumn(raw, F.coalesce(F.concat(seconds, fraction, F.lit("Z "), F.col(raw)), F.col(raw)))


__all__ = ["labelled_lines", "lines_of", "one_container", "prefixed", "previous_streams", "read_lines", "since", "source", "stamped"]
