"""Logs, cluster events and ends of containers on one line of time, for every pod."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.levels import level_name
from logloom.functions.text import sanitize, trim_blanks
from logloom.functions.times import display_time
from logloom.operators.cluster import MAX_EVENTS, kind_rank, normal_event, pod_events, small, terminations
from logloom.operators.render import details

COLUMNS = ("namespace", "pod", "ts_ns", "src_rank", "seq_key", "seq", "line")


def _nanos(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def _stamp(ts_ns: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), display_time(ts_ns), F.lit("]")), F.lit("[no timestamp]"))


def log_items(entries: DataFrame, streams: DataFrame, level: str = "eff_level") -> DataFrame:
    """LOG items of decoded entries of current streams."""
    shown = details(entries)
    fallback = sanitize(F.coalesce("message", F.lit("")))
    text = F.when(trim_blanks(shown) != "", shown).otherwise(fallback)
    line = F.concat(_stamp(F.col("ts_ns")), F.lit(" [LOG] ["), level_name(F.col(level)), F.lit("] "), text)
    whose = streams.where(F.coalesce("instance", F.lit("current")) == "current").select("stream_id", F.col("namespace").alias("_ns"), F.col("pod").alias("_pod"))
    own = entries.withColumn("line", line).select("stream_id", "line_no", "ts_ns", "line").join(small(whose), "stream_id")
    return own.select(F.col("_ns").alias("namespace"), F.col("_pod").alias("pod"), "ts_ns", F.lit(0).alias("src_rank"), F.col("stream_id").alias("seq_key"), F.col("line_no").cast("bigint").alias("seq"), "line")


def event_line(e: DataFrame) -> Column:
    """An event as a line: time, type, object, reason, message, and how often if more than once."""
    times = F.when(F.col("n") > 1, F.concat(F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    thing = F.when(F.col("object") != "", F.concat(F.lit(" "), sanitize(F.col("object")))).otherwise("")
    return F.concat(_stamp(_nanos(F.col("ts"))), F.lit(" [EVENT] ["), sanitize(F.col("type")), F.lit("]"), thing, F.lit(" "), sanitize(F.col("reason")), F.lit(": "), sanitize(F.col("message")), times)


def event_items(events: DataFrame, pods: DataFrame | None = None, limit: int | None = MAX_EVENTS) -> DataFrame:
    """EVENT items of pods, the first ``limit`` of each."""
    own = normal_event(pod_events(events, pods, limit))
    return own.select("namespace", F.col("object_name").alias("pod"), _nanos(F.col("ts")).alias("ts_ns"), F.lit(1).alias("src_rank"), F.lit("").alias("seq_key"), F.col("pos").cast("bigint").alias("seq"), event_line(own).alias("line"))


def termination_line() -> Column:
    """The end of a container as a line."""
    said = F.concat(
        F.lit('container "'), F.col("name"), F.lit('" exited with code '), F.coalesce("exit_code", F.lit(0)).cast("string"),
        F.when(F.coalesce("signal", F.lit(0)) != 0, F.concat(F.lit(" (signal "), F.col("signal").cast("string"), F.lit(")"))).otherwise(""),
        F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" — "), F.col("reason"))).otherwise(""),
        F.when(F.coalesce(trim_blanks(F.col("message")), F.lit("")) != "", F.concat(F.lit(": "), trim_blanks(F.col("message")))).otherwise(""),
    )
    return F.concat(_stamp(_nanos(F.col("finished_at"))), F.lit(" [TERM]"), F.when(F.col("previous"), " (previous)").otherwise(""), F.lit(" "), sanitize(said))


def termination_items(statuses: DataFrame) -> DataFrame:
    """TERM items of containers."""
    place = F.col("kind_rank") * 1_000_000 + F.coalesce("pos", F.lit(0)) * 2 + F.when(F.col("previous"), 0).otherwise(1)
    return terminations(statuses).select("namespace", "pod", _nanos(F.col("finished_at")).alias("ts_ns"), F.lit(2).alias("src_rank"), F.col("name").alias("seq_key"), place.cast("bigint").alias("seq"), termination_line().alias("line"))


def notices(events: DataFrame, pods: DataFrame | None = None, limit: int = MAX_EVENTS) -> DataFrame:
    """One notice for each pod whose events are more than ``limit``."""
    cut = pod_events(events, pods, limit).where("truncated").select("namespace", F.col("object_name").alias("pod")).distinct()
    return cut.withColumn("line", F.lit(f"[notice] event list truncated to the first {limit} events"))


def timeline(entries: DataFrame, streams: DataFrame, events: DataFrame, statuses: DataFrame, pods: DataFrame | None = None, level: str = "eff_level", limit: int | None = MAX_EVENTS) -> DataFrame:
    """All items of all pods, in order of pod and time.

    Items without time come last; at the same time logs come before events and those before
    ends, each in its own order. The order is a range sort, so no pod is one task.
    """
    items = log_items(entries, streams, level).unionByName(event_items(events, pods, limit)).unionByName(termination_items(statuses))
    return items.orderBy("namespace", "pod", F.col("ts_ns").asc_nulls_last(), "src_rank", "seq_key", "seq")


__all__ = ["COLUMNS", "event_items", "kind_rank", "log_items", "notices", "termination_items", "timeline"]
