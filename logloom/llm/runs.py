"""Runs of neighbours that say the same, collapsed to one row each.

Within a sequence, the row number minus the row number among equal values is constant
exactly along a run. Sequences are cut into blocks so that a hot one spreads over
tasks; runs that touch a block edge are joined in a second pass over edge runs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import is_blank, saying
from logloom.operators.blocks import TARGET_ROWS, block_between, order_cuts
from logloom.operators.cluster import event_time


def collapse_runs(df: DataFrame, seq: list[str], order: str, number: str, value: str, at_us: str, weight: str, target_rows: int = TARGET_ROWS, min_rows: int = 1) -> DataFrame:
    """One row per longest run of neighbours with equal ``value``.

    ``seq`` names the sequence, ``order`` and then ``number`` order it, and
    ``number`` identifies a row within it: repeated rows count once. A null ``value``
    belongs to no run and ends one. Rows with a null ``order`` or ``number`` come
    first in their sequence. Null keys form a sequence of their own. Columns of ``df``
    beyond those named are ignored, whatever their names.

    Returns ``seq``, ``first_no``, ``last_no``, ``n_rows``, ``n_total`` (sum of
    ``weight``) and ``duration_us``: last minus first time known in the run, 0 where
    no time is known. Runs shorter than ``min_rows`` are left out.
    """
    keys = [f"_k{i}" for i in range(len(seq))]
    rows = df.select(
        *[F.col(s).alias(k) for s, k in zip(seq, keys, strict=True)],
        F.col(order).cast("bigint").alias("_order"),
        F.col(number).cast("bigint").alias("_no"),
        F.col(value).alias("_value"),
        F.col(at_us).cast("bigint").alias("_us"),
        F.col(weight).cast("bigint").alias("_weight"),
    )
    rows = rows.withColumn("_block", block_between(F.col("_order"), F.col("_no"), order_cuts(rows, F.col("_order"), target_rows, F.col("_no")), target_rows))
    part = [*keys, "_block"]
    along = Window.partitionBy(*part).orderBy("_order", "_no")
    once = rows.withColumn("_seen", F.lag(F.struct("_order", "_no")).over(along).eqNullSafe(F.struct("_order", "_no")) & F.col("_no").isNotNull()).where(~F.col("_seen"))
    numbered = once.withColumns(
        {
            "_rn": F.row_number().over(along),
            "_tail": F.lead(F.lit(1)).over(along).isNull(),
            "_rv": F.row_number().over(Window.partitionBy(*part, "_value").orderBy("_order", "_no")),
        }
    )
    place = F.struct("_order", "_no")
    known = F.when(F.col("_us").isNotNull(), F.struct("_order", "_no", "_us"))
    runs = numbered.groupBy(*part, "_value", (F.col("_rn") - F.col("_rv")).alias("_gap")).agg(
        F.min(place).alias("_first"),
        F.max(place).alias("_last"),
        F.min(known).alias("_us_first"),
        F.max(known).alias("_us_last"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("_weight").alias("_total"),
        (F.min("_rn") == 1).alias("_head"),
        F.max("_tail").alias("_tail"),
    )
    edge = F.col("_head") | F.col("_tail")
    kept = runs.where(edge | ((F.col("_n") >= min_rows) & F.col("_value").isNotNull()))
    kept = kept.withColumn("_part", F.when(edge, F.lit(-1)).otherwise(F.col("_block"))).withColumn("_edge", edge)
    across = Window.partitionBy(*keys, "_edge", "_part").orderBy("_first")
    joined = F.lag("_tail").over(across) & F.col("_head") & (F.lag("_value").over(across) == F.col("_value"))
    islands = kept.withColumn("_new", F.when(F.col("_edge") & F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    islands = islands.withColumn("_island", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.where(F.col("_value").isNotNull()).groupBy(*keys, "_edge", "_part", "_island").agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.min("_us_first").alias("_us_first"),
        F.max("_us_last").alias("_us_last"),
        F.sum("_n").alias("n_rows"),
        F.sum("_total").alias("n_total"),
    )
    return merged.where(F.col("n_rows") >= min_rows).select(
        *[F.col(k).alias(s) for s, k in zip(seq, keys, strict=True)],
        F.col("_first._no").alias("first_no"),
        F.col("_last._no").alias("last_no"),
        "n_rows",
        "n_total",
        F.coalesce(F.col("_us_last._us") - F.col("_us_first._us"), F.lit(0)).cast("bigint").alias("duration_us"),
    )


def entry_runs(entries: DataFrame, min_rows: int = 2) -> DataFrame:
    """Runs in each stream of log entries, by line number, over what messages say.

    Rows without a number have no place in a sequence and are left out; rows without a
    stream form one, named ''. Missing times count for nothing in durations.
    """
    rows = entries.where(F.col("line_no").isNotNull()).select(
        F.coalesce("stream_id", F.lit("")).alias("stream_id"),
        F.col("line_no").cast("bigint").alias("line_no"),
        F.when(~is_blank(F.col("message")), saying(F.col("message"))).alias("said"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.lit(1).alias("one"),
    )
    return collapse_runs(rows, ["stream_id"], "line_no", "line_no", "said", "us", "one", min_rows=min_rows)


def event_runs(events: DataFrame, min_rows: int = 2) -> DataFrame:
    """Runs in each object's events, by event time, over reason and what messages say.

    A null or blank message ends a run here as well; a null reason is like no reason, a
    null namespace or name like an empty one. Events without id are left out, those without
    any time come first in their sequence, in order of their ids.
    """
    count = F.when(F.col("series_count") > 0, F.col("series_count")).when(F.col("count") > 0, F.col("count")).otherwise(1)
    said = F.when(~is_blank(F.col("message")), F.concat(F.lower(F.coalesce("reason", F.lit(""))), F.lit("\n"), saying(F.col("message"))))
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in ("namespace", "object_name")]
    rows = events.where(F.col("event_id").isNotNull()).select(*keys, "event_id", said.alias("said"), F.unix_micros(event_time()).alias("us"), count.alias("times"))
    return collapse_runs(rows, ["namespace", "object_name"], "us", "event_id", "said", "us", "times", min_rows=min_rows)


def all_runs(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Runs of both sources with ``src`` and one ``seq_key`` for each sequence."""
    values = ["first_no", "last_no", "n_rows", "n_total", "duration_us"]
    said = entry_runs(entries).select(F.lit("entry").alias("src"), F.col("stream_id").alias("seq_key"), *values)
    key = F.concat("namespace", F.lit("/"), "object_name")
    happened = event_runs(events).select(F.lit("event").alias("src"), key.alias("seq_key"), *values)
    return said.unionByName(happened)
