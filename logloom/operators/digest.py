"""The digest of a query: totals, levels, HTTP status classes, time span, frequent messages.

Every figure is a partial and a final hash aggregate; only the digest text gathers the few
rows that result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.fields import status_class
from logloom.functions.levels import level_name
from logloom.functions.text import message_template
from logloom.functions.times import display_time

TOP = 5


def digest_message(message: Column, raw_line: Column) -> Column:
    """The text whose template an entry counts for: its message, else its raw text."""
    return F.coalesce(F.nullif(message, F.lit("")), raw_line)


def totals(kept: DataFrame) -> DataFrame:
    """``lines``, ``first_ns`` and ``last_ns`` of kept rows; rows that go on with an entry
    count, missing times do not. One row, also for an empty table."""
    return kept.agg(F.count(F.lit(1)).alias("lines"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


def level_counts(kept: DataFrame, level: str = "eff_level") -> DataFrame:
    """``level``, its name and ``n``, highest first; levels without rows are left out."""
    return kept.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn("level_name", level_name(F.col("level"))).orderBy(F.desc("level"))


def status_counts(kept: DataFrame) -> DataFrame:
    """``status_class`` 1 to 5 and ``n``, ascending; rows without a status are left out."""
    classes = kept.select(status_class(F.col("fields")).alias("status_class")).where(F.col("status_class").isNotNull())
    return classes.groupBy("status_class").agg(F.count(F.lit(1)).alias("n")).orderBy("status_class")


def template_counts(kept: DataFrame, raw_line: Column | None = None) -> DataFrame:
    """``template`` and ``n`` of all messages; null, empty and blank ones are left out."""
    text = F.col("message") if raw_line is None else digest_message(F.col("message"), raw_line)
    templates = kept.select(message_template(text).alias("template")).where(F.col("template") != "")
    return templates.groupBy("template").agg(F.count(F.lit(1)).alias("n"))


def top_templates(kept: DataFrame, raw_line: Column | None = None, n: int = TOP) -> DataFrame:
    """The ``n`` most frequent templates, ties in order of their bytes (a top-k report)."""
    return template_counts(kept, raw_line).orderBy(F.desc("n"), "template").limit(n)


def digest_text(kept: DataFrame, level: str = "eff_level", raw_line: Column | None = None) -> str:
    """The digest as text. Gathers one row of totals, six levels, five classes, five templates."""
    spans = totals(kept).select("lines", display_time(F.col("first_ns")).alias("a"), display_time(F.col("last_ns")).alias("b")).first()
    from logloom.operators.render import sanitized

    out = ["── stats ──", f"lines: {spans.lines}" + (f"   span: {spans.a} → {spans.b}" if spans.a else "")]
    levels = [f"{r.level_name} {r.n}" for r in level_counts(kept, level).collect()]
    classes = [f"{r.status_class}xx {r.n}" for r in status_counts(kept).collect()]
    out += [f"levels: {'  '.join(levels)}"] if levels else []
    out += [f"status: {'  '.join(classes)}"] if classes else []
    top = [f"  {r.n:5d}  {sanitized(r.template)}" for r in top_templates(kept, raw_line).collect()]
    return "\n".join([*out, *(["top messages:", *top] if top else [])]) + "\n"
