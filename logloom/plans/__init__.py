"""Query registry: name -> callable over the tables of a folder, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.operators.entries import line_entries
from logloom.operators.zones import text_instants
from logloom.plans.core import QUERIES as CORE
from logloom.plans.sql import SQL
from logloom.runtime import table
from logloom.sources.records import failing_records

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records that do not fit their declared format, with the reason."""
    return failing_records(table(spark, sf_dir, "raw_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of raw log lines."""
    return line_entries(table(spark, sf_dir, "log_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every time text that is a real time."""
    return text_instants(table(spark, sf_dir, "json_entries"), table(spark, sf_dir, "timeline_items"), table(spark, sf_dir, "zone_names"))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, **CORE}
__all__ = ["QUERIES", "SQL"]
