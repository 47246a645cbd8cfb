"""Queries of this subpackage: name -> callable over the tables of a folder, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.encode import encode_texts
from logloom.llm.frequent import frequent_messages
from logloom.llm.leaks import leaks
from logloom.llm.lookalikes import look_alikes
from logloom.llm.runs import all_runs
from logloom.plans.sql import BLANK, TEMPLATE
from logloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and message templates that are frequent among the decoded entries."""
    return frequent_messages(table(spark, sf_dir, "entries")).select("kind", "value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbours that say the same, of log entries and of cluster events."""
    return all_runs(table(spark, sf_dir, "entries"), table(spark, sf_dir, "pod_events"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the questions whose passages they hold."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents stored differently that look the same."""
    return look_alikes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p4_found": p4_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found}

_OTHER = BLANK.replace("[", "[^", 1)
_SAYS = f"regexp_matches(message, '{_OTHER}')"
_SAID = f"trim(regexp_replace(regexp_replace(lower(message), '(^|{BLANK}){_OTHER}*\\p{{Nd}}{_OTHER}*', '\\1', 'g'), '{BLANK}+', ' ', 'g'))"
SQL: dict[str, str] = {
    "p1_found": f"WITH base AS (SELECT message FROM entries WHERE {_SAYS}), v AS (SELECT 'message' AS kind, message AS value FROM base UNION ALL SELECT 'template', {TEMPLATE} FROM base), c AS (SELECT kind, value, count(*) AS n FROM v GROUP BY ALL) SELECT kind, value FROM c WHERE n * 1000 >= 5 * (SELECT count(*) FROM base)",
    "p4_found": f"""WITH e AS (SELECT DISTINCT coalesce(stream_id, '') AS k, line_no::BIGINT AS no, message, epoch_us(ts) AS us FROM entries WHERE line_no IS NOT NULL),
      v AS (SELECT DISTINCT coalesce(namespace, '') || '/' || coalesce(object_name, '') AS k, event_id AS no, reason, message, epoch_us(coalesce(event_time, last_ts, first_ts, created_ts)) AS us, CASE WHEN series_count > 0 THEN series_count WHEN count > 0 THEN count ELSE 1 END AS w FROM pod_events WHERE event_id IS NOT NULL),
      r AS (SELECT 'entry' AS src, k, no AS ord, no, CASE WHEN {_SAYS} THEN {_SAID} END AS said, us, 1 AS w FROM e UNION ALL SELECT 'event', k, us, no, CASE WHEN {_SAYS} THEN lower(coalesce(reason, '')) || chr(10) || {_SAID} END, us, w FROM v),
      n AS (SELECT *, row_number() OVER (PARTITION BY src, k ORDER BY ord NULLS FIRST, no) AS rn, row_number() OVER (PARTITION BY src, k, said ORDER BY ord NULLS FIRST, no) AS rv FROM r)
      SELECT src, k AS seq_key, arg_min(no, rn) AS first_no, arg_max(no, rn) AS last_no, count(*) AS n_rows, sum(w)::BIGINT AS n_total, coalesce(arg_max(us, rn) - arg_min(us, rn), 0)::BIGINT AS duration_us
      FROM n WHERE said IS NOT NULL GROUP BY src, k, said, rn - rv HAVING count(*) > 1""",
}
