"""Following lines as they arrive: the same groups and filters, one row of state a stream.

State of a stream is its inherited level and the verdict on its last entry. Lines of a
micro-batch are taken in order of their numbers, since Spark promises none within one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.functions.text import is_blank
from logloom.operators.decode import decode
from logloom.operators.grouping import _line_passes, entry_columns
from logloom.operators.predicates import where_column
from logloom.options import QueryOptions

OUT = "stream_id string, line_no bigint, raw string, level int, level_detected boolean, message string, format string, logger string, fields map<string,string>, fields_json string, ts_ns bigint, raw_line string, is_cont boolean, eff_level int"
_STATE = "parent int, where_a boolean, kept_a boolean"
_JUDGED = OUT.rpartition(", is_cont")[0] + ", may_continue boolean, _line boolean"


def _step(options_level: int, include: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parent, where_a, kept_a = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(frames)).sort_values("line_no", kind="stable")
        cont, levels, keep = [], [], []
        last = None
        for no, level, named, may, line_ok, where_ok in zip(rows["line_no"], rows["level"], rows["level_detected"], rows["may_continue"], rows["_line"], rows["_where"], strict=True):
            again, last = no == last, no
            goes_on = not named and may and parent is not None
            now = parent if goes_on else int(level)
            if named and not again:
                parent = now
            if not goes_on and not again:
                where_a = bool(where_ok) if now >= options_level else where_a
                kept_a = now >= options_level and bool(line_ok) and bool(where_ok)
            own = bool(line_ok) and where_a is not False
            good = kept_a if not goes_on else (own or kept_a) if include else (own and kept_a)
            cont.append(goes_on)
            levels.append(now)
            keep.append(bool(good) and now >= options_level and not again)
        state.update((parent, where_a, kept_a))
        rows = rows.assign(is_cont=cont, eff_level=levels)[keep]
        yield rows[[part.split()[0] for part in OUT.split(", ")]]

    return run


def follow(lines: DataFrame, options: QueryOptions) -> DataFrame:
    """Kept lines of a stream of ``stream_id``, ``line_no`` and ``raw``, as they arrive.

    What was kept is the same as in ``query_lines`` if each stream's lines arrive in order.
    Lines re-delivered within a micro-batch count once. A tail makes no sense without an
    end and is an error; seed one with ``query_lines`` before following.
    """
    if options.tail >= 0:
        raise ValueError("a tail needs an end: seed it with query_lines, then follow")
    some = lines.select("stream_id", "line_no", "raw").where(~is_blank(F.col("raw")))
    judged = decode(some, "raw", options.names)
    judged = judged.withColumn("_line", _line_passes(F.col("raw"), options)).withColumn("_where", where_column(options.where, entry_columns("level")))
    return judged.groupBy("stream_id").applyInPandasWithState(_step(options.min_level, bool(options.include)), OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def start(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write followed rows as Parquet; ``once`` takes what is there and ends. ``stop()`` of
    the query ends it cleanly."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
