"""Entries of several lines: inherited levels, filters that keep entries whole, tails.

All state is "the last value that is not null so far" or a running count, along the lines
of a stream. Streams are cut into blocks, so that a hot one is many tasks: windows run
inside a block, and one small row per block carries the state into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.fields import LOGGER, STRUCTURED
from logloom.functions.text import is_blank
from logloom.operators.blocks import block_between, sequence_cuts
from logloom.operators.decode import decode
from logloom.operators.patterns import matches_any
from logloom.operators.predicates import where_column
from logloom.options import QueryOptions
from logloom.runtime import materialize

BLOCK = "_block"
#: Rows of a block: with their texts some 100 MB to sort in a task.
TARGET_ROWS = 1 << 18


def cut_blocks(df: DataFrame, seq: str, order: str, target_rows: int = TARGET_ROWS) -> tuple[DataFrame, bool]:
    """``df`` with the block of each row, and whether any sequence may have several."""
    number = F.col(order).cast("bigint")
    cuts = sequence_cuts(df, seq, number, target_rows)
    return df.withColumn(BLOCK, block_between(number, F.lit(None).cast("bigint"), cuts, target_rows)), bool(cuts)


def along(seq: str, order: str):
    """All rows of a block up to the current one."""
    return Window.partitionBy(seq, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_known(df: DataFrame, seq: str, order: str, values: dict[str, Column], many: bool) -> DataFrame:
    """``df`` with, for each name, the last value that is not null up to the current row.

    With ``many`` blocks, what a block begins with comes from the blocks before it; ``df``
    is then read twice and should be a table.
    """
    inside = {name: F.last(value, ignorenulls=True).over(along(seq, order)) for name, value in values.items()}
    if not many:
        return df.withColumns(inside)
    ends = df.groupBy(seq, BLOCK).agg(*[F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_end_{name}") for name, value in values.items()])
    before = Window.partitionBy("_seq").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(seq).alias("_seq"), F.col(BLOCK).alias("_in"), *[f"_end_{name}" for name in values])
    ends = ends.select("_seq", "_in", *[F.last(f"_end_{name}", ignorenulls=True).over(before).alias(f"_begin_{name}") for name in values])
    out = df.withColumns(inside).join(ends, F.col(seq).eqNullSafe(F.col("_seq")) & (F.col(BLOCK) == F.col("_in")), "left")
    return out.withColumns({name: F.coalesce(name, f"_begin_{name}") for name in values}).drop("_seq", "_in", *[f"_begin_{name}" for name in values])


def count_from_end(df: DataFrame, seq: str, order: str, one: Column, name: str, many: bool) -> DataFrame:
    """``df`` with the number of rows for which ``one`` is true from the current row on."""
    rest = Window.partitionBy(seq, BLOCK).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.sum(one.cast("bigint")).over(rest))
    if not many:
        return out
    sums = df.groupBy(F.col(seq).alias("_seq"), F.col(BLOCK).alias("_in")).agg(F.sum(one.cast("bigint")).alias("_n"))
    later = Window.partitionBy("_seq").orderBy(F.col("_in").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_seq", "_in", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    out = out.join(sums, F.col(seq).eqNullSafe(F.col("_seq")) & (F.col(BLOCK) == F.col("_in")), "left")
    return out.withColumn(name, F.col(name) + F.col("_later")).drop("_seq", "_in", "_later")


def classify(entries: DataFrame, seq: str = "stream_id", order: str = "line_no", many: bool = False) -> DataFrame:
    """Decoded lines with ``is_cont`` and ``eff_level``.

    A line with a level of its own starts an entry. One without that is indented or part of
    a stack trace goes on with the entry before, at the level last named in the stream, if
    any was. Every other line is an entry of its own and leaves the inherited level alone.
    """
    out = last_known(entries, seq, order, {"_parent": F.when(F.col("level_detected"), F.col("level"))}, many)
    out = out.withColumn("is_cont", ~F.col("level_detected") & F.col("may_continue") & F.col("_parent").isNotNull())
    return out.withColumn("eff_level", F.when(F.col("is_cont"), F.col("_parent")).otherwise(F.col("level"))).drop("_parent")


def entry_columns(level: str = "eff_level") -> dict[str, Column]:
    """The columns that predicates and projections look at."""
    return {"level": F.col(level), **{n: F.col(n) for n in ("message", "raw_line", "logger", "fields", "ts_ns")}}


def keep_groups(entries: DataFrame, options: QueryOptions, raw: str = "raw", seq: str = "stream_id", order: str = "line_no", many: bool = False) -> DataFrame:
    """Rows that pass the level floor and the filters, entries kept whole.

    A line that starts an entry is judged by itself. One that goes on is judged by patterns
    on its own text and by the predicates on its entry: with include patterns it is kept if
    it or its entry is, without only if both are.
    """
    floor = F.col("eff_level") >= options.min_level
    if not (options.include or options.exclude or options.where):
        # Without filters a line that goes on has its entry's level, or stale state of one.
        out = last_known(entries, seq, order, {"_kept": F.when(~F.col("is_cont"), floor)}, many)
        return out.where(floor & F.coalesce(F.col("_kept"), F.lit(True))).drop("_kept")
    out = entries.withColumn("_line", _line_passes(F.col(raw), options)).withColumn("_where", where_column(options.where, entry_columns()))
    starts = ~F.col("is_cont")
    if many:
        out = materialize(out, "judged")
    state = {"_where_a": F.when(starts & floor, F.col("_where")), "_kept_a": F.when(starts, floor & F.col("_line") & F.col("_where"))}
    out = last_known(out, seq, order, state, many)
    own = F.col("_line") & F.coalesce(F.col("_where_a"), F.lit(True))
    kept = F.coalesce(F.col("_kept_a"), F.lit(False))
    keep = F.when(starts, kept).otherwise((own | kept) if options.include else (own & kept))
    return out.where(floor & keep).drop("_line", "_where", "_where_a", "_kept_a")


def _line_passes(raw: Column, options: QueryOptions) -> Column:
    passes = matches_any(raw, options.include) if options.include else F.lit(True)
    return passes & ~matches_any(raw, options.exclude) if options.exclude else passes


def tail_entries(kept: DataFrame, n: int, seq: str = "stream_id", order: str = "line_no", many: bool = False) -> DataFrame:
    """The last ``n`` entries of each stream with the lines that go on with them; lines
    before the first entry always stay. 0 keeps nothing, a negative ``n`` everything."""
    if n < 0:
        return kept
    if n == 0:
        return kept.where("false")
    starts = ~F.col("is_cont")
    out = count_from_end(kept, seq, order, starts, "_left", many)
    # entries that begin after this row; a row of the last entry has none
    after = F.col("_left") - starts.cast("bigint")
    first = last_known(out.withColumn("_after", after), seq, order, {"_begun": F.when(starts, F.lit(1))}, many)
    return first.where((F.col("_after") < n) | F.col("_begun").isNull()).drop("_left", "_after", "_begun")


def query_lines(lines: DataFrame, options: QueryOptions, seq: str = "stream_id", order: str = "line_no", raw: str = "raw", target_rows: int = TARGET_ROWS, bags: bool = True) -> DataFrame:
    """Decode, group, filter and tail raw lines: the rows that a query shows or counts.

    Null and blank lines are dropped first; a line delivered again (same stream, same
    number) counts once. Rows with a null number come first in their stream; rows of a null
    stream form one. An empty table gives no rows. Without ``bags`` the fields of lines are
    read only if a predicate needs them, and come out null else.
    """
    some = lines.where(~is_blank(F.col(raw)))
    cut, many = cut_blocks(some, seq, order, target_rows)
    needs = any(p.kind in (STRUCTURED, LOGGER) for p in options.where)
    decoded = decode(cut, raw, options.names, bags or needs)
    if many:
        decoded = materialize(decoded, "decoded")
    again = F.lag(F.struct(F.col(order), F.lit(1))).over(Window.partitionBy(seq, BLOCK).orderBy(order))
    once = decoded.withColumn("_again", F.coalesce(again == F.struct(F.col(order), F.lit(1)), F.lit(False)) & F.col(order).isNotNull()).where(~F.col("_again")).drop("_again")
    kept = keep_groups(classify(once, seq, order, many), options, raw, seq, order, many)
    if options.tail >= 0:
        kept = tail_entries(materialize(kept, "kept") if many else kept, options.tail, seq, order, many)
    return kept.drop(BLOCK)
