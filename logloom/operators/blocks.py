"""Block arithmetic that keeps one hot sequence from becoming one task.

Order-dependent operators partition by (sequence, block) instead of by sequence, then
repair what crosses a block edge from one small row per block.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROWS, MOST_BLOCKS = 1 << 16, 1 << 14
#: Where a block begins: an order and a number within it; None is before all numbers.
Cut = tuple[int, int | None]


def _quantiles(df: DataFrame, value: Column, parts: int) -> list[int]:
    return df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []


def order_cuts(df: DataFrame, order: Column, target_rows: int = TARGET_ROWS, number: Column | None = None) -> list[Cut]:
    """Where to cut ``order`` so that about ``target_rows`` rows of ``df`` lie between two
    neighbours, however unevenly its values are spread. Equal orders stay together unless
    there is a ``number`` to cut them by: an order that fills several blocks alone is cut at
    quantiles of its numbers."""
    n = df.agg(F.count(order)).first()[0]
    parts = min(MOST_BLOCKS, -(-n // target_rows))
    if parts < 2:
        return []
    times = Counter(_quantiles(df, order, parts))
    cuts: list[Cut] = [(value, None) for value in times]
    if number is not None:
        for value, k in times.items():
            if k > 1:
                cuts += [(value, at) for at in set(_quantiles(df.where(order == value), number, k + 1))]
        # what is behind a crowded order begins a block of its own
        cuts += [(value + 1, None) for value, k in times.items() if k > 1 and (value + 1, None) not in cuts]
    return sorted(cuts, key=lambda c: (c[0], c[1] is not None, c[1] or 0))


def sequence_cuts(df: DataFrame, seq: str, order: Column, target_rows: int = TARGET_ROWS) -> list[Cut]:
    """Cuts for the sequences of ``df`` that hold more than ``target_rows`` rows; none if
    there are no such sequences. What comes together is one count for each sequence, partly
    summed before it is shuffled."""
    crowded = df.groupBy(F.col(seq).alias("_seq")).agg(F.count(order).alias("_n")).where(F.col("_n") > target_rows)
    most = crowded.agg(F.max("_n"), F.count(F.lit(1))).first()
    if not most[1]:
        return []
    # Few sequences can be that long: no more than all rows by target_rows.
    rows = df.select(F.col(seq).alias("_of"), order.alias("_order")).join(crowded.select("_seq"), F.col("_of").eqNullSafe(F.col("_seq")), "left_semi")
    return order_cuts(rows, F.col("_order"), target_rows)


def block_between(order: Column, number: Column, cuts: list[Cut], target_rows: int = TARGET_ROWS) -> Column:
    """Block number of a row: even, by ``cuts``; odd for a null ``order``, by ``number``. A
    binary search for the last cut that is not behind the row."""
    depth = len(cuts).bit_length()
    far: Cut = ((1 << 63) - 1, (1 << 63) - 1)
    padded = cuts + [far] * ((1 << depth) - 1 - len(cuts))
    orders = F.array(*[F.lit(c).cast("bigint") for c, _ in padded])
    numbered = any(m is not None for _, m in cuts)
    numbers = F.array(*[F.lit(m).cast("bigint") for _, m in padded]) if numbered else None

    def reached(i: Column) -> Column:
        at = F.element_at(orders, i)
        if numbers is None:
            return at <= order
        from_here = F.element_at(numbers, i)
        return (at < order) | ((at == order) & (from_here.isNull() | F.coalesce(from_here <= number, F.lit(False))))

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(depth))])
    known = F.aggregate(steps, F.lit(0), lambda at, s: F.when(reached(at + s), at + s).otherwise(at)) if cuts else F.lit(0)
    unknown = F.coalesce(2 * F.floor(number / F.lit(target_rows)).cast("bigint") + 1, F.lit(-(1 << 62) + 1))
    return F.when(order.isNull(), unknown).otherwise(2 * known.cast("bigint"))
