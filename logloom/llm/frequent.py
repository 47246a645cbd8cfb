"""Most frequent values of a column with bounded memory.

Values are collapsed to (value, count) on the map side and hash-partitioned by value, so
each value is counted in one partition only. A partition runs a count-min sketch with
conservative update and keeps, in a bounded heap, the values whose estimate reaches the
wanted share of the rows it has seen so far: a value that is frequent in all rows is so in
its partition too, at its last occurrence at the latest, and a sketch never under-estimates.
The heaps of all partitions are disjoint; merged, they hold every frequent value, and one
exact count of the few candidates finishes the job.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import ceil, e, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import is_blank, message_template
from logloom.runtime import materialize, ship

SKETCH_WIDTH, MAX_WIDTH = 1 << 16, 1 << 20
SKETCH_DEPTH = 4
CAPACITY = 1 << 14
_FLUSH_ROWS, _FLUSH_BYTES = 1 << 18, 1 << 26
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class CountMinSketch:
    """Count-min sketch over 64-bit hashes with conservative update, a batch at a time.

    A batch must name each value once. A cell only rises to the largest new estimate
    that maps to it, so every value's cells stay at or above its true count.
    """

    def __init__(self, width: int = SKETCH_WIDTH, depth: int = SKETCH_DEPTH) -> None:
        if width & (width - 1) or not 1 <= depth <= len(_MIX):
            raise ValueError("width must be a power of two and depth between 1 and 8")
        self.shift = np.uint64(64 - (width.bit_length() - 1))
        self.depth = depth
        self.cells = np.zeros((depth, width), dtype=np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Add counts and return the new estimates."""
        at = [((hashes ^ (hashes >> np.uint64(29))) * _MIX[d]) >> self.shift for d in range(self.depth)]
        new = np.min([self.cells[d][at[d]] for d in range(self.depth)], axis=0) + counts
        for d in range(self.depth):
            np.maximum.at(self.cells[d], at[d], new)
        return new


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal values of up to so many rows or bytes as one row."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).group_by(["kind", "value", "hash"]).aggregate([("n", "sum")])
        yield from table.select(["kind", "value", "hash", "n_sum"]).rename_columns(["kind", "value", "hash", "n"]).to_batches()

    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _FLUSH_ROWS or size >= _FLUSH_BYTES:
            yield from flush(held)
            held, rows, size = [], 0, 0
    if rows:
        yield from flush(held)


def sketch_width(share: float, parts: int) -> int:
    """Width at which the expected error in one of ``parts`` partitions, e / width of its
    rows, stays below an eighth of the threshold; within fixed bounds of memory."""
    wanted = 8 * e / (share * parts)
    return min(MAX_WIDTH, max(SKETCH_WIDTH, 1 << ceil(log2(wanted))))


class Heap:
    """At most ``capacity`` values, the smallest estimate on top. What is pushed out while it
    still reaches the threshold is handed on, so nothing frequent is ever lost."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.best: dict[str, int] = {}
        self.order: list[tuple[int, str]] = []

    def offer(self, value: str, estimate: int, least: int) -> tuple[str, int] | None:
        """Take a value in. Returns one that had to leave though it reaches ``least``."""
        self.best[value] = estimate
        heappush(self.order, (estimate, value))
        if len(self.order) > 2 * self.capacity + 16:  # too many outdated entries
            self.order = [(n, v) for v, n in self.best.items()]
            heapify(self.order)
        out = None
        while len(self.best) > self.capacity:
            n, low = heappop(self.order)
            if self.best.get(low) == n:
                del self.best[low]
                out = (low, n) if n >= least else None
        return out


def _sketcher(share: Fraction, width: int, depth: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: str, found: list[tuple[str | None, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(found), pa.string()), "value": pa.array([v for v, _ in found], pa.string()), "estimate": pa.array([n for _, n in found], pa.int64())})

        sketches: dict[str, tuple[CountMinSketch, Heap]] = {}
        seen: Counter[str] = Counter()
        for batch in _collapse(batches):
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in sorted(set(kinds)):
                at = np.nonzero(kinds == kind)[0]
                part = batch.take(pa.array(at))
                sketch, heap = sketches.setdefault(kind, (CountMinSketch(width, depth), Heap(capacity)))
                hashes = part.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                counts = part.column("n").to_numpy(zero_copy_only=False)
                seen[kind] += int(counts.sum())
                least = max(1, ceil(share * seen[kind]))
                estimates = sketch.add(hashes, counts)
                heavy = np.nonzero(estimates >= least)[0]
                pushed = [heap.offer(v, n, least) for v, n in zip(part.column("value").take(pa.array(heavy)).to_pylist(), estimates[heavy].tolist(), strict=True)]
                if out := [x for x in pushed if x]:
                    yield rows(kind, out)
        for kind, (_, heap) in sketches.items():
            least = ceil(share * seen[kind])
            # The row without a value tells how many rows the partition has seen.
            yield rows(kind, [(None, seen[kind]), *((v, n) for v, n in heap.best.items() if n >= least)])

    return run


def _frequent(values: DataFrame, share: float, width: int | None, depth: int, capacity: int) -> DataFrame:
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    spark, exact = values.sparkSession, Fraction(str(share))
    ship(spark)
    ready = values.select("kind", "value", F.xxhash64("kind", "value").alias("hash"), F.lit(1).cast("bigint").alias("n"))
    small = ready.mapInArrow(_collapse, "kind string, value string, hash bigint, n bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heaps = small.repartition(parts, "hash").mapInArrow(_sketcher(exact, width or sketch_width(share, parts), depth, capacity), "kind string, value string, estimate bigint")
    heaps = materialize(heaps, "candidates")
    # One row for each kind comes to the driver: how many rows it has.
    totals = heaps.where(F.col("value").isNull()).groupBy("kind").agg(F.sum("estimate").alias("total")).collect()
    keep = F.lit(None).cast("bigint")
    for row in totals:
        keep = F.when(F.col("kind") == row.kind, ceil(exact * row.total)).otherwise(keep)
    # A value that was handed on several times had its last and largest estimate last.
    heavy = heaps.where(F.col("value").isNotNull()).groupBy("kind", "value").agg(F.max("estimate").alias("estimate")).where(F.col("estimate") >= keep)
    heavy = F.broadcast(heavy) if heavy.limit(capacity + 1).count() <= capacity else heavy.hint("merge")
    counted = values.join(heavy, ["kind", "value"]).groupBy("kind", "value", "estimate").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= keep)


def frequent_values(df: DataFrame, column: str, share: float = 0.005, width: int | None = None, depth: int = SKETCH_DEPTH, capacity: int = CAPACITY) -> DataFrame:
    """Values of ``column`` held by at least ``share`` of its non-null rows.

    Returns ``value``, ``estimate`` (sketch, never below the count) and ``n`` (exact).
    Null values are not rows of the base; repeated rows count each time; ties at the
    threshold are kept; an empty table gives no rows; other columns are ignored. Long
    values are handled whole. ``share`` must be in (0, 1]. A task holds at most
    ``capacity`` candidates at once, and no more than that are broadcast.
    """
    values = df.select(F.lit("").alias("kind"), F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull())
    return _frequent(values, share, width, depth, capacity).drop("kind")


def frequent_messages(entries: DataFrame, share: float = 0.005) -> DataFrame:
    """``kind``, ``value`` and ``n`` of the messages and of the templates held
    by at least ``share`` of the rows whose message is neither null nor blank. Both kinds go
    through one pass of the sketch and one of the exact count."""
    base = entries.select("message").where(~is_blank(F.col("message")))
    both = F.array(F.struct(F.lit("message").alias("kind"), F.col("message").alias("value")), F.struct(F.lit("template").alias("kind"), message_template(F.col("message")).alias("value")))
    return _frequent(base.select(F.inline(both)), share, None, SKETCH_DEPTH, CAPACITY).drop("estimate")
