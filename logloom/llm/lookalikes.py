"""Documents stored differently that look the same."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.looks import Rewriter, countable, rewrites
from logloom.runtime import materialize, ship


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _counter(codes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
                counts[: len(seen)] += seen
        own = counts[codes]
        held = np.nonzero(own)[0]
        yield pa.RecordBatch.from_pydict({"code": pa.array([codes[i] for i in held], pa.int32()), "n": pa.array(own[held], pa.int64())})

    return run


def _former(changes: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = Rewriter(changes)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            form, stored = (pa.array([_digest(f(t)) for t in texts], pa.binary()) for f in (looks, str))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), form, stored], names=["doc_id", "form", "stored"])

    return run


def forms(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``form`` (digest of the common form: the class of texts that look the
    same) and ``stored`` (digest of the text) of every text neither null nor empty.

    Code points are counted over all texts first; what comes to the driver is one number
    for each code point of a look-alike class, some thousands at most.
    """
    ship(documents.sparkSession)
    rows = documents.select("doc_id", "text").where(F.length("text") > 0)
    counted = rows.select("text").mapInArrow(_counter(countable()), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    changes = rewrites({r.code: r.n for r in counted.collect()})
    return rows.mapInArrow(_former(changes), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, form binary, stored binary")


def look_alikes(documents: DataFrame) -> DataFrame:
    """``doc_id_a`` and ``doc_id_b`` (smaller first) of all pairs of documents whose texts
    are stored differently but look the same.

    Null and empty texts and null ids have no part in it, exact copies are no pair, an id
    that is repeated with one text counts once; other columns are ignored. Pairs are made
    of two different stored texts of a class first, then of the documents that hold them,
    so copies are never compared with each other.
    """
    members = materialize(forms(documents).where(F.col("doc_id").isNotNull()).distinct(), "look-alikes")
    mixed = members.groupBy("form").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where(F.col("low") != F.col("high")).select("form")
    texts = members.select("form", "stored").distinct().join(mixed, "form", "left_semi")
    pairs = texts.select("form", F.col("stored").alias("stored_a")).join(texts.select("form", F.col("stored").alias("stored_b")), "form").where(F.col("stored_a") < F.col("stored_b"))
    for x in "ab":
        pairs = pairs.join(members.select(F.col("stored").alias(f"stored_{x}"), F.col("doc_id").alias(f"_{x}")), f"stored_{x}")
    return pairs.where(F.col("_a") != F.col("_b")).select(F.least("_a", "_b").alias("doc_id_a"), F.greatest("_a", "_b").alias("doc_id_b")).distinct()
