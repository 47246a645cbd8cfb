"""Documents that hold passages of held-out questions.

A Wu-Manber search over words: the patterns are all passages of ``MIN_WORDS`` words of the
questions, a block is two words. The block under the end of the window decides how far it
may move: as far as the nearest place of this block in any pattern, over all but one of its
words where it stands in none. Only where it ends a pattern are those of its bucket with the
same first word compared, word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.looks import looks
from logloom.runtime import ship

MIN_WORDS = 12
MOST_CHARS = 1 << 24
_ASCII_WORD = re.compile("[a-z0-9]+").findall
#: Letters, decimal digits and the accents on them; no superscripts, subscripts or fractions.
_WORD = re.compile(r"(?:[^\W_\u00b2\u00b3\u00b9\u00bc-\u00be\u2070-\u209f\u2150-\u215f\u2460-\u249b\u24ea-\u24ff\u2776-\u2793]|[\u0300-\u036f\u3099\u309a])+").findall
_SPLIT_WORD = re.compile(r"(?<=[^\W_])- *\n\s*(?=[^\W_])")
_SOFT_END = re.compile(r"\u00ad(?=[^\S\r\n]*[\r\n])")


def words(text: str) -> list[str]:
    """The words of a text in small letters, with those split at a line end put together."""
    if "\u00ad" in text:
        text = _SOFT_END.sub("-", text)
    text = looks(text).lower()
    if "\n" in text:
        text = _SPLIT_WORD.sub("", text)
    return _ASCII_WORD(text) if text.isascii() else _WORD(unicodedata.normalize("NFC", text))


class Passages:
    """The search, over items as (id, text). Passages of fewer words than ``size`` are none."""

    def __init__(self, items: Iterable[tuple[int, str]], size: int = MIN_WORDS) -> None:
        self.size = size
        self.shift: dict[tuple[str, str], int] = {}
        #: last block of a pattern -> its first word -> patterns with their items
        self.buckets: dict[tuple[str, str], dict[str, dict[tuple[str, ...], set[int]]]] = {}
        for item, text in items:
            own = words(text)
            for i in range(len(own) - size + 1):
                window = tuple(own[i : i + size])
                bucket = self.buckets.setdefault(window[-2:], {}).setdefault(window[0], {})
                bucket.setdefault(window, set()).add(item)
                for k in range(1, size):
                    block, far = window[k - 1 : k + 1], size - 1 - k
                    self.shift[block] = min(far, self.shift.get(block, far))

    def search(self, text: str) -> set[int]:
        """Items of which the text holds a passage."""
        held: set[int] = set()
        own, size, far = words(text), self.size, self.size - 1
        shift, end, count = self.shift.get, far, len(own)
        while end < count:
            block = own[end - 1], own[end]
            step = shift(block, far)
            if not step:
                begin, step = end - size + 1, 1
                patterns = self.buckets.get(block, {}).get(own[begin])
                if patterns:
                    held |= patterns.get(tuple(own[begin : end + 1]), set())
            end += step
        return held


def _searcher(items: list[tuple[int, str]], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(items, size)
        for batch in batches:
            pairs = [(d, i) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i in sorted(passages.search(t))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in pairs], pa.int64()), "item_id": pa.array([i for _, i in pairs], pa.int64())})

    return run


def _blocks(items: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most so many characters (one item at least)."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.text) > most_chars:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def leaks(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``doc_id`` and ``item_id`` where a document holds at least ``min_words`` consecutive
    words of an item's text; each pair once.

    Null and empty texts and null ids have no part in it; items of fewer words than that
    are found nowhere; repeated rows count once; other columns are ignored; an empty table
    on either side gives no rows. The patterns of at most ``most_chars`` characters of items
    are sent to all tasks at once, more of them in blocks, each against all documents.
    """
    ship(documents.sparkSession)
    items = eval_items.select(F.col("item_id").cast("bigint"), "text").where((F.length("text") > 0) & F.col("item_id").isNotNull())
    rows = documents.select(F.col("doc_id").cast("bigint"), "text").where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    found = [rows.mapInArrow(_searcher(block, min_words), "doc_id bigint, item_id bigint") for block in _blocks(items, most_chars)]
    return reduce(DataFrame.unionByName, found).distinct() if found else documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint")
