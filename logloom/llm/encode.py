"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Short texts are encoded in place. Long ones are cut into pieces that are encoded in
parallel and put together as a tree: where a cut fell inside one unbroken run of
letters (or digits, or signs), growing windows around the join are encoded again until
their first and last tokens agree with both sides; elsewhere the pieces just join.

Why this is exact. The splitting pattern restarts at certain places whatever came
before: between a non-blank and a blank, and between characters of different kinds
(letter, digit, other) except after an apostrophe. Cuts prefer such places. Within one
run, a token sequence is the encoding if and only if every two neighbours in it are
what the encoder makes of the two together; all neighbours lie within the left side,
the window or the right side, since the window shares its outer tokens with them.
"""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.runtime import ship

LONG_CHARS = 8192
_FLUSH_IDS = 1 << 20
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The White_Space characters of Unicode, as the splitting pattern knows them.
_SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")

#: ids, whether the start is a sure edge, and bytes of the first and of the last run.
Part = tuple[list[int], bool, int, int]


class Encoder:
    """A byte-level BPE of the tiktoken kind: ranks file plus the usual split pattern."""

    def __init__(self, ranks_path: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.whole.encode_ordinary
        self.single = self.whole._core_bpe.encode_single_piece
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.token_bytes = self.whole.decode_bytes

    @staticmethod
    def kind(char: str) -> str:
        """Letter, number, space or other; ? where tables of other versions may differ."""
        if char in _SPACES:
            return "S"
        first = unicodedata.category(char)
        return first[0] if first[0] in "LN" else "?" if first in ("Cn", "Cs") else "O"

    def restarts(self, text: str, at: int) -> bool:
        """Whether the split pattern surely has an edge at ``at``."""
        before, after = text[at - 1], text[at]
        a, b = self.kind(before), self.kind(after)
        if "?" in (a, b) or a == "S":
            return False
        return b == "S" or (a != b and before not in " '")

    def halves(self, text: str, most: int = LONG_CHARS) -> list[tuple[str, bool]]:
        """Cut a text into pieces of at most ``most`` characters, halving it again and
        again, each cut moved to a sure edge near the middle if there is one.

        Returns (piece, whether its start is a sure edge). A part without any place to
        cut, such as one long row of blanks or apostrophes, stays whole.
        """
        out: list[tuple[str, bool]] = []
        todo = [(0, len(text), True)]
        while todo:
            low, high, sure = todo.pop()
            if high - low <= max(most, 1):
                out.append((text[low:high], sure))
                continue
            middle, reach = (low + high) // 2, (high - low) // 4
            at = next((x for d in range(reach) for x in (middle + d, middle - d) if low < x < high and self.restarts(text, x)), None)
            cut, good = (at, True) if at is not None else (self._inside(text, low, high, middle), False)
            if cut is None:
                out.append((text[low:high], sure))
                continue
            todo += [(cut, high, good), (low, cut, sure)]
        return out

    def _inside(self, text: str, low: int, high: int, middle: int) -> int | None:
        """A cut within a run of one kind, L, N or O, away from apostrophes and from
        characters of unknown kind, else None."""
        for x in range(middle, high - 1):
            kind = self.kind(text[x])
            near = text[max(0, x - 4) : x + 4]
            if kind in "LNO" and x > low and self.kind(text[x - 1]) == kind and "'" not in near and all(self.kind(c) != "?" for c in near):
                return x
        return None

    def part(self, text: str, sure: bool) -> Part:
        """A piece encoded, with the lengths of its outer runs."""
        if not text:
            return [], sure, 0, 0
        runs = _splitter()(text)
        return self.encode(text), sure, len(runs[0].encode()), len(runs[-1].encode())

    def join(self, left: Part, right: Part) -> Part:
        """Two neighbouring pieces as one."""
        (li, sure, lh, lt), (ri, edge, rh, rt) = left, right
        if edge:
            return li + ri, sure, lh, rt
        lsize, rsize = sum(map(self.sizes.__getitem__, li)), sum(map(self.sizes.__getitem__, ri))
        reach = 4
        while True:
            i, a = self._back(li, lt, reach)
            j, b = self._forth(ri, rh, reach)
            assert a <= lt and b <= rh, "tokens cross the edge of a run"
            window = list(self.single(self.token_bytes(li[i:]) + self.token_bytes(ri[:j])))
            if (a == lt or window[0] == li[i]) and (b == rh or window[-1] == ri[j - 1]):
                ids = li[:i] + window + ri[j:]
                return ids, sure, lh if lh < lsize else lsize + rh, rt if rt < rsize else rsize + lt
            reach *= 2

    def _back(self, ids: list[int], size: int, reach: int) -> tuple[int, int]:
        i, taken = len(ids), 0
        while i and taken < size and reach:
            i, reach = i - 1, reach - 1
            taken += self.sizes[ids[i]]
        return i, taken

    def _forth(self, ids: list[int], size: int, reach: int) -> tuple[int, int]:
        j, taken = 0, 0
        while j < len(ids) and taken < size and reach:
            taken += self.sizes[ids[j]]
            j, reach = j + 1, reach - 1
        return j, taken

    def together(self, parts: list[Part]) -> list[int]:
        """Ids of all parts joined, as a tree: neighbours first, then pairs of pairs."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][0] if parts else []


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(_PATTERN).findall


@lru_cache(maxsize=4)
def encoder(ranks_path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(ranks_path)


def default_ranks() -> str:
    """Path of the installed 50k byte-level BPE."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def _lists(encoded: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in encoded], out=offsets[1:])
    flat = np.empty(offsets[-1], dtype=np.int32)
    for ids, at in zip(encoded, offsets, strict=False):
        flat[at : at + len(ids)] = ids
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _whole_batches(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            start, held, size = 0, [], 0
            for k, text in enumerate(batch.column("text").to_pylist()):
                held.append(enc.encode(text) if text else [])
                size += len(held[-1])
                if size >= _FLUSH_IDS or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column("_key").slice(start, len(held)), _lists(held)], names=["_key", "ids"])
                    start, held, size = k + 1, [], 0

    return run


def _cut_batches(ranks_path: str, most: int):
    """Pieces of texts. ``_id`` names a row by its content and, among equal rows of a
    partition, by its number: it is the same when the task runs again in another order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, times, place = encoder(ranks_path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                key = batch.column("_key").slice(k, 1)
                name = blake2b(repr(key.to_pylist()).encode() + b"\0" + text.encode(), digest_size=16).hexdigest()
                times[name] += 1
                cut = enc.halves(text, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{name}-{place}-{times[name]}"] * len(cut)), key.take(pa.array([0] * len(cut))), pa.array(range(len(cut)), pa.int32()), pa.array([s for _, s in cut], pa.bool_()), pa.array([t for t, _ in cut], pa.string())],
                    names=["_id", "_key", "_pos", "_sure", "text"],
                )

    return run


def _piece_batches(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            parts = [enc.part(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("_sure").to_pylist(), strict=True)]
            outer = [batch.column(n) for n in ("_id", "_key", "_pos", "_sure")]
            yield pa.RecordBatch.from_arrays([*outer, _lists([p[0] for p in parts]), pa.array([p[2] for p in parts], pa.int32()), pa.array([p[3] for p in parts], pa.int32())], names=["_id", "_key", "_pos", "_sure", "ids", "_head", "_tail"])

    return run


def _join_batches(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in batches:
            for k, parts in enumerate(batch.column("_parts")):
                pieces = sorted(parts.as_py(), key=lambda p: p["_pos"])
                ids = enc.together([(p["ids"], p["_sure"], p["_head"], p["_tail"]) for p in pieces])
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(k, 1), _lists([ids])], names=["_key", "ids"])

    return run


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", ranks_path: str | None = None, long_chars: int = LONG_CHARS) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row of ``df``, without special tokens.

    Null and empty texts give an empty list. Every input row gives one output row, also
    repeated rows and null keys; other columns are ignored, whatever their names; an
    empty table gives no rows. Texts above ``long_chars`` characters are cut, encoded in
    parallel and joined, with the same ids as a result. ``ranks_path`` must be readable
    at the same place on every executor.
    """
    ship(df.sparkSession)
    ranks_path = ranks_path or default_ranks()
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["_key"].dataType.simpleString()
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_whole_batches(ranks_path), f"_key {kind}, ids array<int>")
    pieces = rows.where(is_long).mapInArrow(_cut_batches(ranks_path, long_chars), f"_id string, _key {kind}, _pos int, _sure boolean, text string")
    coded = pieces.repartition("_id", "_pos").mapInArrow(_piece_batches(ranks_path), f"_id string, _key {kind}, _pos int, _sure boolean, ids array<int>, _head int, _tail int")
    parts = coded.groupBy("_id").agg(F.first("_key").alias("_key"), F.collect_list(F.struct("_pos", "_sure", "ids", "_head", "_tail")).alias("_parts"))
    joined = parts.select("_key", "_parts").mapInArrow(_join_batches(ranks_path), f"_key {kind}, ids array<int>")
    return short.unionByName(joined).select(F.col("_key").alias(key), "ids")
