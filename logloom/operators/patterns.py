"""User patterns in RE2 syntax, matched unanchored by Arrow's kernels.

Java's dialect differs (``$``, ``.``, ``\\b``, named groups, classes) and its recursion
ends the JVM on long lines; RE2 takes linear time. All patterns of a list go through one
Arrow UDF, so a line travels to Python once.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def check_pattern(pattern: str) -> str:
    """The pattern itself; ValueError if RE2 does not take it."""
    try:
        pc.match_substring_regex(pa.array([""], pa.string()), pattern)
    except pa.ArrowInvalid as error:
        raise ValueError(f"invalid regex {pattern!r}: {error}") from None
    return pattern


def matches_any(col: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text matches one of the patterns somewhere; false for null and for no patterns."""
    if not patterns:
        return F.lit(False)
    checked = [check_pattern(p) for p in patterns]

    @F.arrow_udf("boolean")
    def any_match(texts: pa.Array) -> pa.Array:
        found = pc.match_substring_regex(texts, checked[0])
        for pattern in checked[1:]:
            found = pc.or_kleene(found, pc.match_substring_regex(texts, pattern))
        return pc.fill_null(found, False)

    return any_match(col)
