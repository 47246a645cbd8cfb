"""Blank handling, message templates and other small text Columns.

Fixed patterns are written in the intersection of RE2 and Java syntax or with
explicit ASCII look-arounds, so that both dialects give the same matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters, as a regex class body.
BLANK = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_HEX_WORD = r"(?<![0-9A-Za-z_])[0-9a-fA-F]{8,}+(?![0-9A-Za-z_])"


def trim_blanks(col: Column) -> Column:
    """``col`` without Unicode white space at both ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(col, f"^[{BLANK}]++", ""), f"(?<![{BLANK}])[{BLANK}]++\\z", "")


def is_blank(col: Column) -> Column:
    """True for null, empty and all-blank text; never null."""
    return F.coalesce(~col.rlike(f"[^{BLANK}]"), F.lit(True))


def strip_cr(col: Column) -> Column:
    """``col`` without one carriage return at its end."""
    return F.regexp_replace(col, r"\r\z", "")


def message_template(col: Column) -> Column:
    """Digest template: trimmed, hexadecimal words of 8+ and digit runs become ``#``."""
    return F.regexp_replace(F.regexp_replace(trim_blanks(col), _HEX_WORD, "#"), "[0-9]+", "#")


def saying(col: Column) -> Column:
    """What a message says: lower case, single blanks, no words that hold a digit."""
    words = F.regexp_replace(F.lower(col), f"(?<![^{BLANK}])[^{BLANK}\\p{{Nd}}]*+\\p{{Nd}}[^{BLANK}]*+", "")
    return F.trim(F.regexp_replace(words, f"[{BLANK}]++", " "))


#: Characters that could steer a terminal or hide in a line, all but the tab.
UNSAFE = r"\x{00}-\x{08}\x{0A}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{2028}\x{2029}\x{FEFF}"
_UNSAFE_CODES = [*range(9), *range(10, 32), *range(127, 160), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x2028, 0x2029, 0xFEFF]


def sanitize(col: Column) -> Column:
    """``col`` with unsafe characters spelt ``\\xNN`` or ``\\uNNNN``; null stays null.

    Only texts that hold one are rewritten; doing it again changes nothing. Text in Spark
    is valid UTF-8: bytes that are not were replaced when the line was read.
    """
    spelt = F.map_from_arrays(F.array(*[F.lit(chr(c)) for c in _UNSAFE_CODES]), F.array(*[F.lit(f"\\x{c:02X}" if c <= 0xFF else f"\\u{c:04X}") for c in _UNSAFE_CODES]))
    chars = F.transform(F.split(col, "", -1), lambda c: F.coalesce(F.element_at(spelt, c), c))
    return F.when(col.rlike(f"[{UNSAFE}]"), F.array_join(chars, "")).otherwise(col)


def needs_attention(col: Column) -> Column:
    """Whether a text speaks of an error, a failure or a warning; false for null."""
    return F.coalesce(F.lower(col).rlike("error|failed|warn"), F.lit(False))


_COLLECTOR = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z "


def behind_collector(col: Column) -> Column:
    """A raw line without a collector's time and the one blank behind it."""
    return F.regexp_replace(col, _COLLECTOR, "")


def is_indented(raw: Column) -> Column:
    """Whether the content of a raw line begins with a blank or a tab; false for null."""
    return F.coalesce(behind_collector(raw).rlike(r"\A[ \t]"), F.lit(False))


def is_trace_boundary(raw: Column) -> Column:
    """Whether a raw line opens, chains or closes a stack trace; false for null. All loops
    are possessive or over one class, so long lines do not recurse."""
    word = r"(?i)\A(?:Traceback \(most recent call last\):|goroutine [0-9]+|Caused by:|[A-Za-z0-9_.$]*?(?:Error|Exception|Panic)(?![A-Za-z0-9_])[\t\n\f\r ]*+:)"
    frame = r"\A\(?[A-Za-z0-9_./*-]+\.[A-Za-z0-9_]+\([^\n]*\)"
    text = behind_collector(raw)
    return F.coalesce(text.rlike(word) | text.rlike(frame), F.lit(False))


def bounded_line(col: Column, most: int = 1 << 20) -> Column:
    """A line without the carriage return at its end, cut at ``most`` bytes with a marker.

    A character that the cut splits becomes U+FFFD. The marker follows the cut text only.
    """
    cut = F.decode(F.substring(F.encode(col, "UTF-8"), 1, most), "UTF-8")
    return F.when(F.octet_length(col) > most, F.concat(strip_cr(cut), F.lit(" …[line truncated]"))).otherwise(strip_cr(col))


def quoted(col: Column) -> Column:
    """A text as the value of a shown field: sanitized, in quotes where it could be misread."""
    safe = sanitize(col)
    return F.when(safe == "", '""').when(safe.rlike(r"[ =,\"'\[\]{}()]"), F.concat(F.lit('"'), safe, F.lit('"'))).otherwise(safe)
