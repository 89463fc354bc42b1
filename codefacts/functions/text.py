"""Text expressions: encoding-safe decoding, whitespace, line splitting and line counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.functions.paths import _c
from codefacts.profile import LINE_COMMENT_PREFIXES

#: characters that end a line, and the other white space, in Java regex classes
_BREAKS = r"\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
_BLANKS = r"\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: the same characters, each by itself
_SPACES = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029\t\x1f \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
LINE_BREAK = f"\\r\\n|[{_BREAKS}]"
#: the same breaks, begun with one class: of two ways to begin, Java tries both at every character
_ONE_BREAK = r"[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028-\u2029](?:(?<=\r)\n)?"


def _all_but(chars: str) -> str:
    """``[^chars]`` as the ranges in between: Java tests a negated class of several characters some fifteen times as slowly."""
    gaps, start = [], 0
    for at in sorted(map(ord, chars)):
        if start < at:
            gaps.append(f"\\x{{{start:x}}}-\\x{{{at - 1:x}}}")
        start = at + 1
    return f"[{''.join(gaps)}\\x{{{start:x}}}-\\x{{10ffff}}]"


_IN_LINE, _INK = _all_but(_SPACES[:10]), _all_but(_SPACES)


def strip(col: Column | str) -> Column:
    """Trim Unicode white space on both sides (SQL ``trim`` by itself only trims blanks); only the ends of the text are looked at."""
    return F.trim(_c(col), F.lit(_SPACES))


def strip_right(col: Column | str) -> Column:
    return F.rtrim(_c(col), F.lit(_SPACES))


def indent_width(col: Column | str) -> Column:
    return F.length(_c(col)) - F.length(F.ltrim(_c(col), F.lit(_SPACES)))


def first_line(col: Column | str) -> Column:
    """First line of the stripped text, itself stripped; null when there is none."""
    line = strip(F.get(F.split(strip(col), LINE_BREAK, 2), F.lit(0)))
    return F.when(line != "", line)


def split_lines(text: Column | str) -> Column:
    """Lines of a text; a break at the end does not open another line, an empty text has none."""
    t = _c(text)
    # the last break is found at the end, not by a pattern that is tried at every character
    ended = F.when(t.endswith("\r\n"), F.left(t, F.length(t) - 2)).when(F.right(t, F.lit(1)).isin(*_SPACES[:10]), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(ended, _ONE_BREAK))


def count_breaks(text: Column | str) -> Column:
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit("\n")))).cast("long")


def total_lines(text: Column | str) -> Column:
    """C11: ``\\n`` count, plus one for an unterminated last line."""
    t = _c(text)
    tail = F.when((F.length(t) > 0) & ~t.endswith("\n"), 1).otherwise(0)
    return (count_breaks(t) + tail).cast("long")


def code_lines(text: Column | str, comment_prefixes: tuple[str, ...] = LINE_COMMENT_PREFIXES) -> Column:
    """C11: lines that are neither blank nor start with a comment prefix, counted in one regex pass; a match takes its whole line."""
    escaped = "|".join("".join("\\" + ch for ch in prefix) for prefix in comment_prefixes)
    no_comment = f"(?!{escaped})" if escaped else ""
    pattern = f"(?<!{_IN_LINE})[{_BLANKS}]*+{no_comment}{_INK}{_IN_LINE}*+"
    return F.regexp_count(_c(text), F.lit(pattern)).cast("long")


@F.pandas_udf(T.StringType())
def _decode_legacy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decode bytes that are not UTF-8: GB18030, else UTF-8 with replacement characters."""

    def one(raw):
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return bytes(raw).decode("utf-8", errors="replace")

    for series in batches:
        yield series.map(one)


def decode_text(content: Column | str) -> Column:
    """A2: drop a UTF-8 byte-order mark, then UTF-8, else GB18030, else UTF-8 with replacement.

    Valid UTF-8 never leaves the JVM: the Python decoder only receives the bytes of the other rows.
    """
    raw = _c(content)
    bare = F.when(F.startswith(raw, F.lit(b"\xef\xbb\xbf")), F.substring(raw, 4, 2**31 - 1)).otherwise(raw)
    valid = F.is_valid_utf8(bare.cast("string"))
    return F.when(valid, bare.cast("string")).otherwise(_decode_legacy(F.when(~valid, bare)))
