"""Text helpers as Spark columns: matching, escaping, labels and page numbers."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}]"

# `\b` written out for ASCII word characters: Java changed its meaning between
# versions, and the detectors are defined on ASCII words.
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def quoted(literal: str) -> str:
    """A regular expression that matches exactly this text."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() and c != "\n" else c for c in literal)


def literal_pattern(query: str, match_case: bool = False, whole_word: bool = False) -> str:
    body = quoted(query)
    if whole_word:
        # next to a word character an edge means no word character, and the reverse
        word = re.compile(r"[A-Za-z0-9_]")
        before = "(?<![A-Za-z0-9_])" if word.match(query[0]) else "(?<=[A-Za-z0-9_])"
        after = "(?![A-Za-z0-9_])" if word.match(query[-1]) else "(?=[A-Za-z0-9_])"
        body = before + body + after
    return body if match_case else "(?iu)" + body


def flat_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of all lists and the number of the list each is in."""
    counts = np.asarray(lists.value_lengths().fill_null(0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), counts)


def sums_by_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running sums that begin anew in each row."""
    sums = np.cumsum(values)
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    base = np.zeros(len(values), dtype=np.int64)
    if len(begins):
        base = np.repeat(sums[begins] - values[begins], np.diff(begins, append=len(values)))
    return sums - base


def running_starts(lengths: Column, gap: int = 0) -> Column:
    """Start of every item when items of these lengths follow each other `gap` apart; one running sum over a batch."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(lengths: pa.Array) -> pa.Array:
        width, row = flat_lists(lengths)
        starts = sums_by_row(width + gap, row) - width - gap
        ends = np.cumsum(np.bincount(row, minlength=len(lengths)))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(starts.astype(np.int32)))

    return run(lengths)


def cut_at(text: Column, pattern: str) -> list[Column]:
    """Columns `_m` (all matches) and `_p` (the pieces between them) of a text.

    Select them before placing the matches: nested in one expression they would
    be computed again for every use. The pattern must not match "".
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("_m")
    return [found, F.split(text, pattern, -1).alias("_p")]


def around(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The text from `before` characters ahead of a match to `after` behind it."""
    begin = F.greatest(start - before, F.lit(0))
    return F.substring(text, begin + 1, start + length + after - begin)


@F.pandas_udf(T.StringType())
def fold_marks(texts: pd.Series) -> pd.Series:
    """Drop combining marks; canonical decomposition has no Spark built-in."""

    def fold(text):
        if text is None or text.isascii():
            return text
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
        return unicodedata.normalize("NFC", plain)

    return texts.map(fold)


def normalised(text: Column, match_case: bool = False) -> Column:
    """Viewer-side form of a text: folded case and marks, single blanks."""
    return collapsed(fold_marks(text if match_case else F.lower(text)))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Escapes of the exchange formats.
HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
XML = [*HTML, ('"', "&quot;"), ("'", "&apos;")]
PDF = [("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r")]


def html_escape(text: Column) -> Column:
    return _replaced(text, HTML)


def xml_escape(text: Column) -> Column:
    return _replaced(text, XML)


def xml_unescape(text: Column) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(XML)])


def pdf_escape(text: Column) -> Column:
    return _replaced(text, PDF)


def kind_label(kind: Column) -> Column:
    """snake_case to Title Case"""
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def content_preview(text: Column) -> Column:
    """80 characters and an ellipsis when the text is longer than 80 bytes."""
    cut = F.concat(F.substring(text, 1, 80), F.lit("…"))
    return F.when(text.isNull(), "").when(F.octet_length(text) > 80, cut).otherwise(text)


def short_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, HH:mm"), F.lit(""))


def utc_datetime(ts: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit(""))


def pdf_date(ts: Column) -> Column:
    stamp = F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("'00'"))
    return F.coalesce(stamp, F.lit("D:00000000000000"))


def float_text(value: Column, decimals: int) -> Column:
    """The shortest text of a rounded double, such as 1.5 or 12.0"""
    return F.round(value, decimals).cast("string")


def format_bytes(n: Column) -> Column:
    mib, kib = 1024.0 * 1024.0, 1024.0
    return (
        F.when(n >= mib, F.concat(float_text(n / mib, 2), F.lit(" MB")))
        .when(n >= kib, F.concat(float_text(n / kib, 1), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def roman(number: Column) -> Column:
    """Upper-case Roman numeral; digits from 4000 on, "0" up to zero."""

    def place(unit: int, one: str, five: str, ten: str) -> Column:
        glyphs = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        digit = (F.floor(number / unit) % 10).cast("int")
        return F.element_at(F.array(*[F.lit(g) for g in glyphs]), digit + 1)

    thousands = F.repeat(F.lit("M"), F.floor(number / 1000).cast("int"))
    text = F.concat(thousands, place(100, "C", "D", "M"), place(10, "X", "L", "C"), place(1, "I", "V", "X"))
    return F.when(number <= 0, "0").when(number >= 4000, number.cast("string")).otherwise(text)


def alpha(number: Column, upper: bool) -> Column:
    """Spreadsheet letters: 1 is a, 26 is z, 27 is aa; other numbers stay digits."""
    base = ord("A") if upper else ord("a")
    # 14 letters cover every 64-bit number
    letters = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        F.struct(number.cast("bigint").alias("left"), F.lit("").alias("text")),
        lambda acc, _: F.struct(
            F.when(acc["left"] > 0, F.floor((acc["left"] - 1) / 26)).otherwise(0).cast("bigint").alias("left"),
            F.concat(
                F.when(acc["left"] > 0, F.char((acc["left"] - 1) % 26 + base)).otherwise(""), acc["text"]
            ).alias("text"),
        ),
        lambda acc: acc["text"],
    )
    return F.when(number > 0, letters).otherwise(number.cast("string"))


def page_number_text(page_index: Column, page_count: Column, style: Column, start_at: Column) -> Column:
    """Stamp text of a page in one of the styles 1, i, I, a, A or page_of."""
    n = (start_at + page_index).cast("bigint")
    return (
        F.when(style == "page_of", F.concat(F.lit("Page "), n, F.lit(" of "), page_count))
        .when(style == "1", n.cast("string"))
        .when(style == "i", F.lower(roman(n)))
        .when(style == "I", roman(n))
        .when(style == "a", alpha(n, upper=False))
        .when(style == "A", alpha(n, upper=True))
        .otherwise(style)
    )
