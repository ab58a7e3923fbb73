"""Text columns: cleaning, truncation, fingerprints and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------
# Every code point Unicode counts as white space when stripping text.
WHITE_SPACE = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
# Stands where the middle of an over-long text was cut out.
CUT_MARK = "\n/* ... [中间代码已截断] ... */\n"
# Upper-cased class ids that mean "unknown".
UNKNOWN_CLASS_IDS = ["", "NAN", "NONE", "NVD-CWE-NOINFO", "NVD-CWE-OTHER"]
CLASS_ID_PREFIX = "CWE-"
# -------------------------------------------------------------------------


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Drop white space at both ends. Plain ``trim`` would only drop spaces;
    a trim set costs nothing inside the text, unlike an anchored regex."""
    return F.trim(text, F.lit(WHITE_SPACE))


def clean_code(text: Column) -> Column:
    """Line feeds only, no outer white space, never null."""
    crlf = F.replace(blank_if_null(text), F.lit("\r\n"), F.lit("\n"))
    return strip(F.replace(crlf, F.lit("\r"), F.lit("\n")))


def normalize_class_id(raw: Column) -> Column:
    """``cwe_079`` / `` 79 `` -> ``CWE-79``; anything without a digit -> ``''``.

    Digits are ASCII digits, and all of them are kept, so several ids in one
    value run together.
    """
    upper = F.upper(strip(blank_if_null(raw.cast("string"))))
    digits = F.regexp_replace(upper, "[^0-9]", "")
    number = F.ltrim(digits, F.lit("0"))
    return (
        F.when(upper.isin(UNKNOWN_CLASS_IDS) | (digits == ""), F.lit(""))
        .when(number == "", F.lit(CLASS_ID_PREFIX + "0"))
        .otherwise(F.concat(F.lit(CLASS_ID_PREFIX), number))
    )


def truncate_middle(text: Column, max_chars: int, head_ratio: float = 0.6) -> Column:
    """Keep the head and the tail of texts longer than ``max_chars``.

    The result of a cut is longer than ``max_chars`` by the length of the mark.
    """
    if max_chars <= 0:
        raise ValueError(f"max_chars must be positive, got {max_chars}")
    if not 0.0 <= head_ratio < 1.0:
        raise ValueError(f"head_ratio must lie in [0, 1), got {head_ratio}")
    head = int(max_chars * head_ratio)
    tail = max_chars - head
    text = blank_if_null(text)
    cut = F.concat(F.left(text, F.lit(head)), F.lit(CUT_MARK), F.right(text, F.lit(tail)))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def fingerprint(text: Column) -> Column:
    """MD5 of the UTF-8 bytes as 32 hex digits."""
    return F.md5(text)


def last_url_segment(url: Column) -> Column:
    """What follows the last slash; a trailing slash gives ``''``."""
    return F.substring_index(blank_if_null(url), "/", -1)


def text_or_none(value: Column) -> Column:
    """Null printed as ``None``, as string formatting of a missing value does."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def group_key(source: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(source), *[text_or_none(p) for p in parts])


def sample_id(key: Column, side: str) -> Column:
    return F.concat(text_or_none(key), F.lit(f"-{side}"))


def thousands(number: Column) -> Column:
    """``15147`` -> ``15,147``."""
    return F.format_number(number, 0)


def four_decimals(number: Column) -> Column:
    return F.format_string("%.4f", number)


def path_safe(name: str) -> str:
    """A model name as a directory name."""
    return name.replace("/", "__")


def last_path_part(name: str) -> str:
    return name.rsplit("/", 1)[-1]
