"""Text expressions: cleaning, normal forms, grams. Native columns unless a name ends in _udf."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the source data.
NULL_TOKENS = ["", "不详", "未知", "无"]
LITERAL_ESCAPES = ["\\r\\n", "\\n", "\\t"]
BOUNDARY_MARKER = "\\x"

THINK_ANYWHERE = r"(?is)<think>.*?</think>\s*"
THINK_LEADING = r"(?is)^\s*<think>.*?</think>\s*"
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind; trim() takes blanks only."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean_text(c: Column) -> Column:
    """Null becomes empty; no NULs; line feeds only, at most two in a row; stripped."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(""))
    out = F.regexp_replace(out, r"\r\n?", "\n")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def without_think(c: Column, anywhere: bool = True) -> Column:
    """Without think blocks: all of them, or the leading one."""
    return strip(F.regexp_replace(c, THINK_ANYWHERE if anywhere else THINK_LEADING, ""))


def canonical(c: Column) -> Column:
    """Normal form KC, case folded, without white space and punctuation, to compare questions by.

    Only texts beyond ASCII go to Python, as in ASCII folding is lower-casing.
    """
    text = F.coalesce(c, F.lit(""))
    wide = F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))
    folded = F.when(wide, nfkc_casefold_udf(F.when(wide, text))).otherwise(F.lower(text))
    return F.regexp_replace(folded, rf"{SPACE}|\p{{P}}", "")


def no_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "")


def null_tokens(c: Column) -> Column:
    """Null for the words that stand for a missing value."""
    value = strip(c)
    return F.when(value.isin(NULL_TOKENS), None).otherwise(value)


def shortened(c: Column, n: int) -> Column:
    """Cut to n characters, an ellipsis marking the cut."""
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def formula_safe(c: Column) -> Column:
    """A leading quote where a spreadsheet would read a formula."""
    return F.when(F.regexp_like(c, F.lit(r"^\s*[=+\-@]")), F.concat(F.lit("'"), c)).otherwise(c)


def words(c: Column, pattern: str = r"[^\p{L}\p{N}]+") -> Column:
    """Lower-case words between characters that are neither letters nor digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), pattern), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text's words, each padded by two blanks and one."""
    padded = F.transform(F.array_distinct(words(c)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def bigrams(c: Column) -> Column:
    """All character bigrams of a text without white space, repeated ones included."""
    chars = F.filter(F.split(no_space(c), ""), lambda x: x != "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.when(F.size(chars) < 2, F.array().cast("array<string>")).otherwise(pairs)


@F.pandas_udf(StringType())
def nfc_udf(s: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no such function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkc_casefold_udf(s: pd.Series) -> pd.Series:
    """Unicode normal form KC with case folded."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalize_text(c: Column) -> Column:
    """NFC, line feeds only, no blanks at line ends, stripped, one final line feed."""
    out = F.regexp_replace(nfc_udf(c), r"\r\n?", "\n")
    out = F.regexp_replace(out, rf"(?:(?!\n){SPACE})+(?=\n|$)", "")
    return F.concat(strip(out), F.lit("\n"))


def clean_line(c: Column, nfc: bool = True) -> Column:
    """Layout only: literal escapes to blanks, blanks collapsed, none between CJK characters."""
    out = nfc_udf(c) if nfc else c
    for e in LITERAL_ESCAPES:
        out = F.replace(out, F.lit(e), F.lit(" "))
    out = F.replace(out, F.lit(BOUNDARY_MARKER), F.lit(""))
    out = strip(F.regexp_replace(out, r"[ \t]+", " "))
    return F.regexp_replace(out, r"(?<=[㐀-鿿])\s+(?=[㐀-鿿])", "")


def utc_iso(c: Column) -> Column:
    """A time stamp as ISO 8601 in UTC with microseconds; the session's time zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


@F.pandas_udf(StringType())
def significant_udf(v: pd.Series) -> pd.Series:
    """Numbers with nine significant digits, as C writes them, joined by commas.

    Spark's own formats round the shortest decimal form, half up, and not the number itself.
    """
    return v.map(lambda x: None if x is None else ",".join([f"{y:.9g}" for y in x]))


def vector_literal(v: Column) -> Column:
    """A vector as text: numbers of nine significant digits in square brackets."""
    return F.concat(F.lit("["), significant_udf(F.filter(v, lambda x: x.isNotNull()).cast("array<double>")), F.lit("]"))


def version_key(c: Column) -> Column:
    """What names with numbers are ordered by: runs of digits count as numbers."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+|[^0-9]+"), 0), lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]")), F.lpad(x, 20, "0")).otherwise(x))
