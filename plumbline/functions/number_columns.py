"""Numbers in text as columns: masks, normal forms and years by built-in functions, without Python.

They equal mask_structural, normalize_accounting, normalize_european and contextual_years in quantities, which read
one text at a time: Java's classes are told to be Unicode's (U), lines to end at line feeds only (d), and white
space to include the four separators below the blank, as there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lex


def _java(pattern: str, flags: str = "") -> str:
    return f"(?dU{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with by(match) in place of each match; matches are not empty."""
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, hits, lambda a, hit: F.concat(a, F.coalesce(by(hit), F.lit("")))), "")


def masked_structural(text: Column) -> Column:
    """Numbers that label rather than measure, blanked, where the text has a digit; length is kept."""
    blank = replaced(text, _java("|".join(lex.STRUCTURAL), "m"), lambda hit: F.repeat(F.lit(" "), F.length(hit)))
    return F.when(text.rlike(r"(?U)\d"), blank).otherwise(text)


def normal_accounting(text: Column) -> Column:
    """(1,234) becomes -1234."""
    return replaced(text, _java(lex.ACCOUNTING), lambda hit: F.concat(F.lit("-"), F.regexp_replace(hit, _java(r"^\(\s*|\s*\)$|,"), "")))


def normal_european(text: Column) -> Column:
    """1.234,56 becomes 1234.56, and 12,50 becomes 12.50."""
    grouped = replaced(text, _java(lex.EU_GROUPED), lambda hit: F.translate(hit, ",.", "."))
    return F.regexp_replace(grouped, _java(lex.EU_DECIMAL), "$1.$2")


def years_in_context(text: Column) -> Column:
    """Four-digit years named as times, in an array: in 2023, for 2021 and 2022, FY2024."""
    behind = F.regexp_extract_all(text, F.lit(_java(lex.YEAR_PREFIX + r"(?=(.{0,100}))", "is")), F.lit(1))
    listed = F.transform(behind, lambda x: F.regexp_extract_all(F.regexp_extract(x, _java(rf"^(?:{lex.YEAR_LIST})", "i"), 0), F.lit(_java(r"\b\d{4}\b")), F.lit(0)))
    return F.concat(F.flatten(listed), F.regexp_extract_all(text, F.lit(_java(lex.YEAR_DIRECT, "i")), F.lit(1)))
