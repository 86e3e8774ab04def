"""Column functions on text: blanks, stripping, repair, rounding, fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as whitespace. Java's Unicode \s lacks U+001C..U+001F.
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A Column used twice is an expression evaluated twice unless the planner can
    share it, which it cannot do inside conditional branches or lambdas; a
    lambda variable is bound to a computed value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def non_empty(c: Column) -> Column:
    """The text, or NULL where it is empty; computed once."""
    return let(c, lambda v: F.when(v != "", v))


def strip(c: Column) -> Column:
    """Text without whitespace at either end (``trim`` alone removes only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """NULL, empty, or whitespace only; stops at the first visible character."""
    return ~F.coalesce(c.rlike(NON_BLANK), F.lit(False))


def squeeze(c: Column) -> Column:
    """Each run of whitespace becomes one space, then both ends are stripped."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def or_default(c: Column, default: str) -> Column:
    """``default`` where the text is NULL or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def effective_text(corrected: Column, raw: Column) -> Column:
    """Corrected text, else raw text, else empty; an empty string counts as missing."""
    return F.coalesce(F.nullif(corrected, F.lit("")), F.nullif(raw, F.lit("")), F.lit(""))


def fix_ocr_artifacts(c: Column) -> Column:
    """Mechanical recognition errors: pound sign, ordinal degree sign, bars inside words."""
    c = F.translate(c, "£", "₹")
    c = F.regexp_replace(c, r"(?U)(?<=\d)°", "th")
    c = F.regexp_replace(c, r"(?<=[a-z])[|!](?=[a-z])", "l")
    return F.regexp_replace(c, r"(?<=[A-Z])[|!](?=[A-Z])", "I")


def document_specific_fix(c: Column) -> Column:
    return F.replace(c, F.lit("Principat"), F.lit("Principal"))


def corrected_text(c: Column) -> Column:
    """Both repairs in order. A grammar model, where there is one, sits between them."""
    return document_specific_fix(fix_ocr_artifacts(c))


def latin1_safe(c: Column) -> Column:
    """Each code point above U+00FF becomes one question mark."""
    return F.regexp_replace(c, r"[^\x{00}-\x{FF}]", "?")


def round_half_even(c: Column, places: int) -> Column:
    """Round the exact binary value half to even.

    ``bround`` rounds the shortest decimal form instead, so it turns 2.675
    (binary 2.67499...) into 2.68; this gives 2.67.
    """
    return F.replace(F.format_number(c, places), F.lit(","), F.lit("")).cast("double")


def one_decimal(c: Column) -> Column:
    """One-decimal display of a non-negative number, exact ties going up."""
    tie_up = F.when(c % 1 == 0.25, c + 0.05).otherwise(c)
    return F.replace(F.format_number(tie_up, 1), F.lit(","), F.lit(""))


def confidence_band(c: Column) -> Column:
    """green above 70, yellow above 40, else red; NULL counts as 0."""
    c = F.coalesce(c, F.lit(0.0))
    return F.when(c > 70, "green").when(c > 40, "yellow").otherwise("red")


def export_base_name(filename: Column) -> Column:
    """File name minus its last extension; leading dots of the base name stay."""
    return F.regexp_replace(filename, r"^((?:.*/)?\.*[^./][^/]*)\.[^./]*$", "$1")
