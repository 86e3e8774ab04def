"""Key-information extraction as native Columns.

List extractors return the first occurrences in order, capped, or NULL when
there is none. Each pattern runs only behind a cheap test that every match must
pass (a required character or word), so plain prose costs a byte search, not a
regular-expression scan. The tests are implied by the patterns: they never
change a result. Letters with non-ASCII case variants under case-insensitive
matching (i, k, s) are avoided in them or spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p
from .text import digits_of, let, non_empty, squeeze, strip

LIST_CAP = 5
AADHAAR_CAP = 2
URL_CAP = 3


def _find_all(text: Column, pattern: p.Pattern) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.java), pattern.group)


def _first(text: Column, pattern: p.Pattern) -> Column:
    """The group of the first match, empty when there is none."""
    return F.regexp_extract(text, pattern.java, pattern.group)


def _capped(values: Column, cap: int | None) -> Column:
    values = F.array_distinct(values)
    if cap is not None:
        values = F.slice(values, 1, cap)
    return let(values, lambda v: F.when(F.size(v) > 0, v))


def _has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def _low(text: Column, low: Column | None) -> Column:
    return F.lower(text) if low is None else low


def extract_dates(text: Column, cap: int = LIST_CAP) -> Column:
    """Numeric, day-month and month-day dates, in that order of shape."""
    shapes = (p.DATE_NUMERIC, p.DATE_DAY_MONTH, p.DATE_MONTH_DAY)
    found = F.concat(*[_find_all(text, shape) for shape in shapes])
    return F.when(_has_digit(text), _capped(found, cap))


def extract_emails(text: Column, cap: int = LIST_CAP) -> Column:
    return F.when(text.contains("@"), _capped(_find_all(text, p.EMAIL_FAST), cap))


def extract_phones(text: Column, cap: int = LIST_CAP) -> Column:
    """Mobile and landline numbers of at least seven digits."""
    long_enough = F.filter(_find_all(text, p.PHONE), lambda v: F.length(digits_of(v)) >= 7)
    return F.when(text.rlike(r"(?U)\d{6}"), _capped(F.transform(long_enough, strip), cap))


def extract_amounts(text: Column, cap: int = LIST_CAP) -> Column:
    return _capped(_find_all(text, p.AMOUNT_FAST), cap)


def extract_pan(text: Column) -> Column:
    return F.when(_has_digit(text), _capped(_find_all(text, p.PAN), None))


def extract_aadhaar(text: Column, cap: int = AADHAAR_CAP) -> Column:
    return F.when(_has_digit(text), _capped(_find_all(text, p.AADHAAR), cap))


def extract_percentages(text: Column, cap: int = LIST_CAP) -> Column:
    return F.when(text.contains("%"), _capped(_find_all(text, p.PERCENTAGE), cap))


def extract_urls(text: Column, cap: int = URL_CAP, low: Column | None = None) -> Column:
    low = _low(text, low)
    maybe = low.contains("http") | low.contains("www.")
    return F.when(maybe, _capped(_find_all(text, p.URL), cap))


def form_dob(text: Column, dates: Column, low: Column | None = None) -> Column:
    """Labelled date of birth, else year of birth, else the first date, else empty."""
    low = _low(text, low)
    labelled = non_empty(strip(_first(text, p.DOB_LABELLED_FAST)))
    year = non_empty(_first(text, p.BIRTH_YEAR_FAST))
    first_date = F.coalesce(F.get(dates, F.lit(0)), F.lit(""))
    has_label = _has_digit(text) & (
        low.contains("dob") | low.contains("rth") | low.contains("yob"))
    return F.coalesce(F.when(has_label, F.coalesce(labelled, year)), first_date)


def labelled_name(text: Column, low: Column | None = None) -> Column:
    """The name after a label, else the one after the issuing authority, else empty."""
    low = _low(text, low)
    after_issuer = F.when(low.contains("government"), strip(_first(text, p.NAME_AFTER_ISSUER)))
    return F.coalesce(non_empty(strip(_first(text, p.NAME_LABELLED_FAST))), after_issuer, F.lit(""))


def name_above(lines: Column, dob: Column) -> Column:
    """The first usable line directly above a line that holds the date of birth.

    ``lines`` and ``dob`` must be plain column references: they are read once
    per line.
    """
    def candidate(line: Column, i: Column) -> Column:
        above = strip(F.get(lines, i - 1))
        above = strip(F.regexp_replace(above, p.NAME_PREFIX.java, ""))
        return F.when((i > 0) & F.contains(line, dob), above)

    def usable(c: Column) -> Column:
        return (F.length(c) > 2) & ~_has_digit(c)

    found = F.filter(F.transform(lines, candidate), usable)
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def form_gender(text: Column, low: Column | None = None) -> Column:
    """Labelled value, else the first bare Male or Female, capitalised, else empty."""
    low = _low(text, low)
    has_label = low.contains("gender") | low.contains("sex") | low.contains("ſex")
    labelled = F.when(has_label, non_empty(_first(text, p.GENDER_LABELLED_FAST)))
    bare = F.when(low.contains("male"), _first(text, p.GENDER_BARE))
    return F.initcap(F.coalesce(labelled, bare, F.lit("")))


def form_address(text: Column) -> Column:
    """From an address label to the first postal code, else the run before one."""
    found = F.coalesce(
        non_empty(_first(text, p.ADDRESS_LABELLED)), let(_first(text, p.PIN_WITH_LEAD), _lead_and_pin))
    return F.coalesce(F.when(text.rlike(p.PIN.java), squeeze(found)), F.lit(""))


def _lead_and_pin(upto: Column) -> Column:
    """A postal code at the end of ``upto`` with the allowed characters before it."""
    code = F.regexp_extract(F.right(upto, F.lit(p.PIN_MAX)), p.PIN_AT_END.java, 0)

    def with_lead(c: Column) -> Column:
        lead = F.right(F.left(upto, F.length(upto) - F.length(c)), F.lit(p.LEAD_MAX))
        return F.concat(F.regexp_extract(lead, p.LEAD_RUN.java, 0), c)

    return F.when(upto != "", let(code, with_lead))


def labelled_mobile(text: Column, low: Column | None = None) -> Column:
    """What follows the first mobile or phone label; empty when there is none.

    A match may be whitespace only, so the value is not stripped here.
    """
    low = _low(text, low)
    maybe = low.contains("mob") | low.contains("ph")
    return F.when(maybe, _first(text, p.MOBILE_LABELLED)).otherwise("")


def with_labelled_mobile(phones: Column, mobile: Column) -> Column:
    """Append the labelled number unless its digits are already in the capped list."""
    listed = F.coalesce(phones, F.array().cast("array<string>"))
    known = F.exists(listed, lambda v: digits_of(v) == digits_of(mobile))
    return F.when((mobile != "") & ~known, F.array_append(listed, strip(mobile))).otherwise(phones)
