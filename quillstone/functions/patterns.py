"""The extraction patterns and their translation to exact Java regular expressions."""

from __future__ import annotations

from typing import NamedTuple

# Word characters for boundaries: letters, numbers and underscore, without the
# combining marks that Java's own \w takes in. ASCII ranges first for speed.
WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
_LEFT = rf"(?<!{WORD})"
_RIGHT = rf"(?!{WORD})"
_EITHER = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
_EXTRA_SPACES = r"\x1c-\x1f"


class Pattern(NamedTuple):
    """A pattern as text, the group it yields, and how it is matched."""

    text: str
    group: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return java_form(self.text, self.ignore_case)


def java_form(pattern: str, ignore_case: bool = False) -> str:
    r"""Spell out ``\b`` and ``\s`` so that Java matches the intended characters.

    ``\s`` gains U+001C..U+001F. ``\b`` becomes a look-around on WORD: one-sided
    where the neighbouring atom is always a word character (a boundary in front
    of ``\d`` or at the start of a pattern opens a word, any other closes one),
    two-sided at the start of a pattern whose first atom is a character class
    with punctuation.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(rf"\s{_EXTRA_SPACES}" if in_class else rf"[\s{_EXTRA_SPACES}]")
            i += 2
        elif two == r"\b":
            rest = pattern[i + 2:]
            if i == 0 and rest.startswith("[") and "%" in rest[: rest.index("]")]:
                out.append(_EITHER)
            elif rest.lstrip("(").startswith(r"\d"):
                out.append(rf"(?=\d){_LEFT}")
            else:
                out.append(_LEFT if i == 0 else _RIGHT)
            i += 2
        elif two.startswith("\\"):
            out.append(two)
            i += 2
        else:
            if two[0] == "[":
                in_class = True
            elif two[0] == "]":
                in_class = False
            out.append(two[0])
            i += 1
    return ("(?iU)" if ignore_case else "(?U)") + "".join(out)


# The extraction patterns.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_NUMERIC = Pattern(r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})\b", 1, True)
DATE_DAY_MONTH = Pattern(r"\b(\d{1,2}\s+" + _MONTH + r"\s+\d{2,4})\b", 1, True)
DATE_MONTH_DAY = Pattern(r"\b(" + _MONTH + r"\s+\d{1,2},?\s+\d{2,4})\b", 1, True)
EMAIL = Pattern(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
PHONE = Pattern(r"(?:\+?91[\s\-]?)?(?:[6-9]\d{9}|(?:\(?0\d{2,4}\)?[\s\-]?)?\d{6,8})")
AMOUNT = Pattern(
    r"(?:₹|Rs\.?|INR|USD|\$|€|£)\s*[\d,]+(?:\.\d{1,2})?|[\d,]+(?:\.\d{1,2})?\s*(?:₹|Rs\.?|INR)",
    0, True,
)
PAN = Pattern(r"\b[A-Z]{5}\d{4}[A-Z]\b")
AADHAAR = Pattern(r"\b\d{4}\s?\d{4}\s?\d{4}\b")
PERCENTAGE = Pattern(r"\b\d+(?:\.\d+)?%")
URL = Pattern(r"""(?:https?://|www\.)[^\s<>"']+""", 0, True)
NAME_LABELLED = Pattern(
    r"\b(?:Name|Customer|Client|To|Student|Employee|Holder|Recipient)\b"
    r"\s*[:\-]?\s*\n?([a-zA-Z][a-zA-Z\s.]{2,40})\n",
    1, True,
)
NAME_AFTER_ISSUER = Pattern(r"Government of India\s+([a-zA-Z][a-zA-Z\s.]{2,40})\s*\n", 1, True)
NAME_PREFIX = Pattern(r"^(?:Name|Nane|Nam)[:\-\s]*", 0, True)
DOB_LABELLED = Pattern(
    r"\b(?:DOB|Date of Birth|Birth Date)\b\s*[:\-]?\s*"
    r"((?:[0-3]?\d[/\-.][0-1]?\d[/\-.]\d{2,4})|(?:[0-3]?\d\s+" + _MONTH + r"\s+\d{2,4}))",
    1, True,
)
BIRTH_YEAR = Pattern(r"\b(?:Year of Birth|YOB)\s*[:\-]?\s*(\d{4})\b", 1, True)
GENDER_LABELLED = Pattern(
    r"\b(?:Gender|Sex)\b\s*[:\-]?\s*(Male|Female|Transgender|M|F)\b", 1, True)
GENDER_BARE = Pattern(r"\b(Male|Female)\b", 1, True)
ADDRESS_LABELLED = Pattern(
    r"((?:s[/\\]o|c[/\\]o|w[/\\]o|d[/\\]o|Address|Add)[:\-\s]*[\s\S]{10,200}?\b\d{3}\s?\d{3}\b)",
    1, True,
)
ADDRESS_BEFORE_PIN = Pattern(r"([A-Za-z0-9\s,.\-/]{20,150}?\b\d{3}\s?\d{3}\b)", 1)
MOBILE_LABELLED = Pattern(r"(?:Mobile|Mob|Ph|Phone)\s*[:\-]?\s*(\+?[\d\s\-]{8,15})", 1, True)

# Equivalent linear-time pieces of ADDRESS_BEFORE_PIN. Tried at every start, that
# pattern walks up to 150 characters ahead; its first match is the same as the
# first postal code with 20 allowed characters in front of it, preceded by as
# many allowed characters as there are, at most 150.
PIN = Pattern(r"\b\d{3}\s?\d{3}\b")
PIN_AT_END = Pattern(r"\d{3}\s?\d{3}\z")
PIN_MAX = 7
PIN_WITH_LEAD = Pattern(r"\A[\s\S]*?(?=\d)(?<=[A-Za-z0-9\s,.\-/]{20})\b\d{3}\s?\d{3}\b")
LEAD_RUN = Pattern(r"[A-Za-z0-9\s,.\-/]*\z")
LEAD_MAX = 150

# Equivalent linear-time forms. A number run is tried once, from its beginning or
# from where the last match ended, and not from each of its characters; an e-mail
# name likewise, minus the leading characters that open no word; and white space
# after a label is taken whole, since what must follow it is no white space.
# AMOUNT's look-ahead names the characters it can start with.
AMOUNT_FAST = Pattern(
    r"(?=[₹riu$€£\d,])(?:(?:₹|Rs\.?|INR|USD|\$|€|£)\s*[\d,]+(?:\.\d{1,2})?"
    r"|(?:\G|(?<![\d,]))[\d,]++(?:\.\d{1,2})?\s*(?:₹|Rs\.?|INR))",
    0, True,
)
_LOCAL = r"[A-Za-z0-9._%+\-]"
EMAIL_FAST = Pattern(
    rf"(?:\G|(?<!{_LOCAL}))(?:(?!{_EITHER}){_LOCAL})*+"
    rf"({_LOCAL}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b)", 1)


def _whole_spaces(pattern: Pattern) -> Pattern:
    r"""``\s*[:\-]?\s*`` in front of a visible character, without ways to split the white space."""
    text = pattern.text.replace(r"\s*[:\-]?\s*\n?", r"\s*+(?:[:\-]\s*+)?").replace(
        r"\s*[:\-]?\s*", r"\s*+(?:[:\-]\s*+)?")
    return pattern._replace(text=text)


NAME_LABELLED_FAST = _whole_spaces(NAME_LABELLED)
DOB_LABELLED_FAST = _whole_spaces(DOB_LABELLED)
BIRTH_YEAR_FAST = _whole_spaces(BIRTH_YEAR)
GENDER_LABELLED_FAST = _whole_spaces(GENDER_LABELLED)
