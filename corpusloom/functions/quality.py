"""Quality predicates on one text.  ``BAD`` holds those that reject, by name; ``passes`` is their conjunction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the filter.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
BAD_STARTS = (
    "List of recent changes", "Sort by", "Home |", "> Home", "useful tips", "Licenses:", "Search in: ", "Terms of Use - ", "Home page", "Home Page", "Copyright", "Results/Page",
    "!", "#", "$", "%", "&", "*", "+", ",", "-", ".", "/", ":", ";", "<", "=", ">", "?", "@", "[", "\\", "]", "^", "_", "`", "{", "|", "}", "~",
)
BAD_MIDDLES = (" @ ", " / ", " | ", "[...]", "(...)")
BAD_END = " ("
VALID_SIGNS = "0123456789abcdefghijklmnopqrstuvwxyzàáâãåāèéêëěėēîïíìįīĵłñńôöòóōõšśûüùúūÿýźçćčñń!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”ºª€ \t\n\r\x0b\x0c"
LONGEST_WORD = 20


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def starts_with_month(x: Column) -> Column:
    return F.lower(x).rlike("^(" + "|".join(MONTHS) + ")")


def has_long_word(x: Column) -> Column:
    return x.rlike(f"[^ ]{{{LONGEST_WORD + 1},}}")


def has_bad_start(x: Column) -> Column:
    return _any([x.startswith(s) for s in BAD_STARTS])


def has_bad_middle(x: Column) -> Column:
    return _any([x.contains(s) for s in BAD_MIDDLES])


def has_bad_end(x: Column) -> Column:
    return x.endswith(BAD_END)


def has_many_points(x: Column) -> Column:
    return x.rlike(r"\.{4,}")


def is_empty(x: Column) -> Column:
    return F.length(x) == 0


def has_bad_sign(x: Column) -> Column:
    """A character that is in no valid set; found by taking all valid ones away."""
    return F.translate(F.lower(x), VALID_SIGNS, "") != ""


def _count(x: Column, sign: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def has_odd_brackets(x: Column) -> Column:
    return _any([_count(x, a) != _count(x, b) for a, b in ("()", "[]", "{}")])


def has_odd_quotes(x: Column) -> Column:
    return (_count(x, '"') % 2 != 0) | (_count(x, "“") != _count(x, "”"))


BAD: dict[str, Callable[[Column], Column]] = {
    "t40_starts_with_month": starts_with_month,
    "t41_long_word": has_long_word,
    "t42_bad_start": has_bad_start,
    "t43_bad_middle": has_bad_middle,
    "t44_bad_end": has_bad_end,
    "t45_many_points": has_many_points,
    "t46_empty": is_empty,
    "t47_bad_sign": has_bad_sign,
    "t48_odd_brackets": has_odd_brackets,
    "t49_odd_quotes": has_odd_quotes,
}


def passes(x: Column) -> Column:
    return ~_any([f(x) for f in BAD.values()])


def word_count(x: Column) -> Column:
    """Words, and punctuation signs one by one."""
    return F.size(F.regexp_extract_all(x, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0)))
