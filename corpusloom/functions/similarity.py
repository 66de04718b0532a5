"""Similarity of two texts: set measures and threshold rules as Columns, edit-based ones as plain and pandas functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens

SCORE_TYPE = "double"


def type_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the token types of two texts; two without tokens are alike, one without isn't like the other."""
    x, y = F.array_distinct(tokens(F.lower(a))), F.array_distinct(tokens(F.lower(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def adaptive_threshold(length: Column, base: float = 0.30, long: float = 0.70, short_length: int = 8, long_length: int = 28) -> Column:
    """``base`` up to the short length, ``long`` from the long one on, a line between."""
    slope = (long - base) / max(1, long_length - short_length)
    return F.when(length <= short_length, F.lit(base)).when(length >= long_length, F.lit(long)).otherwise(F.lit(base) + (length - short_length) * F.lit(slope))


def length_ratio(a: Column, b: Column) -> Column:
    """Second length over first; null if either is nothing."""
    return F.when((a > 0) & (b > 0), b / a)


def ratio_is_bad(a: Column, b: Column, low: float, high: float) -> Column:
    r = length_ratio(a, b)
    return r.isNull() | (r < low) | (r > high)


def score_band(score: Column) -> Column:
    return F.when(score < 0.4, "low").when(score < 0.7, "middle").otherwise("high")


def positional_difference(a: Column, b: Column) -> Column:
    """Difference in words plus the places at which both have another word."""
    x, y = F.split(a, r"\s+"), F.split(b, r"\s+")
    shared = F.least(F.size(x), F.size(y))
    other = F.size(F.filter(F.sequence(F.lit(1), shared), lambda k: F.element_at(x, k) != F.element_at(y, k)))
    return F.abs(F.size(x) - F.size(y)) + F.when(shared > 0, other).otherwise(0)


# ---- edit distances --------------------------------------------------------------------------------------------------


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits: a row of the table is one integer."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bits: the differences down a column of the table are two integers."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    mask, last, total = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for c in b:
        same = at.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up) & mask, up & diagonal
        total += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & mask, left << 1 & mask
        up, down = left | ~(diagonal | right) & mask, right & diagonal
    return total


def blended(a: str, b: str) -> float:
    """Half the indel ratio, a fifth of it over sorted words, three tenths of the normalised edit distance, damped by unlike lengths."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b:
        return float(not a and not b)
    by_words = indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    longest = max(len(a), len(b))
    near = 1 - edit_distance(a, b) / longest
    return (0.5 * indel_ratio(a, b) + 0.2 * by_words + 0.3 * near) * (0.5 + 0.5 * min(len(a), len(b)) / longest)


def as_udf(measure: Callable[[str, str], float]):
    """A pandas function of two text columns from a plain one."""

    @F.pandas_udf(SCORE_TYPE)
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return scored


# ---- word alignment ---------------------------------------------------------------------------------------------------


def form(token: str) -> str:
    """What tokens are compared by: composed, without regard to case."""
    return unicodedata.normalize("NFC", token).casefold()


def same_form_links(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A deterministic aligner: each token with the first unused one of the same form."""
    free: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        free.setdefault(form(t), []).append(j)
    return [(i, free[f].pop(0)) for i, t in enumerate(a) if free.get(f := form(t))]


def linked_types(a: list[str], b: list[str], links: list[tuple[int, int]]) -> float:
    """Share of token types, of both sides together, that a link touches."""
    left, right = [form(t) for t in a], [form(t) for t in b]
    every = {*left, *right}
    touched = {left[i] for i, _ in links if 0 <= i < len(left)} | {right[j] for _, j in links if 0 <= j < len(right)}
    return len(touched) / len(every) if every else 1.0


def coverage(a: list[str], b: list[str], links: list[tuple[int, int]]) -> float:
    """Mean share of positions that links reach on either side."""
    if not a or not b:
        return float(not a and not b)
    return (len({i for i, _ in links}) / len(a) + len({j for _, j in links}) / len(b)) / 2


def uncovered_runs(n: int, reached: set[int], fill: int = 1) -> list[tuple[int, int]]:
    """Runs of unreached positions as (begin, end), holes of up to ``fill`` between reached ones left out."""
    runs, begin = [], None
    for k in range(n + 1):
        out = k < n and k not in reached
        if out and begin is None:
            begin = k
        elif not out and begin is not None:
            if not (k - begin <= fill and begin > 0 and k < n):
                runs.append((begin, k))
            begin = None
    return runs
