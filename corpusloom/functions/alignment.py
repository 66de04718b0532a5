"""Features of a word-aligned pair and the policy that flags bad ones; the aligner is a parameter."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corpusloom.functions.similarity import indel_ratio, linked_types, same_form_links, uncovered_runs
from corpusloom.functions.text import TOKEN

# Words that carry no content.
STOPWORDS = frozenset([
    "a", "à", "ao", "aos", "as", "o", "os", "um", "uma", "de", "da", "das", "do", "dos", "em", "no",
    "na", "nos", "nas", "e", "ou", "que", "se", "por", "para", "com", "como", "mais", "mas", "não", "sim", "já",
    "sua", "seu", "suas", "seus", "eu", "tu", "ele", "ela", "nós", "vós", "eles", "elas", "me", "te", "lhe", "vos",
    "lhes", "isso", "isto", "aquilo",
])
Links = Callable[[list[str], list[str]], list[tuple[int, int]]]
_TOKEN = re.compile(TOKEN)
REALS = ("br_cov", "pt_cov", "cov_min", "cov_gap", "br_int_content_ratio", "pt_int_content_ratio", "br_spill", "pt_spill", "base_sim")
COUNTS = ("br_content_total", "pt_content_total", "br_len", "pt_len", "br_max_int", "pt_max_int", "sent_diff")
SCHEMA = StructType([StructField(n, DoubleType()) for n in REALS] + [StructField(n, LongType()) for n in COUNTS])


def is_content(token: str) -> bool:
    return len(token) > 1 and token.lower() not in STOPWORDS


def _sentences(text: str) -> int:
    return len(re.findall(r"[.!?…]+(?:\s|$)", text or ""))


def _side(tokens: list[str], reached: set[int]) -> tuple[float, float, float, int, int]:
    """(share reached, share of content inside uncovered inner runs, share of uncovered tokens at the edges, content tokens, longest inner run)."""
    runs = uncovered_runs(len(tokens), reached)
    inner = [(a, b) for a, b in runs if a > 0 and b < len(tokens)]
    missing = sum(b - a for a, b in runs)
    content = sum(map(is_content, tokens))
    lost = sum(is_content(t) for a, b in inner for t in tokens[a:b])
    edge = missing - sum(b - a for a, b in inner)
    return (len(tokens) - missing) / max(1, len(tokens)), lost / max(1, content), edge / missing if missing else 0.0, content, max((b - a for a, b in inner), default=0)


def features(br: tuple[str, str, str], pt: tuple[str, str, str], links: Links = same_form_links, window: bool = True) -> dict:
    """Of (previous, this, next) texts of both sides.  With a window, each side is aligned with the other's three rows together."""
    a, b = _TOKEN.findall(br[1] or ""), _TOKEN.findall(pt[1] or "")
    own = links(a, b)
    if window:
        wide = lambda rows: _TOKEN.findall(" ".join(x for x in rows if x))
        reached = {i for i, _ in links(a, wide(pt))}, {i for i, _ in links(b, wide(br))}
    else:
        reached = {i for i, _ in own}, {j for _, j in own}
    (ca, ia, sa, na, la), (cb, ib, sb, nb, lb) = _side(a, reached[0]), _side(b, reached[1])
    if not a or not b:
        base = float(not a and not b)
    elif own:
        base = linked_types(a, b, own)
    else:
        x, y = {t.casefold() for t in a}, {t.casefold() for t in b}
        base = len(x & y) / len(x | y)
    return {"br_cov": ca, "pt_cov": cb, "cov_min": min(ca, cb), "cov_gap": abs(ca - cb), "br_int_content_ratio": ia, "pt_int_content_ratio": ib, "br_spill": sa, "pt_spill": sb, "base_sim": base, "br_content_total": na, "pt_content_total": nb, "br_len": len(a), "pt_len": len(b), "br_max_int": la, "pt_max_int": lb, "sent_diff": abs(_sentences(br[1]) - _sentences(pt[1]))}


def feature_struct(br: tuple[Column, Column, Column], pt: tuple[Column, Column, Column], links: Links = same_form_links, window: bool = True) -> Column:
    @F.pandas_udf(SCHEMA)
    def made(b0: pd.Series, b1: pd.Series, b2: pd.Series, p0: pd.Series, p1: pd.Series, p2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(tuple(x[:3]), tuple(x[3:]), links, window) for x in zip(b0, b1, b2, p0, p1, p2)], columns=[*REALS, *COUNTS])

    return made(*br, *pt)


def policy(f: Column) -> Column:
    """Struct of ``flagged`` and ``reasons``: hopeless similarity at once, tiny pairs with sane coverage pass, good pairs pass, else reasons are weighed.

    Two strong reasons flag, or one if little spills over the edges, or three of any kind.  Short rows have tighter limits.
    """
    g = lambda n: f[n]
    spill = (g("br_spill") >= 0.6) | (g("pt_spill") >= 0.6)
    tiny = (g("br_content_total") <= 3) & (g("pt_content_total") <= 3)
    short = ~tiny & ((g("br_content_total") < 7) | (g("pt_content_total") < 7))
    by = lambda usual, if_tiny, if_short: F.when(tiny, if_tiny).when(short, if_short).otherwise(usual)
    coverage, gap, inner, alike = by(0.5, 0.4, 0.55), by(0.35, 0.55, 0.2), by(0.33, 1.0, 0.23), by(0.3, 0.3, 0.6)
    enough = (g("br_int_content_ratio") * g("br_content_total") >= 3) | (g("pt_int_content_ratio") * g("pt_content_total") >= 3)
    strong = F.array_compact(
        F.array(
            F.when(g("cov_min") < coverage, "low_coverage"),
            F.when(g("cov_gap") > gap, "coverage_asymmetry"),
            F.when(enough & ((g("br_int_content_ratio") > inner) | (g("pt_int_content_ratio") > inner)), "big_interior_unaligned_content"),
            F.when(enough & ((g("br_max_int") >= 9) | (g("pt_max_int") >= 9)), "long_interior_gap"),
        )
    )
    weak = F.array_compact(F.array(F.when(g("sent_diff") > 1, "sentence_mismatch"), F.when(g("base_sim") < alike, "low_similarity")))
    every = F.concat(strong, weak)
    weighed = (F.size(strong) >= 2) | (~spill & ((F.size(strong) >= 1) | (F.size(every) >= 3)))
    sane = tiny & (g("cov_min") >= 2 / 3) & (g("br_max_int") <= 1) & (g("pt_max_int") <= 1) & (g("sent_diff") <= 0) & ~spill
    good = (g("base_sim") >= alike + 0.35) & (g("cov_min") >= coverage + 0.1)
    out = lambda flag, reason: F.struct(flag.alias("flagged"), reason.alias("reasons"))
    joined = F.when(F.size(every) == 0, "ok").otherwise(F.array_join(every, ","))
    return F.when(g("base_sim") < 0.2, out(F.lit(True), F.lit("low_similarity"))).when(sane, out(F.lit(False), F.lit("ok_short_high_cov"))).when(good, out(F.lit(False), F.lit("ok"))).otherwise(out(weighed, joined))


def highlighted(text: str | None, other: str | None, links: Links = same_form_links, marks: tuple[str, str] = ("[", "]")) -> str:
    """``text`` with marks around each run of tokens that no link to ``other`` reaches; a single unreached token between reached ones is passed over."""
    text = text or ""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    reached = {i for i, _ in links([text[a:b] for a, b in spans], _TOKEN.findall(other or ""))}
    out, at = [], 0
    for first, past in uncovered_runs(len(spans), reached):
        begin, end = spans[first][0], spans[past - 1][1]
        out += [text[at:begin], marks[0], text[begin:end], marks[1]]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def highlighted_udf(texts: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([highlighted(a, b) for a, b in zip(texts, others)], dtype=object)


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of: shared words, shared and own words of either side."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 1.0
    tries = [indel_ratio(left, right)] + ([indel_ratio(both, left), indel_ratio(both, right)] if both else [])
    return max(tries)


def damped_set_ratio(a: str, b: str) -> float:
    """Token-set ratio, damped for fragments of fewer than 24 letters and digits."""

    def weight(s: str) -> float:
        n = len(re.sub(r"[\W_]+", "", s))
        return min(1.0, max(0.25, 0.25 + (n - 6) / 18 * 0.75))

    return token_set_ratio(a, b) * weight(a) * weight(b)


def text_only_score(a: str, b: str) -> float:
    """The alignment score of two blocks that begin at the same time."""
    return 0.3 + 0.7 * indel_ratio(a.strip(), b.strip())
