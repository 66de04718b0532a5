"""Boilerplate removal by paragraph length, stopword density and link density, then by context (the published jusText rules)."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the published rules.
LENGTH_LOW, LENGTH_HIGH, STOPWORDS_LOW, STOPWORDS_HIGH, MAX_LINK_DENSITY, NEAR_HEADING = 70, 200, 0.30, 0.32, 0.2, 200
BLOCKS = frozenset("article aside blockquote body caption center col colgroup dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header html legend li nav ol optgroup option p pre section table tbody td textarea tfoot th thead tr ul".split())
SKIPPED = frozenset("head script style noscript template".split())
STOPWORDS = frozenset("a o as os um uma de da do das dos em no na e que se por para com the of and to in is it that for on with la le les des et en un une der die das und ein den von el los y que del".split())


class _Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.skip = self.link = 0
        self.path: list[str] = []
        self._new()

    def _new(self) -> None:
        if getattr(self, "now", None) and self.now["text"].strip():
            self.now["text"] = " ".join(self.now["text"].split())
            self.out.append(self.now)
        self.now = {"text": "", "linked": 0, "heading": any(re.fullmatch(r"h[1-6]", t) for t in self.path)}

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        self.link += tag == "a"
        if tag in BLOCKS:
            self.path.append(tag)
            self._new()

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        self.link = max(0, self.link - (tag == "a"))
        if tag in BLOCKS:
            if tag in self.path:
                while self.path.pop() != tag:
                    pass
            self._new()

    def handle_data(self, data):
        if not self.skip:
            self.now["text"] += data
            self.now["linked"] += len(data.strip()) if self.link else 0

    def close(self):
        super().close()
        self._new()


def paragraphs(source: str) -> list[dict]:
    parser = _Paragraphs()
    parser.feed(source or "")
    parser.close()
    return parser.out


def _alone(p: dict) -> str:
    text = p["text"]
    if p["linked"] > MAX_LINK_DENSITY * len(text):
        return "bad"
    if "©" in text or "&copy" in text:
        return "bad"
    words = text.lower().split()
    share = sum(w.strip(".,;:!?") in STOPWORDS for w in words) / len(words) if words else 0
    if len(text) < LENGTH_LOW:
        return "bad" if p["linked"] else "short"
    if share >= STOPWORDS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "neargood"
    return "neargood" if share >= STOPWORDS_LOW else "bad"


def classify(found: list[dict]) -> list[bool]:
    """Which paragraphs are content: by themselves, then by the nearest decided ones around them."""
    kind = [_alone(p) for p in found]
    nearest = lambda k, step, skip: next((kind[j] for j in range(k + step, len(kind) if step > 0 else -1, step) if kind[j] not in skip), "bad")
    first = list(kind)
    for k, x in enumerate(kind):
        if found[k]["heading"] and x == "short":
            room = 0
            for j in range(k + 1, len(found)):
                if kind[j] == "good" and room <= NEAR_HEADING:
                    first[k] = "neargood"
                    break
                room += len(found[j]["text"])
    kind = first
    second = list(kind)
    for k, x in enumerate(kind):
        if x == "short":
            around = {nearest(k, -1, ("short", "neargood")), nearest(k, 1, ("short", "neargood"))}
            close = {nearest(k, -1, ("short",)), nearest(k, 1, ("short",))}
            second[k] = "good" if around == {"good"} or (around == {"good", "bad"} and "neargood" in close) else "bad"
    kind = second
    return [x == "good" or x == "neargood" and "good" in (nearest(k, -1, ("neargood",)), nearest(k, 1, ("neargood",))) for k, x in enumerate(kind)]


def content(source: str | None, least_chars: int = 30, least_share: float = 0.2) -> str:
    """Good paragraphs, a line each; nothing if there is none, or if they are less than ``least_chars`` or than ``least_share`` of the whole source."""
    found = paragraphs(source or "")
    kept = "\n".join(p["text"] for p, ok in zip(found, classify(found)) if ok).strip()
    return kept if len(kept) >= least_chars and len(kept) >= least_share * len(source or "") else ""


def plain_text(source: str | None) -> str:
    """All text of a page, markup off and references decoded."""
    return " ".join(html.unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ", source or "")).split())


@F.pandas_udf(StringType())
def content_udf(sources: pd.Series) -> pd.Series:
    return sources.map(content, na_action=None)
