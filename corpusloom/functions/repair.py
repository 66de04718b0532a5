"""Repairs that need more than an expression: Unicode, sentence capitals, tags with references."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SENTENCE = re.compile(r"(?m)(\A|^|[.!?:;…]\s+)([\"'“”«»(\[{]*)([a-zà-öø-ÿ])")
_MOJIBAKE = re.compile(r"[ÂÃâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def capitalise_sentences(text: str | None) -> str:
    """A capital where a line or a sentence begins, behind opening quotes and brackets."""
    return _SENTENCE.sub(lambda m: m[1] + m[2] + m[3].upper(), text or "")


def mend_unicode(text: str | None) -> str:
    """UTF-8 that was read as Windows-1252 is read again, then composed form; a subset of what repair libraries do."""
    text = text or ""
    if _MOJIBAKE.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFC", text)


def to_ascii(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", mend_unicode(text)) if ord(c) < 128)


def column(fn, text: Column) -> Column:
    """A plain function of a text as a Column."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action=None)

    return run(text)
