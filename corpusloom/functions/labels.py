"""Rules that turn labels and answers into varieties.  They differ on purpose: each source has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import squeeze

# Spellings that each rule knows.
FILTER_BR = ("pt-br", "br", "ptbr", "brazil", "brazilian")
FILTER_PT = ("pt-pt", "pt", "eu", "european")
EXPORT_BR = ("pt-br", "ptbr", "portugues do brasil", "português do brasil")
EXPORT_PT = ("pt-pt", "ptpt", "portugues europeu", "português europeu", "portugal")
EXPORT_EQUAL = ("equal", "shared", "same")


def _key(raw: Column) -> Column:
    return F.replace(F.lower(squeeze(raw)), F.lit("_"), F.lit("-"))


def _has(x: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def at_ingest(raw: Column) -> Column:
    """Numbers: 1 is Brazilian, any other European.  Strings: the two names in any spelling, others as they are in lower case."""
    number = F.when(raw.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(raw).cast("long"))
    x = _key(raw)
    return F.when(number == 1, "pt-BR").when(number.isNotNull(), "pt-PT").when(x == "pt-br", "pt-BR").when(x == "pt-pt", "pt-PT").otherwise(x)


def at_filter(raw: Column) -> Column:
    """Known spellings, the number 1, and European for whatever else, null included."""
    x = _key(F.coalesce(raw, F.lit("")))
    return F.when(x.isin(*FILTER_BR), "pt-BR").when(x.isin(*FILTER_PT), "pt-PT").when(x.rlike(r"^[+]?0*1$"), "pt-BR").otherwise("pt-PT")


def at_export(raw: Column) -> Column:
    """Known spellings, with ``equal``; null for any other."""
    x = _key(raw)
    return F.when(x.isin(*EXPORT_BR), "pt-br").when(x.isin(*EXPORT_PT), "pt-pt").when(x.isin(*EXPORT_EQUAL), "equal")


def answer_of_pair_model(raw: Column) -> Column:
    x = F.lower(F.trim(raw))
    return F.when(_has(x, "equal", "shared") | (x == "same"), "equal").when(_has(x, "pt-br", "ptbr", "brasil"), "pt-br").when(_has(x, "pt-pt", "ptpt", "europeu", "portugal"), "pt-pt")


def answer_of_multitask_model(raw: Column) -> Column:
    x = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(_has(x, "pt-br"), "pt-br").when(_has(x, "pt-pt"), "pt-pt").when(_has(x, "equal"), "equal").otherwise("unknown")


def answer_of_chat_model(raw: Column) -> Column:
    x = F.lower(raw)
    return F.when(_has(x, "pt-br", "brasil"), "pt-BR").when(_has(x, "português europeu", "portugues europeu", "pt-pt", "portugal"), "pt-PT")
