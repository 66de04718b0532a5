"""Quality predicates, repair chains and the filter funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.functions import text as T
from corpusloom.plans.views import PAIRS, documents, pairs


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_X = "coalesce(text, '')"
#: What is put before or behind every so many documents' texts, so that each predicate has rows to find: (remainder, before, behind).
_MARKS = ((0, "March ", ""), (1, "Home | ", ""), (2, "", " ("), (3, "", "...."), (5, "", ")"), (6, "", '"'), (7, "“", ""))
_EMPTY, _OF = 4, 13


def marked_text():
    """A document's text as the predicates are given it: marked by its id, or emptied."""
    out = F.coalesce("text", F.lit(""))
    for k, before, behind in _MARKS:
        out = F.when(F.col("doc_id") % _OF == k, F.concat(F.lit(before), F.coalesce("text", F.lit("")), F.lit(behind))).otherwise(out)
    return F.when(F.col("doc_id") % _OF == _EMPTY, F.lit("")).otherwise(out)


_MARKED = f"CASE doc_id % {_OF} " + " ".join(f"WHEN {k} THEN {_lit(a)} || {_X} || {_lit(b)}" for k, a, b in _MARKS) + f" WHEN {_EMPTY} THEN '' ELSE {_X} END"
_MARKED_DOCUMENTS = f"marked AS (SELECT doc_id, lang, {_MARKED} AS text FROM documents)"
_VALID = "".join("\\" + c if c in "\\]^-[" else c for c in Q.VALID_SIGNS)
_BAD_SQL = {
    "t40_starts_with_month": f"regexp_matches(lower({_X}), '^({'|'.join(Q.MONTHS)})')",
    "t41_long_word": f"regexp_matches({_X}, '[^ ]{{{Q.LONGEST_WORD + 1}}}')",
    "t42_bad_start": "(" + " OR ".join(f"starts_with({_X}, {_lit(s)})" for s in Q.BAD_STARTS) + ")",
    "t43_bad_middle": "(" + " OR ".join(f"contains({_X}, {_lit(s)})" for s in Q.BAD_MIDDLES) + ")",
    "t44_bad_end": f"ends_with({_X}, {_lit(Q.BAD_END)})",
    "t45_many_points": f"contains({_X}, '....')",
    "t46_empty": f"length({_X}) = 0",
    "t47_bad_sign": f"regexp_matches(lower({_X}), {_lit('[^' + _VALID + ']')})",
    "t48_odd_brackets": "(" + " OR ".join(f"length(replace({_X}, '{a}', '')) <> length(replace({_X}, '{b}', ''))" for a, b in ("()", "[]", "{}")) + ")",
    "t49_odd_quotes": f"""((length({_X}) - length(replace({_X}, '"', ''))) % 2 <> 0 OR length(replace({_X}, '“', '')) <> length(replace({_X}, '”', '')))""",
}


def _predicate(name):
    def q(spark, d):
        return documents(spark, d).where(F.exists(F.array(marked_text()), Q.BAD[name])).select("doc_id", "lang")  # the text is marked once

    return q, f"WITH {_MARKED_DOCUMENTS} SELECT doc_id, lang FROM marked WHERE {_BAD_SQL[name]}"


def predicate_counts(spark, d):
    """How many marked documents of each language each predicate rejects, and how many pass all; a text is marked once for all of them."""
    flags = F.transform(F.array(marked_text()), lambda x: F.array(*[f(x) for f in Q.BAD.values()]))[0]
    x = documents(spark, d).select("lang", flags.alias("f"))
    counts = [F.count_if(F.col("f")[k]).alias(n) for k, n in enumerate(Q.BAD)]
    return x.groupBy("lang").agg(F.count("*").alias("n"), *counts, F.count_if(~F.exists("f", lambda b: b)).alias("passed"))


PREDICATE_COUNTS = f"WITH {_MARKED_DOCUMENTS} SELECT lang, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {s}) AS {n}" for n, s in _BAD_SQL.items()) + ", count(*) FILTER (WHERE NOT (" + " OR ".join(_BAD_SQL.values()) + ")) AS passed FROM marked GROUP BY lang"

STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def transform_chain(spark, d):
    x = F.coalesce("text", F.lit(""))
    for step in (T.plain_double_quotes, T.remove_retweets, T.remove_mentions, T.remove_hashtags, T.remove_urls, T.remove_bullet, T.remove_dashed_run):
        x = step(x)
    return documents(spark, d).select("doc_id", T.squeeze(x).alias("clean"))


def _chain_sql() -> str:
    word = r"[\p{L}\p{M}\p{N}_]+"
    x = f"replace(replace(replace(replace(replace({_X}, '«', '\"'), '»', '\"'), '“', '\"'), '”', '\"'), '„', '\"')"
    for pattern in (f"RT @{word}:", f"@{word}", f"#{word}", r"(?:https?://)?[a-zA-Z0-9./?:@\-_=#]+\.[a-zA-Z]{2,6}[a-zA-Z0-9.&/?:@\-_=#…]*", r"^\d+.\s", "---.*---"):
        x = STRIP(f"regexp_replace({x}, '{pattern}', '', 'g')")
    squeezed = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"SELECT doc_id, {STRIP(squeezed)} AS clean FROM documents"


def clean_pairs(spark, d):
    p = pairs(spark, d)
    return p.select("line_no", T.clean_text(F.col("br")).alias("br"), T.normalize_spaces(T.strip_leading_dash(F.col("pt"))).alias("pt"))


CLEAN_PAIRS = rf"""WITH {PAIRS},
x AS (SELECT line_no, regexp_replace(regexp_replace(coalesce(br, ''), '\s*\n\s*', ' ', 'g'), '<[^>]+>|\{{[^}}]+\}}', '', 'g') AS br,
  regexp_replace(replace(coalesce(regexp_replace(pt, '^\s*[-–—]\s*', ''), ''), ' ', ' '), '\s+', ' ', 'g') AS pt FROM pairs)
SELECT line_no, {STRIP('br')} AS br, regexp_replace({STRIP('pt')}, '\s+([,.;:?!…])', '\1', 'g') AS pt FROM x"""


def match_keys(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.match_key(F.coalesce("text", F.lit(""))).cast("binary")).alias("key_md5"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


MATCH_KEYS = rf"""WITH x AS (SELECT doc_id, text, translate(lower({_X}), {_lit(T.ACCENTED)}, {_lit(T.PLAIN)}) AS f FROM documents)
SELECT doc_id, md5({STRIP("regexp_replace(f, '[^" + chr(92) + "p{L}" + chr(92) + "p{M}" + chr(92) + "p{N}_]+', ' ', 'g')")}) AS key_md5, len(regexp_extract_all(coalesce(text, ''), {_lit(T.TOKEN)})) AS n_tokens FROM x"""


def md5_keep_first(spark, d):
    docs = documents(spark, d).withColumn("h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    first = docs.groupBy("source", "lang", "h").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", "source", "lang")


MD5_KEEP_FIRST = "SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang, md5(coalesce(text, ''))"


def funnel(spark, d):
    """Rows that each step of the variety filter leaves, by source and language: not empty, first of its text, good by all predicates, of a usual length.

    One scan: rows are counted by the hash of their text, then texts by their flags and length, and counts and quartiles are taken from that histogram.
    """
    x = documents(spark, d).select("source", "lang", T.squeeze(F.coalesce("text", F.lit(""))).alias("t"))
    x = x.select("source", "lang", F.md5(F.col("t").cast("binary")).alias("h"), F.struct((F.length("t") > 0).alias("full"), Q.passes(F.col("t")).alias("good"), F.size(T.words(F.col("t"))).cast("long").alias("n")).alias("f"))
    texts = x.groupBy("source", "lang", "h").agg(F.first("f").alias("f"), F.count("*").alias("rows"))
    kinds = texts.groupBy("source", "lang", "f.full", (F.col("f.full") & F.col("f.good")).alias("good"), "f.n").agg(F.sum("rows").alias("rows"), F.count("*").alias("texts"))
    total = lambda test, c, name: F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long").alias(name)
    lengths, weight = F.when(F.col("good"), F.col("n")), F.when(F.col("good"), F.col("texts")).otherwise(1)
    q = [F.percentile(lengths, F.lit(p), weight).alias(n) for n, p in (("q1", 0.25), ("q3", 0.75))]
    listed = F.collect_list(F.when(F.col("good"), F.struct("n", "texts"))).alias("lengths")
    out = kinds.groupBy("source", "lang").agg(F.sum("rows").cast("long").alias("raw"), total(F.col("full"), "rows", "after_nonempty"), total(F.col("full"), "texts", "after_dedup"), total(F.col("good"), "texts", "after_filters"), *q, listed)
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    usual = F.aggregate(F.filter("lengths", lambda s: s["n"].between(lo, hi)), F.lit(0).cast("long"), lambda k, s: k + s["texts"])
    out = out.select("source", "lang", "raw", "after_nonempty", "after_dedup", "after_filters", F.coalesce(usual, F.lit(0)).cast("long").alias("after_iqr"), F.round(F.coalesce(lo, F.lit(0.0)), 6).alias("iqr_lo"), F.round(F.coalesce(hi, F.lit(0.0)), 6).alias("iqr_hi"))
    return out.withColumn("drop_dedup", F.col("after_nonempty") - F.col("after_dedup")).withColumn("drop_filters", F.col("after_dedup") - F.col("after_filters")).withColumn("drop_iqr", F.col("after_filters") - F.col("after_iqr"))


_BAD_T = " OR ".join(_BAD_SQL.values()).replace(_X, "t")
FUNNEL = f"""WITH x AS (SELECT doc_id, source, lang, {STRIP(f"regexp_replace({_X}, '" + chr(92) + "s+', ' ', 'g')")} AS t FROM documents),
f AS (SELECT *, length(t) > 0 AND row_number() OVER (PARTITION BY source, lang, md5(t) ORDER BY doc_id) = 1 AS fresh, len(regexp_extract_all(t, '\\S+')) AS n FROM x),
g AS (SELECT *, fresh AND NOT ({_BAD_T}) AS good FROM f),
q AS (SELECT source, lang, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM g WHERE good GROUP BY source, lang),
b AS (SELECT source, lang, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
u AS (SELECT g.*, lo, hi, good AND coalesce(n BETWEEN lo AND hi, false) AS usual FROM g LEFT JOIN b ON g.source = b.source AND g.lang = b.lang),
s AS (SELECT source, lang, count(*) AS raw, count(*) FILTER (WHERE length(t) > 0) AS after_nonempty, count(*) FILTER (WHERE fresh) AS after_dedup, count(*) FILTER (WHERE good) AS after_filters,
  count(*) FILTER (WHERE usual) AS after_iqr, round(coalesce(any_value(lo), 0.0), 6) AS iqr_lo, round(coalesce(any_value(hi), 0.0), 6) AS iqr_hi FROM u GROUP BY source, lang)
SELECT *, after_nonempty - after_dedup AS drop_dedup, after_dedup - after_filters AS drop_filters, after_filters - after_iqr AS drop_iqr FROM s"""

QUERIES = {n: _predicate(n) for n in Q.BAD} | {
    "f13_predicate_counts": (predicate_counts, PREDICATE_COUNTS),
    "t5x_transform_chain": (transform_chain, _chain_sql()),
    "t1_clean_pairs": (clean_pairs, CLEAN_PAIRS),
    "t17_match_keys": (match_keys, MATCH_KEYS),
    "q18_md5_keep_first": (md5_keep_first, MD5_KEEP_FIRST),
    "a18_funnel": (funnel, FUNNEL),
}
