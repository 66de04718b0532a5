"""Audits and small reports: empty sides, consistency of cleaning, bands, worst rows, validation reasons, groups over two tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import similarity as S
from corpusloom.functions import text as T
from corpusloom.operators.relational import islands
from corpusloom.plans.views import PAIRS, documents, pairs, table

_SQUEEZE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_TOKENS = "regexp_extract_all({}, '" + T.TOKEN.replace("'", "''") + "')"


def empty_audit(spark, d):
    p = pairs(spark, d).withColumn("br", F.when(F.col("line_no") % 6 == 0, " ").otherwise(F.col("br"))).withColumn("pt", F.when(F.col("line_no") % 4 != 0, F.col("pt")))
    a, b = (T.blank_to_null(F.col(c)).isNull() for c in ("br", "pt"))
    n = lambda c, name: F.sum(c.cast("int")).cast("long").alias(name)
    return p.agg(F.count("*").alias("n"), n(a, "empty_br"), n(b, "empty_pt"), n(a | b, "any_empty"), n(a & b, "both_empty"))


EMPTY_AUDIT = f"""WITH {PAIRS}, x AS (SELECT line_no % 6 = 0 OR coalesce(regexp_replace(br, '\\s+', '', 'g'), '') = '' AS a, line_no % 4 = 0 OR coalesce(regexp_replace(pt, '\\s+', '', 'g'), '') = '' AS b FROM pairs)
SELECT count(*) AS n, count(*) FILTER (WHERE a) AS empty_br, count(*) FILTER (WHERE b) AS empty_pt, count(*) FILTER (WHERE a OR b) AS any_empty, count(*) FILTER (WHERE a AND b) AS both_empty FROM x"""


def clean_consistency(spark, d):
    """How many stored rows cleaning would still change: cleaned rows joined with themselves cleaned once more; every third has nested markup that one pass leaves."""
    br = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("<<b>i>{ "), "br")).otherwise(F.col("br"))
    once = pairs(spark, d).select("line_no", T.clean_text(br).alias("stored"))
    again = once.select("line_no", T.clean_text(F.col("stored")).alias("cleaned"))
    return once.join(again, "line_no").agg(F.count("*").alias("n"), F.sum((F.col("stored") != F.col("cleaned")).cast("int")).cast("long").alias("changed"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({}, '\s*\n\s*', ' ', 'g'), '<[^>]+>|\{{[^}}]+\}}', '', 'g'), '^\s+|\s+$', '', 'g')"
CLEAN_CONSISTENCY = f"WITH {PAIRS}, x AS (SELECT coalesce(CASE WHEN line_no % 3 = 0 THEN '<<b>i>{{ ' || br ELSE br END, '') AS br FROM pairs), o AS (SELECT {_CLEAN.format('br')} AS stored FROM x) SELECT count(*) AS n, count(*) FILTER (WHERE stored <> {_CLEAN.format('stored')}) AS changed FROM o"


def nearest_rank(spark, d):
    return documents(spark, d).groupBy("lang").agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(text))").cast("long").alias(f"p{int(100 * p)}") for p in (0.5, 0.9)])


NEAREST_RANK = "SELECT lang, quantile_disc(length(text), 0.5) AS p50, quantile_disc(length(text), 0.9) AS p90 FROM documents GROUP BY lang"


def null_last(spark, d):
    """Trials by metric, those without one last: here customers by their cheapest urgent order."""
    best = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.min("o_totalprice").alias("metric"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("trial"))
    ranked = every.join(best, F.col("trial") == F.col("o_custkey"), "left").select("trial", "metric")
    top = ranked.orderBy(F.col("metric").asc_nulls_last(), "trial").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("metric").asc_nulls_last(), "trial"))).select("place", "trial", F.round("metric", 2).alias("metric"))


NULL_LAST = """WITH b AS (SELECT o_custkey, min(o_totalprice) AS metric FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT CAST(row_number() OVER (ORDER BY metric ASC NULLS LAST, c_custkey) AS INTEGER) AS place, c_custkey AS trial, round(metric, 2) AS metric FROM customer LEFT JOIN b ON c_custkey = o_custkey ORDER BY metric ASC NULLS LAST, trial LIMIT 50"""


def score_bands(spark, d):
    x = pairs(spark, d).select(S.type_jaccard(F.col("br"), F.col("pt")).alias("s"))
    return x.groupBy(S.score_band(F.col("s") * 8).alias("band")).agg(F.count("*").alias("n"))


SCORE_BANDS = f"""WITH {PAIRS}, t AS (SELECT list_distinct({_TOKENS.format("lower(coalesce(br, ''))")}) AS a, list_distinct({_TOKENS.format("lower(coalesce(pt, ''))")}) AS b FROM pairs),
s AS (SELECT CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END * 8 AS s FROM t)
SELECT CASE WHEN s < 0.4 THEN 'low' WHEN s < 0.7 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM s GROUP BY 1"""


def worst_rows(spark, d):
    x = pairs(spark, d).select("line_no", F.round(S.type_jaccard(F.col("br"), F.col("pt")), 6).alias("score"))
    return x.orderBy("score", "line_no").limit(10)


WORST_ROWS = f"""WITH {PAIRS}, t AS (SELECT line_no, list_distinct({_TOKENS.format("lower(coalesce(br, ''))")}) AS a, list_distinct({_TOKENS.format("lower(coalesce(pt, ''))")}) AS b FROM pairs)
SELECT line_no, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS score FROM t ORDER BY score, line_no LIMIT 10"""


def mode_validation(spark, d):
    """The first reason for which a candidate pair is refused, or ``ok``: blank side, equal sides, words or sentences out of range."""
    p = pairs(spark, d).select("line_no", T.squeeze(F.coalesce("br", F.lit(""))).alias("a"), T.squeeze(F.coalesce("pt", F.lit(""))).alias("b"))
    words, stops = F.size(T.words(F.col("a"))), T.sentence_count(F.col("a"))
    reason = F.when((F.col("a") == "") | (F.col("b") == ""), "blank").when(F.lower("a") == F.lower("b"), "equal").when(words < 8, "few_words").when(words > 60, "many_words").when(stops > 4, "many_sentences").otherwise("ok")
    return p.select("line_no", reason.alias("reason"))


MODE_VALIDATION = f"""WITH {PAIRS}, x AS (SELECT line_no, {_SQUEEZE.format("coalesce(br, '')")} AS a, {_SQUEEZE.format("coalesce(pt, '')")} AS b FROM pairs)
SELECT line_no, CASE WHEN a = '' OR b = '' THEN 'blank' WHEN lower(a) = lower(b) THEN 'equal' WHEN len(regexp_extract_all(a, '\\S+')) < 8 THEN 'few_words' WHEN len(regexp_extract_all(a, '\\S+')) > 60 THEN 'many_words'
  WHEN len(regexp_extract_all(a, '[.!?…]+(?:\\s|$)')) > 4 THEN 'many_sentences' ELSE 'ok' END AS reason FROM x"""


def dual_groups(spark, d):
    """Rows that go on in the next one on both sides at once: a comma or no stop, and lower case next; groups counted by size.

    Texts are put in lower case and lose their last stops first, as few rows of the test tables go on otherwise.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[.!?]+\s*$", "").alias(c)
    p = pairs(spark, d).select("pair_id", "line_no", bare("br"), bare("pt"))
    w = Window.partitionBy("pair_id").orderBy("line_no")

    def on(c):
        tail, head = F.substring(F.regexp_replace(F.lag(c).over(w), r"\s+$", ""), -1, 1), F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1)
        return ((tail == ",") | ~tail.isin(".", "?", "!")) & (F.lower(head) == head) & (F.upper(head) != head)

    goes_on = on("br") & on("pt")
    marked = islands(p, ["pair_id"], ["line_no"], ~F.coalesce(goes_on, F.lit(False)))
    return marked.groupBy("pair_id", "island").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("groups"))


_ON = "(t{0} = ',' OR t{0} NOT IN ('.', '?', '!')) AND lower(h{0}) = h{0} AND upper(h{0}) <> h{0}"
DUAL_GROUPS = f"""WITH {PAIRS}, x AS (SELECT pair_id, line_no, regexp_replace(lower(br), '[.!?]+\\s*$', '') AS br, regexp_replace(lower(pt), '[.!?]+\\s*$', '') AS pt FROM pairs),
l AS (SELECT *, right(regexp_replace(lag(br) OVER w, '\\s+$', ''), 1) AS t1, left(regexp_replace(br, '^\\s+', ''), 1) AS h1, right(regexp_replace(lag(pt) OVER w, '\\s+$', ''), 1) AS t2, left(regexp_replace(pt, '^\\s+', ''), 1) AS h2 FROM x WINDOW w AS (PARTITION BY pair_id ORDER BY line_no)),
g AS (SELECT *, CASE WHEN coalesce({_ON.format(1)} AND {_ON.format(2)}, false) THEN 0 ELSE 1 END AS new FROM l),
i AS (SELECT *, sum(new) OVER (PARTITION BY pair_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT pair_id, island, count(*) AS rows FROM i GROUP BY pair_id, island) SELECT rows, count(*) AS groups FROM s GROUP BY rows"""

QUERIES = {
    "f11_score_bands": (score_bands, SCORE_BANDS),
    "f12_empty_audit": (empty_audit, EMPTY_AUDIT),
    "f16_mode_validation": (mode_validation, MODE_VALIDATION),
    "a17_nearest_rank": (nearest_rank, NEAREST_RANK),
    "j17_clean_consistency": (clean_consistency, CLEAN_CONSISTENCY),
    "o4_null_last": (null_last, NULL_LAST),
    "o6_worst_rows": (worst_rows, WORST_ROWS),
    "q12_dual_groups": (dual_groups, DUAL_GROUPS),
}
