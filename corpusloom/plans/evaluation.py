"""Evaluation reports: confusion, precision and recall, copy rates, n-gram overlap, best trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.functions import text as T
from corpusloom.operators import metrics as M
from corpusloom.plans.cleaning import _BAD_SQL
from corpusloom.plans.views import PAIRS, documents, pairs, table


def _predictions(spark, d):
    """Gold quality and what the predicates say, with the document's language as bucket."""
    docs = documents(spark, d).select("doc_id", F.coalesce("lang", F.lit("UNKNOWN")).alias("bucket"), Q.passes(F.coalesce("text", F.lit(""))).cast("int").alias("pred"))
    return table(spark, d, "labels").join(docs, "doc_id").select("bucket", F.col("quality").alias("gold"), "pred")


_PRED = "p AS (SELECT coalesce(lang, 'UNKNOWN') AS bucket, quality AS gold, CASE WHEN " + " OR ".join(_BAD_SQL.values()) + " THEN 0 ELSE 1 END AS pred FROM labels JOIN documents USING (doc_id))"


def confusion(spark, d):
    return _predictions(spark, d).groupBy("gold", "pred").agg(F.count("*").alias("n"))


CONFUSION = f"WITH {_PRED} SELECT gold, pred, count(*) AS n FROM p GROUP BY gold, pred"


def binary_report(spark, d):
    """Per bucket and overall: both are groups of one explosion."""
    return M.binary_report(_predictions(spark, d), "bucket")


BINARY_REPORT = f"""WITH {_PRED}, g AS (SELECT 'overall' AS grp, gold, pred FROM p UNION ALL SELECT bucket, gold, pred FROM p),
c AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE gold = 0 AND pred = 0) AS tn FROM g GROUP BY grp),
r AS (SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS r, coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0) AS s FROM c)
SELECT grp, n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(p, 6) AS "precision", round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round((r + s) / 2, 6) AS balanced_accuracy FROM r"""


def macro_f1(spark, d):
    return M.macro_f1(_predictions(spark, d))


MACRO_F1 = f"""WITH {_PRED}, l AS (SELECT gold AS label FROM p UNION SELECT pred FROM p),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold <> label AND pred = label) AS fp, count(*) FILTER (WHERE gold = label AND pred <> label) AS fn FROM p, l GROUP BY label)
SELECT count(*) AS labels, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM c"""


def _hyps(spark, d):
    p = pairs(spark, d).where("trim(coalesce(br, '')) <> '' and trim(coalesce(pt, '')) <> ''")
    hyp = F.when(F.col("line_no") % 3 == 0, F.col("br")).when(F.col("line_no") % 3 == 1, F.concat(F.lit("<think>x\ny</think> "), "pt")).otherwise(F.lower("pt"))
    return p.select("line_no", F.col("br").alias("src"), F.col("pt").alias("ref"), hyp.alias("hyp"))


def copy_rates(spark, d):
    x = _hyps(spark, d).select(T.squeeze("src").alias("s"), T.squeeze("ref").alias("r"), T.without_thoughts(F.col("hyp")).alias("h"))
    x = x.select((F.col("h") == F.col("s")).alias("copied"), (F.col("h") == F.col("r")).alias("exact"), (F.lower("h") == F.lower("r")).alias("loose"), (F.col("s") != F.col("r")).alias("need"))
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return x.agg(F.count("*").alias("n"), n(F.col("copied")).alias("copied"), n(F.col("exact")).alias("exact"), n(F.col("loose")).alias("loose"), n(F.col("need")).alias("need_change"), n(F.col("need") & F.col("copied")).alias("missed"), F.round(100.0 * F.sum((F.col("need") & F.col("copied")).cast("int")) / F.greatest(F.sum(F.col("need").cast("int")), F.lit(1)), 6).alias("pct_missed"))


_SQ = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_HYPS = f"h AS (SELECT line_no, {_SQ.format('br')} AS s, {_SQ.format('pt')} AS r, CASE line_no % 3 WHEN 0 THEN {_SQ.format('br')} WHEN 1 THEN {_SQ.format('pt')} ELSE {_SQ.format('lower(pt)')} END AS h FROM pairs WHERE trim(coalesce(br, '')) <> '' AND trim(coalesce(pt, '')) <> '')"
COPY_RATES = f"""WITH {PAIRS}, {_HYPS} SELECT count(*) AS n, count(*) FILTER (WHERE h = s) AS copied, count(*) FILTER (WHERE h = r) AS exact, count(*) FILTER (WHERE lower(h) = lower(r)) AS loose,
count(*) FILTER (WHERE s <> r) AS need_change, count(*) FILTER (WHERE s <> r AND h = s) AS missed, round(100.0 * count(*) FILTER (WHERE s <> r AND h = s) / greatest(count(*) FILTER (WHERE s <> r), 1), 6) AS pct_missed FROM h"""


def conditional_rate(spark, d):
    docs = documents(spark, d)
    mask, cond = F.length("text") > 2000, F.col("text").contains(" | ")
    top = F.sum(F.when(mask & cond, 1).otherwise(0))
    return docs.groupBy("lang").agg(F.sum(F.when(mask, 1).otherwise(0)).cast("long").alias("masked"), F.round(F.coalesce(F.try_divide(top, F.sum(F.when(mask, 1).otherwise(0))), F.lit(0.0)), 6).alias("rate"))


CONDITIONAL_RATE = "SELECT lang, count(*) FILTER (WHERE length(text) > 2000) AS masked, round(coalesce(count(*) FILTER (WHERE length(text) > 2000 AND contains(text, ' | ')) / CAST(nullif(count(*) FILTER (WHERE length(text) > 2000), 0) AS DOUBLE), 0), 6) AS rate FROM documents GROUP BY lang"


def _translations(spark, d):
    return _hyps(spark, d).select(F.col("line_no").alias("id"), T.without_thoughts(F.col("hyp")).alias("hyp"), T.squeeze("ref").alias("ref"))


def bleu(spark, d):
    return M.corpus_bleu(_translations(spark, d), tokenise=True)


def sentence_bleu(spark, d):
    return M.sentence_bleu(_translations(spark, d))


def worst_bleu(spark, d):
    return M.worst_by_bleu(_translations(spark, d), 20)


def _tokenised(x: str) -> str:
    x = f"' ' || coalesce({x}, '') || ' '"
    for pattern, by in M.BLEU_TOKENS:
        x = f"regexp_replace({x}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


_GRAMS = " UNION ALL ".join(
    f"SELECT id, {n} AS n, '{side}' AS side, array_to_string(list_slice({side}, k, k + {n - 1}), chr(31)) AS gram FROM (SELECT id, {side}, unnest(range(1, len({side}) - {n - 2})) AS k FROM w WHERE len({side}) >= {n})"
    for n in (1, 2, 3, 4)
    for side in ("hyp", "ref")
)
_MATCHES = f"""{PAIRS}, {_HYPS}, w AS (SELECT line_no AS id, {_tokenised('h')} AS hyp, {_tokenised('r')} AS ref FROM h), g AS ({_GRAMS}),
c AS (SELECT id, n, gram, count(*) FILTER (WHERE side = 'hyp') AS a, count(*) FILTER (WHERE side = 'ref') AS b FROM g GROUP BY id, n, gram),
m AS (SELECT id, n, CAST(sum(least(a, b)) AS BIGINT) AS matched, CAST(sum(a) AS BIGINT) AS total FROM c GROUP BY id, n HAVING sum(a) > 0)"""
_LOG = "ln(CASE WHEN matched > 0 THEN matched / CAST(total AS DOUBLE) ELSE 1 / (power(2, count(*) FILTER (WHERE matched = 0) OVER w) * total) END)"
BLEU = f"""WITH {_MATCHES}, t AS (SELECT n, sum(matched) AS matched, sum(total) AS total FROM m GROUP BY n),
s AS (SELECT n, matched, {_LOG} AS l FROM t WINDOW w AS (ORDER BY n ROWS UNBOUNDED PRECEDING)),
l AS (SELECT CAST(sum(len(hyp)) AS BIGINT) AS hl, CAST(sum(len(ref)) AS BIGINT) AS rl FROM w),
x AS (SELECT hl, rl, (SELECT count(*) FROM s) = 4 AND (SELECT max(matched) FROM s) > 0 AS has_some, (SELECT min(matched) FROM s) > 0 AS has_every,
  round(100 * CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / CAST(hl AS DOUBLE)) END * exp((SELECT avg(l) FROM s)), 4) AS v FROM l)
SELECT hl AS hyp_words, rl AS ref_words, CASE WHEN has_some AND has_every THEN v ELSE 0.0 END AS bleu, CASE WHEN has_some THEN v ELSE 0.0 END AS bleu_smoothed FROM x"""
_SENTENCE = f"""{_MATCHES}, s AS (SELECT id, n, matched, {_LOG} AS l FROM m WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
t AS (SELECT id, max(matched) AS most, avg(l) AS l FROM s GROUP BY id),
b AS (SELECT w.id, CASE WHEN coalesce(most, 0) = 0 THEN 0.0 ELSE round(100 * CASE WHEN len(hyp) >= len(ref) THEN 1.0 ELSE exp(1 - len(ref) / CAST(len(hyp) AS DOUBLE)) END * exp(l), 4) END AS sentence_bleu FROM w LEFT JOIN t ON w.id = t.id)"""
SENTENCE_BLEU = f"WITH {_SENTENCE} SELECT id, sentence_bleu FROM b"
WORST_BLEU = f"WITH {_SENTENCE} SELECT id, sentence_bleu FROM b ORDER BY sentence_bleu, id LIMIT 20"


def best_metric(spark, d):
    """Of each user's events the one with the least value; of equal ones the first."""
    e = table(spark, d, "events").select("user_id", "event_id", "value").where("value is not null")
    best = e.groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("b"))
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return every.join(best, "user_id", "left").select("user_id", F.round("b.value", 6).alias("best"), F.col("b.event_id").alias("step"), F.when(F.col("b").isNull(), "unknown").otherwise("done").alias("status"))


BEST_METRIC = """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events WHERE value IS NOT NULL)
SELECT c_custkey AS user_id, round(value, 6) AS best, event_id AS step, CASE WHEN event_id IS NULL THEN 'unknown' ELSE 'done' END AS status FROM customer LEFT JOIN r ON c_custkey = user_id AND n = 1"""


def topk_per_group(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).where("place <= 5").select("o_orderpriority", "place", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


TOPK_PER_GROUP = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders) SELECT o_orderpriority, CAST(place AS INTEGER) AS place, o_orderkey, round(o_totalprice, 2) AS price FROM r WHERE place <= 5"


def json_log(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").cast("long").alias("total"))


JSON_LOG = "WITH x AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_type, count(k) AS n, min(k) AS least, max(k) AS most, CAST(sum(k) AS BIGINT) AS total FROM x GROUP BY event_type"

QUERIES = {
    "a23_confusion": (confusion, CONFUSION),
    "a24_binary_report": (binary_report, BINARY_REPORT),
    "a25_macro_f1": (macro_f1, MACRO_F1),
    "a26_bleu": (bleu, BLEU),
    "a26_sentence_bleu": (sentence_bleu, SENTENCE_BLEU),
    "a26_worst_bleu": (worst_bleu, WORST_BLEU),
    "a27_copy_rates": (copy_rates, COPY_RATES),
    "a28_conditional_rate": (conditional_rate, CONDITIONAL_RATE),
    "a30_best_metric": (best_metric, BEST_METRIC),
    "o5_topk_per_group": (topk_per_group, TOPK_PER_GROUP),
    "s9_json_log": (json_log, JSON_LOG),
}
