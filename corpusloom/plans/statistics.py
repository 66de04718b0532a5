"""Corpus statistics: counts, lengths, ratios, outliers, vocabularies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.relational import exact_percentiles
from corpusloom.plans.views import PAIRS, documents, pairs, table

LOW, HIGH, HARD_LOW, HARD_HIGH = 0.8, 1.25, 0.5, 2.0


def _n(c):
    return F.count("*").alias(c)


def _sum(cond, name):
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias(name)


def distinct_profile(spark, d):
    p = pairs(spark, d)
    words = T.words(F.col("br"))
    return p.agg(_n("n_rows"), F.countDistinct("br").alias("br_types"), F.countDistinct("pt").alias("pt_types"), F.countDistinct("br", "pt").alias("pair_types"), _sum(F.coalesce(F.trim("br"), F.lit("")) == "", "br_blank"), _sum(F.coalesce(F.trim("pt"), F.lit("")) == "", "pt_blank"), F.sum(F.size(words)).cast("long").alias("br_words"))


DISTINCT_PROFILE = f"""WITH {PAIRS}
SELECT count(*) AS n_rows, count(DISTINCT br) AS br_types, count(DISTINCT pt) AS pt_types, count(DISTINCT br || chr(31) || pt) AS pair_types,
  count(*) FILTER (WHERE coalesce(trim(br), '') = '') AS br_blank, count(*) FILTER (WHERE coalesce(trim(pt), '') = '') AS pt_blank,
  CAST(sum(len(regexp_extract_all(br, '\\S+'))) AS BIGINT) AS br_words FROM pairs"""


def ratio_stats(spark, d):
    p = pairs(spark, d).select(F.length("br").alias("lb"), F.length("pt").alias("lp")).where("lb > 0 and lp > 0").withColumn("r", F.col("lp") / F.col("lb"))
    pct = lambda cond, name: F.round(100.0 * F.sum(F.when(cond, 1).otherwise(0)) / F.count("*"), 6).alias(name)
    inside = F.col("r").between(LOW, HIGH)
    loose = F.col("r").between(HARD_LOW, HARD_HIGH)
    median, q1, q3 = (F.round(F.lit(q).cast("double"), 6) for q in exact_percentiles(p, "r", (0.5, 0.25, 0.75)))
    return p.agg(_n("n"), F.round(F.avg("r"), 6).alias("mean_ratio"), median.alias("median_ratio"), q1.alias("q1"), q3.alias("q3"), _sum(inside, "strict_ok"), _sum(loose, "loose_ok"), _sum(~loose, "outliers"), pct(inside, "pct_strict"), pct(loose, "pct_loose"), F.round(F.corr("lb", "lp"), 6).alias("length_corr"))


RATIO_STATS = f"""WITH {PAIRS},
x AS (SELECT length(br) AS lb, length(pt) AS lp, length(pt) / CAST(length(br) AS DOUBLE) AS r FROM pairs WHERE length(br) > 0 AND length(pt) > 0)
SELECT count(*) AS n, round(avg(r), 6) AS mean_ratio, round(quantile_cont(r, 0.5), 6) AS median_ratio, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.75), 6) AS q3,
  count(*) FILTER (WHERE r BETWEEN {LOW} AND {HIGH}) AS strict_ok, count(*) FILTER (WHERE r BETWEEN {HARD_LOW} AND {HARD_HIGH}) AS loose_ok,
  count(*) FILTER (WHERE NOT r BETWEEN {HARD_LOW} AND {HARD_HIGH}) AS outliers,
  round(100.0 * count(*) FILTER (WHERE r BETWEEN {LOW} AND {HIGH}) / count(*), 6) AS pct_strict,
  round(100.0 * count(*) FILTER (WHERE r BETWEEN {HARD_LOW} AND {HARD_HIGH}) / count(*), 6) AS pct_loose, round(corr(lb, lp), 6) AS length_corr FROM x"""


def _ratios(spark, d):
    p = pairs(spark, d).withColumn("lb", F.length("br")).withColumn("lp", F.length("pt"))
    return p.where("lb > 0 and lp > 0").select("line_no", "lb", "lp", (F.col("lp") / F.col("lb")).alias("r"))


def mad_outliers(spark, d):
    x = _ratios(spark, d)
    (med,) = exact_percentiles(x, "r", (0.5,))
    off = x.withColumn("off", F.abs(F.col("r") - F.lit(med).cast("double")))
    (mad,) = exact_percentiles(off, "off", (0.5,))
    z = off.withColumn("z", 0.6745 * F.col("off") / F.lit(mad or None).cast("double"))
    hard = ~F.col("r").between(HARD_LOW, HARD_HIGH)
    robust = F.coalesce(F.col("z") > 3.5, F.lit(False))
    return z.agg(_n("n"), F.round(F.lit(med).cast("double"), 6).alias("med"), F.round(F.lit(mad).cast("double"), 6).alias("mad"), _sum(hard, "n_hard"), _sum(robust, "n_robust"), _sum(hard & robust, "n_both"), _sum(hard | robust, "n_union"))


MAD_OUTLIERS = f"""WITH {PAIRS},
x AS (SELECT length(pt) / CAST(length(br) AS DOUBLE) AS r FROM pairs WHERE length(br) > 0 AND length(pt) > 0),
m AS (SELECT quantile_cont(r, 0.5) AS med FROM x),
o AS (SELECT r, med, abs(r - med) AS off FROM x, m),
s AS (SELECT quantile_cont(off, 0.5) AS mad FROM o),
z AS (SELECT r, med, mad, coalesce(0.6745 * off / nullif(mad, 0) > 3.5, false) AS robust, NOT r BETWEEN {HARD_LOW} AND {HARD_HIGH} AS hard FROM o, s)
SELECT count(*) AS n, round(any_value(med), 6) AS med, round(any_value(mad), 6) AS mad, count(*) FILTER (WHERE hard) AS n_hard, count(*) FILTER (WHERE robust) AS n_robust,
  count(*) FILTER (WHERE hard AND robust) AS n_both, count(*) FILTER (WHERE hard OR robust) AS n_union FROM z"""


def outlier_report(spark, d):
    x = _ratios(spark, d).withColumn("ratio", F.round("r", 6)).drop("r")
    low = x.where(F.col("ratio") < HARD_LOW).orderBy("ratio", "line_no").limit(10).withColumn("side", F.lit("short"))
    high = x.where(F.col("ratio") > HARD_HIGH).orderBy(F.col("ratio").desc(), "line_no").limit(10).withColumn("side", F.lit("long"))
    return low.unionByName(high).select("side", "line_no", F.col("lb").cast("long").alias("lb"), F.col("lp").cast("long").alias("lp"), "ratio")


OUTLIER_REPORT = f"""WITH {PAIRS},
x AS (SELECT line_no, length(br) AS lb, length(pt) AS lp, round(length(pt) / CAST(length(br) AS DOUBLE), 6) AS ratio FROM pairs WHERE length(br) > 0 AND length(pt) > 0)
(SELECT 'short' AS side, line_no, lb, lp, ratio FROM x WHERE ratio < {HARD_LOW} ORDER BY ratio, line_no LIMIT 10)
UNION ALL (SELECT 'long' AS side, line_no, lb, lp, ratio FROM x WHERE ratio > {HARD_HIGH} ORDER BY ratio DESC, line_no LIMIT 10)"""


def scatter_data(spark, d):
    """Points for a length scatter: a seeded sample of rows inside the band, and of long enough rows outside it the most extreme of either side."""
    x = _ratios(spark, d).withColumn("ratio", F.round("r", 6))
    inside = x.where(F.col("ratio").between(HARD_LOW, HARD_HIGH)).orderBy(F.md5(F.concat(F.lit("7:"), F.col("line_no").cast("string")).cast("binary")), "line_no").limit(200)
    out = x.where((F.col("lb") >= 30) & (F.col("lp") >= 30))
    low = out.where(F.col("ratio") < HARD_LOW).orderBy("ratio", "line_no").limit(50)
    high = out.where(F.col("ratio") > HARD_HIGH).orderBy(F.col("ratio").desc(), "line_no").limit(50)
    parts = [p.select("line_no", F.col("lb").cast("long").alias("lb"), F.col("lp").cast("long").alias("lp"), F.lit(name).alias("layer")) for name, p in (("band", inside), ("short", low), ("long", high))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SCATTER_DATA = f"""WITH {PAIRS},
x AS (SELECT line_no, length(br) AS lb, length(pt) AS lp, round(length(pt) / CAST(length(br) AS DOUBLE), 6) AS ratio FROM pairs WHERE length(br) > 0 AND length(pt) > 0)
(SELECT line_no, lb, lp, 'band' AS layer FROM x WHERE ratio BETWEEN {HARD_LOW} AND {HARD_HIGH} ORDER BY md5('7:' || line_no), line_no LIMIT 200)
UNION ALL (SELECT line_no, lb, lp, 'short' FROM x WHERE lb >= 30 AND lp >= 30 AND ratio < {HARD_LOW} ORDER BY ratio, line_no LIMIT 50)
UNION ALL (SELECT line_no, lb, lp, 'long' FROM x WHERE lb >= 30 AND lp >= 30 AND ratio > {HARD_HIGH} ORDER BY ratio DESC, line_no LIMIT 50)"""


def hard_outlier_delete(spark, d):
    p = pairs(spark, d)
    r = F.length("pt") / F.when(F.length("br") > 0, F.length("br"))
    return p.where(~F.coalesce((r < HARD_LOW) | (r > HARD_HIGH), F.lit(False))).select("line_no", "br", "pt")


HARD_OUTLIER_DELETE = f"""WITH {PAIRS} SELECT line_no, br, pt FROM pairs
WHERE NOT coalesce(length(pt) / CAST(nullif(length(br), 0) AS DOUBLE) NOT BETWEEN {HARD_LOW} AND {HARD_HIGH}, false)"""

_FREQ_TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-'’][A-Za-zÀ-ÖØ-öø-ÿ]+)*"


def _vocabulary(docs, langs):
    found = docs.where(F.col("lang").isin(*langs)).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_FREQ_TOKEN), F.lit(0))).alias("tok"))
    return found.groupBy("lang", "tok").agg(F.count("*").alias("c"))


def word_freq_gap(spark, d):
    """Tokens whose frequency per million differs most between two languages, the first 100."""
    v = _vocabulary(documents(spark, d), ("en", "es"))
    totals = v.groupBy().agg(F.sum(F.when(F.col("lang") == "en", F.col("c"))).alias("n_a"), F.sum(F.when(F.col("lang") == "es", F.col("c"))).alias("n_b"))
    wide = v.groupBy("tok").agg(F.sum(F.when(F.col("lang") == "en", F.col("c")).otherwise(0)).cast("long").alias("c_a"), F.sum(F.when(F.col("lang") == "es", F.col("c")).otherwise(0)).cast("long").alias("c_b"))
    x = wide.where("c_a + c_b >= 5").crossJoin(F.broadcast(totals))
    x = x.withColumn("fpm_a", F.round(F.col("c_a") * 1e6 / F.col("n_a"), 3)).withColumn("fpm_b", F.round(F.col("c_b") * 1e6 / F.col("n_b"), 3)).withColumn("delta", F.round(F.col("c_a") * 1e6 / F.col("n_a") - F.col("c_b") * 1e6 / F.col("n_b"), 3))
    return x.orderBy(F.abs("delta").desc(), "tok").limit(100).select("tok", "c_a", "c_b", "fpm_a", "fpm_b", "delta")


_VOCAB_SQL = f"""v AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{_FREQ_TOKEN.replace("'", "''")}')) AS tok FROM documents WHERE lang IN ('en', 'es'))"""
WORD_FREQ_GAP = f"""WITH {_VOCAB_SQL},
n AS (SELECT count(*) FILTER (WHERE lang = 'en') AS n_a, count(*) FILTER (WHERE lang = 'es') AS n_b FROM v),
w AS (SELECT tok, count(*) FILTER (WHERE lang = 'en') AS c_a, count(*) FILTER (WHERE lang = 'es') AS c_b FROM v GROUP BY tok)
SELECT tok, c_a, c_b, round(c_a * 1e6 / n_a, 3) AS fpm_a, round(c_b * 1e6 / n_b, 3) AS fpm_b, round(c_a * 1e6 / n_a - c_b * 1e6 / n_b, 3) AS delta
FROM w, n WHERE c_a + c_b >= 5 ORDER BY abs(round(c_a * 1e6 / n_a - c_b * 1e6 / n_b, 3)) DESC, tok LIMIT 100"""


def vocab_overlap(spark, d):
    v = _vocabulary(documents(spark, d), ("en", "es")).groupBy("tok").agg(F.sum(F.when(F.col("lang") == "en", F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("lang") == "es", F.col("c")).otherwise(0)).alias("b"))
    return v.agg(_sum(F.col("a") > 0, "types_a"), _sum(F.col("b") > 0, "types_b"), _sum((F.col("a") > 0) & (F.col("b") > 0), "shared"), _sum(F.col("b") == 0, "only_a"), _sum(F.col("a") == 0, "only_b"), F.round(F.sum(F.when(F.col("a") > 0, 1).otherwise(0)) / F.sum("a"), 6).alias("ttr_a"))


VOCAB_OVERLAP = f"""WITH {_VOCAB_SQL},
w AS (SELECT tok, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'es') AS b FROM v GROUP BY tok)
SELECT count(*) FILTER (WHERE a > 0) AS types_a, count(*) FILTER (WHERE b > 0) AS types_b, count(*) FILTER (WHERE a > 0 AND b > 0) AS shared,
  count(*) FILTER (WHERE b = 0) AS only_a, count(*) FILTER (WHERE a = 0) AS only_b, round(count(*) FILTER (WHERE a > 0) / CAST(sum(a) AS DOUBLE), 6) AS ttr_a FROM w"""


def token_stats(spark, d):
    x = documents(spark, d).select(F.coalesce(F.lower("lang"), F.lit("(null)")).alias("split"), F.size(T.tokens(F.col("text"))).alias("n"))
    return x.groupBy("split").agg(_n("n_rows"), F.sum("n").cast("long").alias("total_tokens"), F.round(F.avg("n"), 6).alias("mean_tokens"))


TOKEN_STATS = f"""SELECT coalesce(lower(lang), '(null)') AS split, count(*) AS n_rows, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{T.TOKEN.replace("'", "''")}'))) AS BIGINT) AS total_tokens,
  round(avg(len(regexp_extract_all(coalesce(text, ''), '{T.TOKEN.replace("'", "''")}'))), 6) AS mean_tokens FROM documents GROUP BY 1"""


def char_len_stats(spark, d):
    """Of each language; percentiles are taken from the histogram of lengths, which is counted before anything moves."""
    x = documents(spark, d).groupBy("lang", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("c"))
    known = F.when(F.col("n").isNotNull(), F.col("c"))
    return x.groupBy("lang").agg(F.sum("c").alias("n_rows"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum(known), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), *[F.round(F.percentile("n", F.lit(p), F.col("c")), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)])


CHAR_LEN_STATS = "SELECT lang, count(*) AS n_rows, round(avg(length(text)), 6) AS mean, min(length(text)) AS least, max(length(text)) AS most, " + ", ".join(f"round(quantile_cont(length(text), {p}), 6) AS p{int(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + " FROM documents GROUP BY lang"


def approximate_length_stats(spark, d):
    """Whether sketched quantiles of lengths are within the stated share of ranks of exact ones: a sketch of 1/1000 a language, checked by counting."""
    x = documents(spark, d).select("lang", F.length("text").cast("long").alias("n")).where("n IS NOT NULL")
    shares = (0.5, 0.9, 0.95, 0.99)
    q = x.groupBy("lang").agg(F.percentile_approx("n", list(shares), 1000).alias("q"))
    y = x.groupBy("lang", "n").agg(F.count("*").alias("c")).join(F.broadcast(q), "lang")
    near = [((F.sum(F.when(F.col("n") < F.col("q")[k], F.col("c")).otherwise(0)) <= p * F.sum("c") + 0.002 * F.sum("c") + 1) & (F.sum(F.when(F.col("n") <= F.col("q")[k], F.col("c")).otherwise(0)) >= p * F.sum("c") - 0.002 * F.sum("c") - 1)).alias(f"p{int(100 * p)}_near") for k, p in enumerate(shares)]
    return y.groupBy("lang").agg(F.sum("c").alias("n_rows"), *near)


APPROXIMATE_LENGTH_STATS = "SELECT lang, count(*) AS n_rows, true AS p50_near, true AS p90_near, true AS p95_near, true AS p99_near FROM documents WHERE text IS NOT NULL GROUP BY lang"


def counts_by_split(spark, d):
    return documents(spark, d).groupBy(F.coalesce("source", F.lit("(null)")).alias("dataset"), F.coalesce("lang", F.lit("(null)")).alias("split")).agg(_n("n"))


COUNTS_BY_SPLIT = "SELECT coalesce(source, '(null)') AS dataset, coalesce(lang, '(null)') AS split, count(*) AS n FROM documents GROUP BY 1, 2"


def top_buckets(spark, d):
    return documents(spark, d).groupBy(F.coalesce("source", F.lit("(null)")).alias("bucket"), "lang").agg(_n("n")).orderBy(F.col("n").desc(), "bucket", "lang").limit(20)


TOP_BUCKETS = "SELECT coalesce(source, '(null)') AS bucket, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, bucket, lang LIMIT 20"


def domain_stats(spark, d):
    have = F.length(F.trim("source")) > 0
    return documents(spark, d).groupBy("lang").agg(_n("total"), _sum(have, "present"), _sum(~F.coalesce(have, F.lit(False)), "missing"))


DOMAIN_STATS = "SELECT lang, count(*) AS total, count(*) FILTER (WHERE length(trim(source)) > 0) AS present, count(*) FILTER (WHERE NOT coalesce(length(trim(source)) > 0, false)) AS missing FROM documents GROUP BY lang"


def label_pivot(spark, d):
    x = documents(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).na.fill(0)
    total = sum((F.col(c) for c in ("de", "en", "es", "fr")), F.lit(0))
    return x.withColumn("total", total).select("source", *[F.col(c).cast("long").alias(c) for c in ("de", "en", "es", "fr")], F.col("total").cast("long"), *[F.round(100.0 * F.col(c) / F.col("total"), 4).alias(f"pct_{c}") for c in ("de", "en")])


LABEL_PIVOT = """WITH x AS (SELECT source, count(doc_id) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source)
SELECT source, de, en, es, fr, de + en + es + fr AS total, round(100.0 * de / (de + en + es + fr), 4) AS pct_de, round(100.0 * en / (de + en + es + fr), 4) AS pct_en FROM x"""


def identical_rate(spark, d):
    p = pairs(spark, d).select(F.pmod("pair_id", F.lit(4)).alias("split"), (F.lower(F.trim("br")) == F.lower(F.trim("pt"))).alias("same"))
    return p.groupBy("split").agg(_n("n"), _sum(F.col("same"), "same"), F.round(F.avg(F.col("same").cast("double")), 6).alias("rate"))


IDENTICAL_RATE = f"WITH {PAIRS} SELECT pair_id % 4 AS split, count(*) AS n, count(*) FILTER (WHERE lower(trim(br)) = lower(trim(pt))) AS same, round(avg(CASE WHEN lower(trim(br)) = lower(trim(pt)) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM pairs GROUP BY 1"


def opening_counts(spark, d):
    x = documents(spark, d).select(T.opening(F.col("text"), 2).alias("opening")).where("opening <> ''")
    return x.groupBy("opening").agg(_n("n")).orderBy(F.col("n").desc(), "opening").limit(12)


OPENING_COUNTS = f"""WITH x AS (SELECT array_to_string(list_slice(regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN.replace("'", "''")}'), 1, 2), ' ') AS opening FROM documents)
SELECT opening, count(*) AS n FROM x WHERE opening <> '' GROUP BY opening ORDER BY n DESC, opening LIMIT 12"""


def key_bounds(spark, d):
    return pairs(spark, d).agg(F.min("line_no").alias("low"), F.max("line_no").alias("high"), F.countDistinct("pair_id").alias("segments"), _n("n"))


KEY_BOUNDS = f"WITH {PAIRS} SELECT min(line_no) AS low, max(line_no) AS high, count(DISTINCT pair_id) AS segments, count(*) AS n FROM pairs"


def iqr_filter(spark, d):
    x = documents(spark, d).select("doc_id", "source", "lang", F.size(T.words(F.col("text"))).alias("n"))
    q = x.groupBy("source", "lang").agg(F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"))
    q = q.select("source", "lang", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))
    return x.join(q, ["source", "lang"]).where(F.col("n").between(F.col("lo"), F.col("hi"))).select("doc_id", F.col("n").cast("long").alias("n"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


IQR_FILTER = """WITH x AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents),
q AS (SELECT source, lang, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM x GROUP BY source, lang),
b AS (SELECT source, lang, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT doc_id, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM x JOIN b USING (source, lang) WHERE n BETWEEN lo AND hi"""


def order_value_percentages(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(_n("n"))
    return o.select("o_orderpriority", "o_orderstatus", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("o_orderpriority")), 4).alias("pct"))


ORDER_PCT = "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 4) AS pct FROM orders GROUP BY 1, 2"

QUERIES = {
    "a2_key_bounds": (key_bounds, KEY_BOUNDS),
    "a3_distinct_profile": (distinct_profile, DISTINCT_PROFILE),
    "a5_counts_by_split": (counts_by_split, COUNTS_BY_SPLIT),
    "a6_top_buckets": (top_buckets, TOP_BUCKETS),
    "a7_domain_stats": (domain_stats, DOMAIN_STATS),
    "a9_char_len_stats": (char_len_stats, CHAR_LEN_STATS),
    "a11_sketched_lengths": (approximate_length_stats, APPROXIMATE_LENGTH_STATS),
    "a13_ratio_stats": (ratio_stats, RATIO_STATS),
    "a14_mad_outliers": (mad_outliers, MAD_OUTLIERS),
    "a16_iqr_filter": (iqr_filter, IQR_FILTER),
    "a20_word_freq_gap": (word_freq_gap, WORD_FREQ_GAP),
    "a21_vocab_overlap": (vocab_overlap, VOCAB_OVERLAP),
    "a22_token_stats": (token_stats, TOKEN_STATS),
    "a29_label_pivot": (label_pivot, LABEL_PIVOT),
    "a31_opening_counts": (opening_counts, OPENING_COUNTS),
    "a33_identical_rate": (identical_rate, IDENTICAL_RATE),
    "f15_hard_outlier_delete": (hard_outlier_delete, HARD_OUTLIER_DELETE),
    "j16_group_percentages": (order_value_percentages, ORDER_PCT),
    "r7_scatter_data": (scatter_data, SCATTER_DATA),
    "o2_outlier_report": (outlier_report, OUTLIER_REPORT),
}
