"""Classification and translation scores as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_report(df: DataFrame, bucket: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Counts and scores of label 1 for ``overall`` and each bucket; rows are exploded into their groups once."""
    x = df.select(F.explode(F.array(F.lit("overall"), F.col(bucket))).alias("grp"), F.col(gold).alias("g"), F.col(pred).alias("p"))
    n = lambda g, p: F.sum(((F.col("g") == g) & (F.col("p") == p)).cast("int")).cast("long")
    c = x.groupBy("grp").agg(F.count("*").alias("n"), n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    p, r, s = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fp)
    return c.select("grp", "n", "tp", "fp", "fn", "tn", F.round((tp + tn) / F.col("n"), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_share(2 * p * r, p + r), 6).alias("f1"), F.round((r + s) / 2, 6).alias("balanced_accuracy"))


def macro_f1(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Mean F1 over every label that occurs on either side."""
    one = df.select(F.col(gold).alias("g"), F.col(pred).alias("p"))
    sides = one.select(F.explode(F.array(F.struct(F.col("g").alias("label"), (F.col("g") == F.col("p")).cast("int").alias("hit"), F.lit(0).alias("fp"), (F.col("g") != F.col("p")).cast("int").alias("fn")), F.struct(F.col("p").alias("label"), F.lit(0).alias("hit"), (F.col("g") != F.col("p")).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("s")).select("s.*")
    c = sides.groupBy("label").agg(F.sum("hit").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return c.agg(F.count("*").alias("labels"), F.round(F.avg(_share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("macro_f1"))


# Fixed values of the published tokenisation for BLEU ("13a"): what is replaced, in this order.
BLEU_TOKENS = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def bleu_tokens(text: Column) -> Column:
    """Words by the published rules; an empty text has none."""
    x = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for pattern, by in BLEU_TOKENS:
        x = F.regexp_replace(x, pattern, by)
    return F.filter(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda w: w != "")


def ngram_matches(words: DataFrame, most: int = 4) -> DataFrame:
    """Of (id, hyp, ref) token arrays: id, n, ``matched`` (clipped by the reference's counts) and ``total`` n-grams of each length."""

    def grams(side: str, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(side) - n + 1), lambda k: F.array_join(F.slice(F.col(side), k, F.lit(n)), "\x1f"))
        return F.transform(F.when(F.size(side) >= n, runs).otherwise(F.array().cast("array<string>")), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram"), F.lit(side).alias("side")))

    every = words.select("id", F.explode(F.concat(*[grams(side, n) for n in range(1, most + 1) for side in ("hyp", "ref")])).alias("g")).select("id", "g.*")
    counts = every.groupBy("id", "n", "gram").agg(F.count_if(F.col("side") == "hyp").alias("a"), F.count_if(F.col("side") == "ref").alias("b"))
    return counts.groupBy("id", "n").agg(F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("total")).where("total > 0")


def _score(matched: Column, total: Column, hyp: Column, ref: Column, orders: Column, smoothed: bool) -> Column:
    """From arrays of matched and all n-grams by length: 0 if nothing matches, or an order doesn't and isn't smoothed, or is missing from ``orders``.

    Smoothed, the k-th order without a match counts as 1 / 2**k matches of one n-gram.
    """
    pairs = F.arrays_zip(matched.alias("m"), total.alias("t"))
    missing = lambda k: F.size(F.filter(F.slice(matched, 1, k + 1), lambda m: m == 0))
    logs = F.transform(pairs, lambda p, k: F.log(F.when(p["m"] > 0, p["m"] / p["t"]).otherwise(1 / (F.pow(F.lit(2.0), missing(k)) * p["t"]))))
    none = F.exists(matched, lambda m: m > 0)
    good = F.coalesce(none, F.lit(False)) & (F.size(matched) >= orders)
    if not smoothed:
        good = good & ~F.exists(matched, lambda m: m == 0)
    brevity = F.when(hyp >= ref, 1.0).otherwise(F.exp(1 - ref / hyp))
    return F.when(good, F.round(100 * brevity * F.exp(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x) / F.size(logs)), 4)).otherwise(0.0)


def _in_order(matches: DataFrame, *by: str) -> DataFrame:
    listed = matches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "matched", "total"))).alias("x"))  # one item for each length
    return listed.select(*by, F.col("x.matched").alias("matched"), F.col("x.total").alias("total"))


def corpus_bleu(df: DataFrame, most: int = 4, tokenise: bool = False) -> DataFrame:
    """BLEU over all (id, hyp, ref): words split at blanks or by the published rules, clipped n-gram counts, brevity penalty.

    ``bleu`` is not smoothed: 0 where an order has no match.  ``bleu_smoothed`` is what the published tool gives by default.  0 for an empty table.
    """
    split = bleu_tokens if tokenise else lambda c: F.split(c, " ")
    words = df.select("id", split(F.col("hyp")).alias("hyp"), split(F.col("ref")).alias("ref"))
    by_n = ngram_matches(words, most).groupBy("n").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
    counts = _in_order(by_n.withColumn("one", F.lit(1)), "one")
    sizes = words.agg(F.coalesce(F.sum(F.size("hyp")), F.lit(0)).cast("long").alias("hyp_words"), F.coalesce(F.sum(F.size("ref")), F.lit(0)).cast("long").alias("ref_words")).withColumn("one", F.lit(1))
    x = sizes.join(counts, "one", "left")
    score = lambda smoothed: F.coalesce(_score(F.col("matched"), F.col("total"), F.col("hyp_words"), F.col("ref_words"), F.lit(most), smoothed), F.lit(0.0))
    return x.select("hyp_words", "ref_words", score(False).alias("bleu"), score(True).alias("bleu_smoothed"))


def bleu_by_group(df: DataFrame, most: int = 4) -> DataFrame:
    """``grp``, ``n``, ``exact`` and smoothed corpus ``bleu`` by the published rules of (id, hyp, ref, grp); a row may be in several groups, its n-grams are matched once."""
    once = df.dropDuplicates(["id"]).select("id", bleu_tokens(F.col("hyp")).alias("hyp"), bleu_tokens(F.col("ref")).alias("ref"))
    groups = df.select("id", "grp", (F.col("hyp") == F.col("ref")).alias("same"))
    by_n = ngram_matches(once, most).join(groups, "id").groupBy("grp", "n").agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
    sizes = once.select("id", F.size("hyp").alias("h"), F.size("ref").alias("r")).join(groups, "id").groupBy("grp").agg(F.count("*").alias("n"), F.count_if("same").alias("exact"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    x = sizes.join(_in_order(by_n, "grp"), "grp", "left")
    return x.select("grp", "n", "exact", F.coalesce(_score(F.col("matched"), F.col("total"), F.col("h"), F.col("r"), F.lit(most), True), F.lit(0.0)).alias("bleu"))


def sentence_bleu(df: DataFrame, most: int = 4) -> DataFrame:
    """``id``, ``sentence_bleu`` of each (id, hyp, ref) by the published rules: smoothed, over the n-gram lengths that the hypothesis has; 0 without a match."""
    words = df.select("id", bleu_tokens(F.col("hyp")).alias("hyp"), bleu_tokens(F.col("ref")).alias("ref"))
    counts = _in_order(ngram_matches(words, most), "id")
    x = words.select("id", F.size("hyp").alias("h"), F.size("ref").alias("r")).join(counts, "id", "left")
    return x.select("id", F.coalesce(_score(F.col("matched"), F.col("total"), F.col("h"), F.col("r"), F.lit(1), True), F.lit(0.0)).alias("sentence_bleu"))


def worst_by_bleu(df: DataFrame, k: int = 20) -> DataFrame:
    """The k rows with the least sentence BLEU, ties by id."""
    return sentence_bleu(df).orderBy("sentence_bleu", "id").limit(k)
