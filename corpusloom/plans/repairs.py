"""Line and web-text repairs one by one, over pairs that are made to need them."""

from __future__ import annotations

import gc
import itertools

from pyspark.sql import functions as F

from corpusloom.functions import alignment as A
from corpusloom.functions import repair as P
from corpusloom.functions import similarity as S
from corpusloom.functions import text as T
from corpusloom.operators import lexical as L
from corpusloom.operators import relational as R
from corpusloom.plans.views import PAIRS, documents, pairs, table
from corpusloom.session import shared_folder

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _md5(x, name):
    return F.md5(x.cast("binary")).alias(name)


def _said(spark, d):
    """Pairs of which some begin with a dash or a speaker's name, or have loose signs."""
    k = F.col("line_no") % 4
    x = F.when(k == 0, F.concat(F.lit(" – "), "br")).when(k == 1, F.concat(F.lit("Ana-Sá O'Neill : "), "br")).when(k == 2, F.concat("br", F.lit(", — sim . ( não )"))).otherwise(F.col("br"))
    return pairs(spark, d).select("line_no", x.alias("x"), "br", "pt")


_SAID = f"{PAIRS}, s AS (SELECT line_no, CASE line_no % 4 WHEN 0 THEN ' – ' || br WHEN 1 THEN 'Ana-Sá O''Neill : ' || br WHEN 2 THEN br || ', — sim . ( não )' ELSE br END AS x, br, pt FROM pairs)"


def dashes(spark, d):
    x = F.col("x")
    return _said(spark, d).select("line_no", T.starts_with_dash(x).alias("dashed"), _md5(T.strip_leading_dash(x), "without"), _md5(T.dash_after_punctuation(x), "plain"))


DASHES = rf"WITH {_SAID} SELECT line_no, regexp_matches(x, '^\s*[-–—]') AS dashed, md5(regexp_replace(x, '^\s*[-–—]\s*', '')) AS without, md5(regexp_replace(x, '([,.!?])\s*[-–—]\s*', '\1 ', 'g')) AS plain FROM s"


def speaker_labels(spark, d):
    return _said(spark, d).select("line_no", _md5(T.drop_speaker_labels(F.col("x")), "content"))


_NAME, _GAP = r"\p{L}(?:\p{L}|[.''\-])*", r"[\s\x{a0}\x{202f}]*"
_UNLABELLED = rf"regexp_replace(x, '(^|[^\p{{L}}\p{{N}}_]){_NAME}(?:\s+{_NAME}){{0,2}}{_GAP}[:：]{_GAP}', '\1', 'g')"
_TIDY = rf"regexp_replace(regexp_replace({_UNLABELLED}, '\s+([,.;:!?…)\]}}])', '\1', 'g'), '([(\[{{«“\"''])\s+', '\1', 'g')"
SPEAKER_LABELS = f"WITH {_SAID} SELECT line_no, md5({_SQUEEZE.format(_TIDY)}) AS content FROM s"


def joins(spark, d):
    """The capital, the last sign, and the join of two sides."""
    low = F.lower("br")
    return _said(spark, d).select("line_no", _md5(T.capitalize_first_letter(F.concat(F.lit("¿ 1 "), low)), "capital"), T.last_sign(F.concat("br", F.lit(' \'"'))).alias("last"), _md5(T.join_text(F.col("br"), F.concat(F.lit(" - "), "pt")), "joined"), T.has_inner_hard_stop(F.col("br")).alias("inner_stop"))


JOINS = rf"""WITH {_SAID} SELECT line_no, md5('¿ 1 ' || regexp_extract(lower(br), '^[^\p{{L}}]*') || upper(substr(regexp_replace(lower(br), '^[^\p{{L}}]*', ''), 1, 1)) || substr(regexp_replace(lower(br), '^[^\p{{L}}]*', ''), 2)) AS capital,
  right(regexp_replace(br, '[\s"'']+$', ''), 1) AS last, md5(CASE WHEN br = '' THEN regexp_replace(pt, '^\s+', '') WHEN regexp_replace(pt, '^\s+', '') = '' THEN br ELSE {_STRIP.format("regexp_replace(br, '" + chr(92) + "s+$', '') || ' ' || regexp_replace(pt, '^" + chr(92) + "s+', '')")} END) AS joined,
  regexp_matches(br, '[.?!…].+\S.*[.?!…]') AS inner_stop FROM s"""


def sentence_split(spark, d):
    """Sentences of documents that hold abbreviations and a section sign."""
    x = documents(spark, d).where("text IS NOT NULL").select("doc_id", F.concat(F.lit("O Sr. Sá e a Dra. Paz. Lei § 5 vale! "), F.regexp_replace("text", r"\s+", " ")).alias("x"))
    parts = T.sentences(F.col("x"))
    return x.select("doc_id", F.size(parts).cast("long").alias("sentences"), _md5(F.array_join(parts, "|"), "parts"))


_KNOWN = "|".join(a.replace(".", chr(92) + ".") for a in sorted(T.ABBREVIATIONS, key=len, reverse=True))
SENTENCE_SPLIT = rf"""WITH x AS (SELECT doc_id, 'O Sr. Sá e a Dra. Paz. Lei § 5 vale! ' || regexp_replace(text, '\s+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?i)(^|[^\p{{L}}\p{{N}}_])({_KNOWN})\.', '\1\2' || chr(1), 'g'), '([.?!…]) ', '\1' || chr(2), 'g') AS m FROM x),
p AS (SELECT doc_id, list_filter(list_transform(string_split(m, chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '') AS p FROM m)
SELECT doc_id, len(p) AS sentences, md5(array_to_string(p, '|')) AS parts FROM p"""


def web_repairs(spark, d):
    """Repairs of literature and web text, each on a text that needs it."""
    made = {
        "initials": T.remove_initial_labels(F.concat(F.lit("A. -- "), "br", F.lit("\nB.– x"))),
        "names": T.remove_word_labels(F.concat(F.lit("Ana.  -- "), "br")),
        "dialogue": T.remove_dialogue_dashes(F.concat(F.lit("-- "), "br", F.lit(". -- y"))),
        "bullet": T.remove_bullet(F.concat(F.lit("12) "), "br")),
        "mark": T.remove_corpus_mark(F.concat(F.lit("COD _ x1 "), "br")),
        "quotes": T.close_quote_gaps(F.concat(F.lit('" '), "br", F.lit(' "'))),
        "tags": T.remove_tags(F.concat(F.lit("<p class='x'>"), "br", F.lit("</p>"))),
    }
    return pairs(spark, d).select("line_no", *[_md5(x, n) for n, x in made.items()])


_L = "[A-Za-zÀ-ÖØ-öø-ÿ]"
WEB_REPAIRS = rf"""WITH {PAIRS} SELECT line_no, md5(regexp_replace('A. -- ' || br || chr(10) || 'B.– x', '(?m)(^|\s|[(\["“]){_L}\.\s*(?:--|[-–—]{{1,2}})\s*', '\1', 'g')) AS initials,
  md5(regexp_replace('Ana.  -- ' || br, '(?m)(^|\s){_L}+\.?\s+--\s*', '\1', 'g')) AS names, md5(regexp_replace('-- ' || br || '. -- y', '(?m)(^|[.!?:;…])\s*--\s*', '\1 ', 'g')) AS dialogue,
  md5({_STRIP.format("regexp_replace('12) ' || br, '^" + chr(92) + "d+." + chr(92) + "s', '')")}) AS bullet, md5({_STRIP.format('br')}) AS mark,
  md5(regexp_replace(regexp_replace('" ' || br || ' "', '^"\s', '"'), ' "$', '"')) AS quotes, md5(regexp_replace('<p class=''x''>' || br || '</p>', '<[^>]+>', '', 'g')) AS tags FROM pairs"""


def srt_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.select("event_id", T.srt_time(F.col("ms") % 360_000_000).alias("at"))


SRT_TIMES = "WITH x AS (SELECT event_id, (epoch_us(ts) // 1000) % 360000000 AS ms FROM events) SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at FROM x"


def unicode_repair(spark, d):
    """Texts that were read in a wrong encoding, mended again."""
    x = pairs(spark, d).where("br IS NOT NULL").select("line_no", F.concat(F.lit("Ã¡Ã§Ã£o: "), F.translate("br", T.ACCENTED, T.PLAIN)).alias("x"))
    return x.select("line_no", F.substring(P.column(P.mend_unicode, F.col("x")), 1, 6).alias("head"), F.length(P.column(P.to_ascii, F.col("x"))).cast("long").alias("chars"))


def highlights(spark, d):
    """Pairs with the runs of words that the other side has no link to in brackets."""
    return pairs(spark, d).select("line_no", A.highlighted_udf(F.col("br"), F.col("pt")).alias("br"), A.highlighted_udf(F.col("pt"), F.col("br")).alias("pt"))


def word_links(spark, d):
    """How many word types of a pair are linked, by a table learnt from all pairs."""
    p = pairs(spark, d).select("line_no", F.array_distinct(T.tokens(F.lower("br"))).alias("a"), F.array_distinct(T.tokens(F.lower("pt"))).alias("b"))
    folder, made = shared_folder(spark, "words"), itertools.count()

    def kept(df):
        gc.collect()  # what earlier steps shuffled goes once neither Python nor the JVM refers to it
        spark._jvm.System.gc()
        path = f"{folder}/{next(made)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    p = kept(p)
    links = L.mutual_links(p, "line_no", "a", "b", L.translation_table(p, "line_no", "a", "b", kept, rounds=2, least=0.1))
    return links.groupBy("line_no").agg(F.count("*").alias("links"))


def numbers_and_keys(spark, d):
    """Numbers in texts of all kinds, and the key of a pair."""
    k = F.col("line_no") % 4
    x = F.when(k == 0, F.concat(F.lit(" "), F.col("line_no").cast("string"), F.lit("\t"))).when(k == 1, "12.9").when(k == 2, "n/a")
    return pairs(spark, d).select("line_no", T.to_int(x, -1).alias("number"), _md5(T.pair_key(F.col("br"), F.col("pt")), "key"))


NUMBERS_AND_KEYS = f"WITH {PAIRS} SELECT line_no, CASE line_no % 4 WHEN 0 THEN line_no WHEN 1 THEN 12 ELSE -1 END AS number, md5(lower({_STRIP.format('br')}) || '||' || lower({_STRIP.format('pt')})) AS key FROM pairs"


def scored_new_rows(spark, d):
    """Rows that a table doesn't have yet, cleaned and scored, inserted once each."""
    p = pairs(spark, d).select("line_no", T.clean_text(F.col("br")).alias("br"), T.clean_text(F.col("pt")).alias("pt"))
    scored = lambda x: x.withColumn("score", F.round(S.as_udf(A.text_only_score)("br", "pt"), 6))
    old = scored(p.where("line_no % 2 = 0"))
    return R.insert_missing(old, scored(p.join(old.select("line_no"), "line_no", "left_anti")), "line_no").select("line_no", "score")


QUERIES = {
    "t23_numbers_and_keys": (numbers_and_keys, NUMBERS_AND_KEYS),
    "t31_word_links": (word_links, None),
    "r4_scored_new_rows": (scored_new_rows, None),
    "t3_dashes": (dashes, DASHES),
    "t4_speaker_labels": (speaker_labels, SPEAKER_LABELS),
    "t10_joins": (joins, JOINS),
    "t13_sentence_split": (sentence_split, SENTENCE_SPLIT),
    "t53_web_repairs": (web_repairs, WEB_REPAIRS),
    "t57_unicode_repair": (unicode_repair, None),
    "t68_srt_times": (srt_times, SRT_TIMES),
    "t39_highlights": (highlights, None),
}
