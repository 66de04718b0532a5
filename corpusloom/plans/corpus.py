"""Label repair, canonical rows, splits, leak guards, unified views, samples and exported examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as T
from corpusloom.operators import examples as X
from corpusloom.operators import relational as R
from corpusloom.plans.views import PAIRS, documents, pairs, table

DOMAINS = ("src0", "src1", "src2", "src3", "src4", "src5")
UNIFIED = ["dataset", "split", "source", "bucket", "theme", "domain", "label", "text_pt_br", "text_pt_pt", "ref_pt_pt_manual", "ref_pt_pt_deepl"]


def _labelled(spark, d):
    """Documents as if some labels were aliases and some texts stood in another column."""
    x = documents(spark, d)
    raw = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "lang")).otherwise(F.col("lang"))
    return x.select("doc_id", "source", raw.alias("raw_label"), F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("text")).alias("text_a"), F.col("text").alias("text_b"))


def label_repair(spark, d):
    x = _labelled(spark, d)
    label = X.repaired_label(F.col("raw_label"), {"en": "pt-BR", "es": "pt-PT"})
    text = X.first_filled(F.col("text_a"), F.col("text_b"))
    domain = F.when(F.lower(F.trim("source")).isin(*DOMAINS), F.lower(F.trim("source")))
    return x.select("doc_id", label.alias("label"), domain.alias("domain"), F.md5(F.coalesce(F.when(label == "pt-BR", text), F.lit("-")).cast("binary")).alias("br_md5"), F.md5(F.coalesce(F.when(label == "pt-PT", text), F.lit("-")).cast("binary")).alias("pt_md5"))


LABEL_REPAIR = f"""WITH x AS (SELECT doc_id, source, CASE lower(trim(lang)) WHEN 'en' THEN 'pt-BR' WHEN 'es' THEN 'pt-PT'
    ELSE CASE doc_id % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN ' ' || lang ELSE lang END END AS label, text FROM documents)
SELECT doc_id, label, CASE WHEN lower(trim(source)) IN {DOMAINS} THEN lower(trim(source)) END AS domain,
  md5(coalesce(CASE WHEN label = 'pt-BR' AND trim(text) <> '' THEN text END, '-')) AS br_md5, md5(coalesce(CASE WHEN label = 'pt-PT' AND trim(text) <> '' THEN text END, '-')) AS pt_md5 FROM x"""


def misplaced_repair(spark, d):
    """Texts of over 40 characters in the domain column go back to the text column; a label in the text column becomes the label."""
    x = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.col("source")).alias("domain"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.col("text")).alias("text"))
    lost = (F.length("domain") > 40) & ~F.lower("domain").startswith("src")
    return x.select("doc_id", F.when(lost, F.lit(None)).otherwise(F.col("domain")).alias("domain"), F.when(lost, F.col("text")).alias("label"), F.length(F.when(lost, F.col("domain")).otherwise(F.col("text"))).cast("long").alias("chars"))


MISPLACED_REPAIR = """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE source END AS domain, CASE WHEN doc_id % 5 = 0 THEN lang ELSE text END AS text FROM documents),
y AS (SELECT *, length(domain) > 40 AND NOT starts_with(lower(domain), 'src') AS lost FROM x)
SELECT doc_id, CASE WHEN NOT coalesce(lost, false) THEN domain END AS domain, CASE WHEN lost THEN text END AS label, length(CASE WHEN lost THEN domain ELSE text END) AS chars FROM y"""


def canonical_text(spark, d):
    """Of each language and source one row a text, case aside; the whole text is the key, by its hash."""
    x = documents(spark, d).where("text <> ''").select("doc_id", "lang", "source", "text")
    kept = R.keep_canonical(x, [F.col("lang"), F.col("source"), F.sha2(F.lower("text").cast("binary"), 256)], "text", "doc_id")
    return kept.select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars"))


CANONICAL_TEXT = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, lower(text) ORDER BY length(text) DESC, doc_id DESC) AS n FROM documents WHERE text <> '')
SELECT doc_id, lang, source, length(text) AS chars FROM r WHERE n = 1"""


def hash_split(spark, d):
    b = R.hash_bucket([F.lower("text"), F.col("lang")], 10_000)
    return documents(spark, d).where("text is not null and lang is not null").select("doc_id", b.alias("bucket"), R.split_name(b, 5, 105).alias("split"))


_BUCKET = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % {}"
HASH_SPLIT = f"""WITH x AS (SELECT doc_id, {_BUCKET.format("lower(text) || chr(31) || lang", 10000)} AS bucket FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, bucket, CASE WHEN bucket < 5 THEN 'test' WHEN bucket < 105 THEN 'valid' ELSE 'train' END AS split FROM x"""


def dev_split(spark, d):
    b = R.hash_bucket([F.lower(F.trim("br")), F.lower(F.trim("pt"))], 100)
    return pairs(spark, d).select("line_no", F.when(b == 0, "valid").otherwise("train").alias("split"))


DEV_SPLIT = f"WITH {PAIRS} SELECT line_no, CASE WHEN {_BUCKET.format('lower(trim(br)) || chr(31) || lower(trim(pt))', 100)} = 0 THEN 'valid' ELSE 'train' END AS split FROM pairs"


def ratio_split(spark, d):
    return R.ratio_split(documents(spark, d).select("doc_id", "lang"), "doc_id", 42).select("doc_id", "lang", "split")


RATIO_SPLIT = """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS n, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang, CASE WHEN n <= floor(total * 0.8) THEN 'train' WHEN n <= floor(total * 0.8) + floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split FROM r"""


def _guard(spark, d):
    b = table(spark, d, "benchmark").select(F.lower(F.trim("text")).alias("g"))
    own = documents(spark, d).where("doc_id % 50 = 7").select(F.lower(F.trim("text")).alias("g"))
    return b.unionByName(own).distinct()


def guard_set(spark, d):
    return _guard(spark, d).agg(F.count("*").alias("n"), F.sum(F.length("g")).cast("long").alias("chars"))


_GUARD = "g AS (SELECT DISTINCT lower(trim(text)) AS g FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 50 = 7))"
GUARD_SET = f"WITH {_GUARD} SELECT count(*) AS n, CAST(sum(length(g)) AS BIGINT) AS chars FROM g"


def guard_antijoin(spark, d):
    docs = documents(spark, d).select("doc_id", F.md5(F.lower(F.trim(F.coalesce("text", F.lit("")))).cast("binary")).alias("k"))
    guard = _guard(spark, d).select(F.md5(F.col("g").cast("binary")).alias("gk"))
    return R.without_guarded(docs, guard, [(F.col("k"), F.col("gk"))]).select("doc_id")


GUARD_ANTIJOIN = f"WITH {_GUARD} SELECT doc_id FROM documents WHERE lower(trim(coalesce(text, ''))) NOT IN (SELECT g FROM g WHERE g IS NOT NULL)"


def contains_guard(spark, d):
    """Documents that contain a guarded text, whole and in lower case: benchmark items, and short beginnings of theirs.

    A text of three words or more has its inner words whole in the document that contains it, so it is looked up by a hash of the first three of
    them, or of the one or two there are; a shorter one by its first three characters, or all of fewer.  What shares a key is searched for.
    """
    bench = table(spark, d, "benchmark").select("item_id", F.lower(F.trim("text")).alias("needle"))
    short = bench.where("item_id % 7 = 0").select("item_id", F.array_join(F.slice(F.split("needle", " "), 1, (F.col("item_id") % 4 + 1).cast("int")), " ").alias("needle"))
    guard = R.contained_texts(documents(spark, d).select("doc_id", F.lower("text").alias("t")), "doc_id", "t", bench.unionByName(short).where("needle <> ''").distinct(), "needle")
    return guard.groupBy("doc_id").agg(F.count("*").alias("items"))


CONTAINS_GUARD = """WITH b AS (SELECT item_id, lower(trim(text)) AS needle FROM benchmark),
g AS (SELECT DISTINCT * FROM (SELECT * FROM b UNION ALL SELECT item_id, array_to_string(list_slice(string_split(needle, ' '), 1, item_id % 4 + 1), ' ') FROM b WHERE item_id % 7 = 0) WHERE needle <> '')
SELECT doc_id, count(*) AS items FROM documents d JOIN g ON contains(lower(d.text), needle) GROUP BY doc_id"""


def train_view(spark, d):
    p = pairs(spark, d).select(F.col("br").alias("text_pt_br"), F.col("pt").alias("TEXT_PT_PT"), F.when(F.col("line_no") % 20 == 0, "valid").otherwise("train").alias("split"))
    a = R.canonical_columns(p, UNIFIED, dataset="OpenSubs", source="conversations")
    docs = documents(spark, d).select(F.col("source").alias("domain"), F.col("lang").alias("label"), F.when(F.col("lang") == "en", F.col("text")).alias("text_pt_br"), F.when(F.col("lang") == "es", F.col("text")).alias("text_pt_pt")).where("label in ('en', 'es')")
    b = R.canonical_columns(docs, UNIFIED, dataset="PtBrVId", split="train")
    both = a.unionByName(b)
    return both.groupBy("dataset", "split", "label").agg(F.count("*").alias("n"), F.count("text_pt_br").alias("br"), F.count("text_pt_pt").alias("pt"), F.count("theme").alias("themes"))


TRAIN_VIEW = f"""WITH {PAIRS}, u AS (
  SELECT 'OpenSubs' AS dataset, CASE WHEN line_no % 20 = 0 THEN 'valid' ELSE 'train' END AS split, NULL AS label, br AS text_pt_br, pt AS text_pt_pt FROM pairs
  UNION ALL SELECT 'PtBrVId', 'train', lang, CASE WHEN lang = 'en' THEN text END, CASE WHEN lang = 'es' THEN text END FROM documents WHERE lang IN ('en', 'es'))
SELECT dataset, split, label, count(*) AS n, count(text_pt_br) AS br, count(text_pt_pt) AS pt, 0 AS themes FROM u GROUP BY dataset, split, label"""


def test_view(spark, d):
    b = table(spark, d, "benchmark").select(F.col("text").alias("text_pt_br"), (F.col("item_id") % 5).cast("string").alias("bucket"))
    g = R.canonical_columns(b, UNIFIED, dataset="Gold", split="test").withColumn("bucket", F.coalesce(F.when(F.col("bucket") == "0", F.lit(None)).otherwise(F.col("bucket")), F.lit("UNKNOWN")))
    return g.groupBy("dataset", "split", "bucket").agg(F.count("*").alias("n"), F.count("label").alias("labels"))


TEST_VIEW = "SELECT 'Gold' AS dataset, 'test' AS split, CASE WHEN item_id % 5 = 0 THEN 'UNKNOWN' ELSE CAST(item_id % 5 AS VARCHAR) END AS bucket, count(*) AS n, 0 AS labels FROM benchmark GROUP BY 3"


def stratified_sample(spark, d):
    return R.stratified_sample(documents(spark, d).select("doc_id", "lang", "source"), ["source", "lang"], "doc_id", 7, 2)


STRATIFIED_SAMPLE = "WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source, lang ORDER BY md5('7:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang, source FROM r WHERE n <= 2"


def seeded_sample(spark, d):
    order = F.md5(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary"))
    return documents(spark, d).orderBy(order, "doc_id").limit(25).select("doc_id", "lang")


SEEDED_SAMPLE = "SELECT doc_id, lang FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 25"


def most_changed(spark, d):
    from corpusloom.functions.similarity import positional_difference

    p = pairs(spark, d).where("trim(br) <> '' and trim(pt) <> ''").select("line_no", positional_difference(T.squeeze("br"), T.squeeze("pt")).cast("long").alias("difference"))
    return p.orderBy(F.col("difference").desc(), "line_no").limit(20)


MOST_CHANGED = rf"""WITH {PAIRS}, x AS (SELECT line_no, string_split(regexp_replace(regexp_replace(br, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ') AS a, string_split(regexp_replace(regexp_replace(pt, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), ' ') AS b FROM pairs WHERE trim(br) <> '' AND trim(pt) <> '')
SELECT line_no, abs(len(a) - len(b)) + len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[k] <> b[k])) AS difference FROM x ORDER BY difference DESC, line_no LIMIT 20"""


def translation_examples(spark, d):
    return X.translation_examples(pairs(spark, d), "line_no", "br", "pt")


TRANSLATION = f"""WITH {PAIRS}, p AS (SELECT * FROM pairs WHERE trim(coalesce(br, '')) <> '' AND trim(coalesce(pt, '')) <> '')
SELECT line_no AS source_id, 'br-pt' AS direction, '<br-pt> ' || br AS input_text, pt AS target_text FROM p UNION ALL SELECT line_no, 'pt-br', '<pt-br> ' || pt, br FROM p"""


def classification_examples(spark, d):
    p = pairs(spark, d).withColumn("label", F.when(F.col("line_no") % 9 == 0, "pt-BR")).withColumn("pt", F.when(F.col("line_no") % 4 == 0, F.concat(F.lit(" "), "br")).when(F.col("line_no") % 4 == 1, F.lit("")).otherwise(F.col("pt")))
    return X.classification_examples(p, "line_no", "br", "pt", "label")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SQUEEZE = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
CLASSIFICATION = f"""WITH {PAIRS}, p AS (SELECT line_no, CASE WHEN line_no % 9 = 0 THEN 'pt-BR' END AS label, br, CASE line_no % 4 WHEN 0 THEN ' ' || br WHEN 1 THEN '' ELSE pt END AS pt FROM pairs),
f AS (SELECT *, {_SQUEEZE.format("coalesce(br, '')")} <> '' AS has_a, {_SQUEEZE.format("coalesce(pt, '')")} <> '' AS has_b, {_SQUEEZE.format("coalesce(br, '')")} = {_SQUEEZE.format("coalesce(pt, '')")} AS same FROM p),
u AS (
  SELECT line_no, CASE WHEN has_a THEN br ELSE pt END AS text, label FROM f WHERE label IS NOT NULL AND (has_a OR has_b)
  UNION ALL SELECT line_no, br, 'equal' FROM f WHERE label IS NULL AND has_a AND has_b AND same
  UNION ALL SELECT line_no, br, 'pt-BR' FROM f WHERE label IS NULL AND has_a AND NOT (has_b AND same)
  UNION ALL SELECT line_no, pt, 'pt-PT' FROM f WHERE label IS NULL AND has_b AND NOT (has_a AND same))
SELECT line_no AS source_id, '<id> ' || text AS input_text, label, CASE label WHEN 'pt-BR' THEN 0 WHEN 'pt-PT' THEN 1 ELSE 2 END AS label_id FROM u"""


def chat_examples(spark, d):
    return X.chat_examples(pairs(spark, d), "line_no", "br", "pt", seed=42)


CHAT = f"""WITH {PAIRS}, p AS (SELECT *, {_BUCKET.format("'42:' || line_no", 10000)} < 7000 AS back FROM pairs WHERE trim(coalesce(br, '')) <> '' AND trim(coalesce(pt, '')) <> '')
SELECT line_no AS source_id, CASE WHEN back THEN 'pt-br' ELSE 'br-pt' END AS direction, CASE WHEN back THEN pt ELSE br END AS user_text, CASE WHEN back THEN br ELSE pt END AS assistant_text FROM p"""


def multitask_examples(spark, d):
    return X.multitask(X.translation_examples(pairs(spark, d), "line_no", "br", "pt"))


MULTITASK = f"""WITH {PAIRS}, p AS (SELECT * FROM pairs WHERE trim(coalesce(br, '')) <> '' AND trim(coalesce(pt, '')) <> '')
SELECT line_no AS source_id, br AS encoder_text, '<BR2PT> ' || pt AS decoder_text, true AS valid FROM p UNION ALL SELECT line_no, pt, '<PT2BR> ' || br, true FROM p"""


def parallel_export(spark, d):
    """One line a pair for each side and its place in the export, from 0, in order of line; places come from ranges of lines."""
    return X.parallel_lines(pairs(spark, d), "line_no", "br", "pt")


_LINE = r"regexp_replace(regexp_replace(coalesce({}, ''), '[\r\n\t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
PARALLEL_EXPORT = f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY line_no) - 1 AS idx, line_no, {_LINE.format('br')} AS br_line, {_LINE.format('pt')} AS pt_line FROM pairs"

def _unified(spark, d):
    p = pairs(spark, d)
    tag = F.when(F.col("line_no") % 4 == 0, "PtBrVId").when(F.col("line_no") % 4 == 1, "Gold").when(F.col("line_no") % 4 == 2, "OpenSubs").otherwise("FRMT")
    return p.select("line_no", tag.alias("dataset"), F.when(F.col("line_no") % 3 == 0, " ").otherwise(F.lit("b")).alias("bucket"), F.when(F.col("line_no") % 8 == 0, "pt-PT").when(F.col("line_no") % 8 == 4, "x").alias("label"), F.when(F.col("line_no") % 5 != 0, F.col("br")).alias("text_pt_br"), F.col("pt").alias("text_pt_pt"), F.col("pt").alias("ref_pt_pt_manual"), F.when(F.col("line_no") % 2 == 1, "").otherwise(F.col("br")).alias("ref_pt_pt_deepl"))


def evaluation_examples(spark, d):
    x = X.evaluation_examples(_unified(spark, d), "line_no")
    return x.select("line_no", "dataset", "bucket", "task", F.length("source").cast("long").alias("source_chars"), F.length("target").cast("long").alias("target_chars"), "ref_kind")


EVALUATION_EXAMPLES = f"""WITH {PAIRS}, u AS (SELECT line_no, CASE line_no % 4 WHEN 0 THEN 'PtBrVId' WHEN 1 THEN 'Gold' WHEN 2 THEN 'OpenSubs' ELSE 'FRMT' END AS dataset, CASE WHEN line_no % 3 = 0 THEN 'UNKNOWN' ELSE 'b' END AS bucket,
  CASE line_no % 8 WHEN 0 THEN 'pt-PT' WHEN 4 THEN 'x' END AS label, CASE WHEN line_no % 5 <> 0 THEN br END AS br, pt, br AS br0 FROM pairs),
e AS (
  SELECT line_no, dataset, bucket, 'translate_br2pt' AS task, br AS s, pt AS t, NULL AS ref_kind FROM u WHERE dataset IN ('OpenSubs', 'FRMT') AND length(br) > 0 AND length(pt) > 0
  UNION ALL SELECT line_no, dataset, bucket, 'translate_pt2br', pt, br, NULL FROM u WHERE dataset IN ('OpenSubs', 'FRMT') AND length(br) > 0 AND length(pt) > 0
  UNION ALL SELECT line_no, dataset, bucket, 'classify', br, 'pt-BR', NULL FROM u WHERE dataset IN ('OpenSubs', 'FRMT') AND length(br) > 0
  UNION ALL SELECT line_no, dataset, bucket, 'classify', pt, 'pt-PT', NULL FROM u WHERE dataset IN ('OpenSubs', 'FRMT') AND length(pt) > 0
  UNION ALL SELECT line_no, dataset, bucket, 'classify', CASE WHEN length(br) > 0 THEN br ELSE pt END, label, NULL FROM u WHERE dataset = 'PtBrVId' AND label IN ('pt-BR', 'pt-PT') AND (length(br) > 0 OR length(pt) > 0)
  UNION ALL SELECT line_no, dataset, bucket, 'translate_br2pt', br, pt, 'manual' FROM u WHERE dataset = 'Gold' AND length(br) > 0 AND length(pt) > 0
  UNION ALL SELECT line_no, dataset, bucket, 'translate_br2pt', br, br0, 'deepl' FROM u WHERE dataset = 'Gold' AND length(br) > 0 AND line_no % 2 <> 1 AND length(br0) > 0)
SELECT line_no, dataset, bucket, task, length(s) AS source_chars, length(t) AS target_chars, ref_kind FROM e"""


def dataset_chat(spark, d):
    return X.dataset_chat_examples(_unified(spark, d), "line_no", seed=42)


DATASET_CHAT = f"""WITH {PAIRS}, u AS (SELECT line_no, CASE line_no % 4 WHEN 0 THEN 'PtBrVId' WHEN 1 THEN 'Gold' WHEN 2 THEN 'OpenSubs' ELSE 'FRMT' END AS dataset,
  CASE line_no % 8 WHEN 0 THEN 'pt-PT' WHEN 4 THEN 'x' END AS label, CASE WHEN line_no % 5 <> 0 THEN nullif({_STRIP.format('br')}, '') END AS br, nullif({_STRIP.format('pt')}, '') AS pt,
  {_BUCKET.format("'42:' || line_no", 10000)} < 7000 AS back FROM pairs)
SELECT line_no AS source_id, dataset, CASE WHEN back THEN 'translate_pt2br' ELSE 'translate_br2pt' END AS task, CASE WHEN back THEN pt ELSE br END AS source, CASE WHEN back THEN br ELSE pt END AS target
  FROM u WHERE dataset <> 'PtBrVId' AND br IS NOT NULL AND pt IS NOT NULL
UNION ALL SELECT line_no, dataset, 'classify', br, 'pt-BR' FROM u WHERE dataset <> 'PtBrVId' AND br IS NOT NULL AND (dataset <> 'OpenSubs' OR pt IS NOT NULL)
UNION ALL SELECT line_no, dataset, 'classify', pt, 'pt-PT' FROM u WHERE dataset <> 'PtBrVId' AND pt IS NOT NULL AND (dataset <> 'OpenSubs' OR br IS NOT NULL)
UNION ALL SELECT line_no, dataset, 'classify', coalesce(br, pt), label FROM u WHERE dataset = 'PtBrVId' AND label IN ('pt-BR', 'pt-PT') AND coalesce(br, pt) IS NOT NULL"""


def _task_files(spark, d):
    """The two task files as if a pair were a row of each: some fields empty, directions in a field or a prefix, labels in any spelling."""
    p, k = pairs(spark, d), F.pmod(F.col("pair_id"), F.lit(4))
    own = F.when(F.col("pair_id") % 3 != 0, F.col("br"))
    t = p.select("line_no", own.alias("source_text"), F.concat(F.lit("<br-pt> "), "br").alias("input_text"), F.col("pt").alias("target_text"), F.when(k == 0, "br2pt").when(k == 1, " PT2BR ").when(k == 2, "xx").alias("direction"))
    c = p.select("line_no", own.alias("text"), F.concat(F.lit("<id> "), "br").alias("input_text"), F.when(k == 0, "pt-BR").when(k == 1, " PT-PT ").when(k == 2, "equal").alias("label"))
    return X.task_verdicts(t, c, "line_no")


def task_chat(spark, d):
    return X.task_examples(_task_files(spark, d))


def task_counts(spark, d):
    return X.task_counts(_task_files(spark, d))


_TASK_FILES = f"""{PAIRS}, u AS (SELECT line_no, pair_id % 4 AS k, nullif({_STRIP.format('br')}, '') AS br, nullif({_STRIP.format('pt')}, '') AS pt FROM pairs),
v AS (SELECT line_no, CASE k WHEN 1 THEN 'translate_pt2br' WHEN 2 THEN NULL ELSE 'translate_br2pt' END AS task, br AS source, pt AS target, CASE WHEN k <> 2 AND br IS NOT NULL AND pt IS NOT NULL THEN 'example' ELSE 'skipped' END AS verdict FROM u
  UNION ALL SELECT line_no, 'classify', br, CASE k WHEN 0 THEN 'pt-BR' WHEN 1 THEN 'pt-PT' END, CASE WHEN br IS NULL THEN 'skipped' WHEN k > 1 THEN 'skipped_equal' ELSE 'example' END FROM u)"""
TASK_CHAT = f"WITH {_TASK_FILES} SELECT line_no AS source_id, 'GPT' AS dataset, task, source, target FROM v WHERE verdict = 'example'"
TASK_COUNTS = f"""WITH {_TASK_FILES}, e AS (SELECT * FROM v WHERE verdict = 'example')
SELECT (SELECT count(*) FROM v) AS rows, count(*) AS examples, count(*) FILTER (WHERE task = 'translate_br2pt') AS translate_br2pt, count(*) FILTER (WHERE task = 'translate_pt2br') AS translate_pt2br,
  count(*) FILTER (WHERE task = 'classify') AS classify, (SELECT count(*) FROM v WHERE verdict = 'skipped_equal') AS skipped_equal FROM e"""


def _task_rows(spark, d):
    p = pairs(spark, d)
    task = F.when(F.col("line_no") % 4 == 0, " translate_br2pt ").when(F.col("line_no") % 4 == 1, "")
    given = F.when(F.col("line_no") % 4 == 2, F.concat(F.lit("<pt-br> "), "pt")).otherwise(F.col("br"))
    target = F.when(F.col("line_no") % 4 == 1, F.concat(F.lit("<PT2BR> "), "pt")).when(F.col("line_no") % 8 == 3, "<CLS> equal").when(F.col("line_no") % 8 == 7, "<CLS> no").otherwise(F.col("pt"))
    return p.select("line_no", task.alias("task"), given.alias("given"), target.alias("target"))


def task_resolution(spark, d):
    x = _task_rows(spark, d).select("line_no", X.resolved_task(F.col("task"), F.col("given"), F.col("target")).alias("r"))
    return x.select("line_no", "r.token", F.length("r.input").cast("long").alias("input_chars"), F.length("r.gold").cast("long").alias("gold_chars"))


TASK_RESOLUTION = f"""WITH {PAIRS} SELECT line_no, CASE line_no % 4 WHEN 0 THEN '<BR2PT>' WHEN 1 THEN '<PT2BR>' WHEN 2 THEN '<PT2BR>' END AS token,
  CASE WHEN line_no % 4 IN (0, 1) THEN length(trim(br)) WHEN line_no % 4 = 2 THEN length(regexp_replace(trim('<pt-br> ' || pt), '^<pt-br>\\s*', '')) END AS input_chars,
  CASE WHEN line_no % 4 = 1 THEN length(regexp_replace(trim('<PT2BR> ' || pt), '^<PT2BR>\\s*', '')) WHEN line_no % 4 IN (0, 2) THEN length(trim(pt)) END AS gold_chars FROM pairs"""


def format_counters(spark, d):
    return _task_rows(spark, d).groupBy(X.target_format(F.col("target")).alias("format")).agg(F.count("*").alias("n"))


FORMAT_COUNTERS = f"WITH {PAIRS} SELECT CASE WHEN line_no % 4 = 1 THEN 'translation' WHEN line_no % 8 = 3 THEN 'classification' ELSE 'bad' END AS format, count(*) AS n FROM pairs GROUP BY 1"


def label_rules(spark, d):
    """Every label rule over a list of spellings, crossed with nothing: spellings are made from the documents' own fields."""
    spelling = F.element_at(F.array(*[F.lit(s) for s in LABEL_SPELLINGS]), (F.col("doc_id") % len(LABEL_SPELLINGS) + 1).cast("int"))
    x = documents(spark, d).select(spelling.alias("raw"))
    rules = {"ingest": L.at_ingest, "filtered": L.at_filter, "exported": L.at_export, "pair_model": L.answer_of_pair_model, "multitask": L.answer_of_multitask_model, "chat": L.answer_of_chat_model}
    return x.groupBy("raw").agg(F.count("*").alias("n")).select("raw", "n", *[f(F.col("raw")).alias(n) for n, f in rules.items()])


LABEL_SPELLINGS = ("1", "0", "pt_BR", " PT-pt ", "Brasil", "Portugal", "equal", "shared", "br", "european", "Português Europeu", "pt-PT ou pt-BR", "x")
_RULES = {
    "1": ("pt-BR", "pt-BR", None, None, "unknown", None),
    "0": ("pt-PT", "pt-PT", None, None, "unknown", None),
    "pt_BR": ("pt-BR", "pt-BR", "pt-br", None, "unknown", None),
    " PT-pt ": ("pt-PT", "pt-PT", "pt-pt", "pt-pt", "pt-pt", "pt-PT"),
    "Brasil": ("brasil", "pt-PT", None, "pt-br", "unknown", "pt-BR"),
    "Portugal": ("portugal", "pt-PT", "pt-pt", "pt-pt", "unknown", "pt-PT"),
    "equal": ("equal", "pt-PT", "equal", "equal", "equal", None),
    "shared": ("shared", "pt-PT", "equal", "equal", "unknown", None),
    "br": ("br", "pt-BR", None, None, "unknown", None),
    "european": ("european", "pt-PT", None, None, "unknown", None),
    "Português Europeu": ("português europeu", "pt-PT", "pt-pt", "pt-pt", "unknown", "pt-PT"),
    "pt-PT ou pt-BR": ("pt-pt ou pt-br", "pt-PT", None, "pt-br", "pt-br", "pt-BR"),
    "x": ("x", "pt-PT", None, None, "unknown", None),
}
LABEL_RULES = (
    "WITH s(i, raw, ingest, filtered, exported, pair_model, multitask, chat) AS (VALUES "
    + ", ".join(f"({i}, '{raw}', " + ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" for v in _RULES[raw]) + ")" for i, raw in enumerate(LABEL_SPELLINGS))
    + f") SELECT raw, count(*) AS n, ingest, filtered, exported, pair_model, multitask, chat FROM documents JOIN s ON doc_id % {len(LABEL_SPELLINGS)} = i GROUP BY ALL"
)

QUERIES = {
    "f9_label_rules": (label_rules, LABEL_RULES),
    "x6_evaluation_examples": (evaluation_examples, EVALUATION_EXAMPLES),
    "x9_task_resolution": (task_resolution, TASK_RESOLUTION),
    "x10_format_counters": (format_counters, FORMAT_COUNTERS),
    "a8_canonical_text": (canonical_text, CANONICAL_TEXT),
    "f2_label_repair": (label_repair, LABEL_REPAIR),
    "f6_misplaced_repair": (misplaced_repair, MISPLACED_REPAIR),
    "u6_hash_split": (hash_split, HASH_SPLIT),
    "u7_dev_split": (dev_split, DEV_SPLIT),
    "o9_ratio_split": (ratio_split, RATIO_SPLIT),
    "u2_test_guard": (guard_set, GUARD_SET),
    "j6_guard_antijoin": (guard_antijoin, GUARD_ANTIJOIN),
    "j6b_contains_guard": (contains_guard, CONTAINS_GUARD),
    "u1_train_view": (train_view, TRAIN_VIEW),
    "u1_test_view": (test_view, TEST_VIEW),
    "w4_stratified_sample": (stratified_sample, STRATIFIED_SAMPLE),
    "o7_seeded_sample": (seeded_sample, SEEDED_SAMPLE),
    "o11_most_changed": (most_changed, MOST_CHANGED),
    "x1_translation": (translation_examples, TRANSLATION),
    "x2_classification": (classification_examples, CLASSIFICATION),
    "x5_chat": (chat_examples, CHAT),
    "x5_dataset_chat": (dataset_chat, DATASET_CHAT),
    "x7_task_chat": (task_chat, TASK_CHAT),
    "x7_task_counts": (task_counts, TASK_COUNTS),
    "x8_multitask": (multitask_examples, MULTITASK),
    "k8_parallel_export": (parallel_export, PARALLEL_EXPORT),
}
