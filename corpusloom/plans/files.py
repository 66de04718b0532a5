"""Sources and sinks: tables written in each format to the shared folder and read back, sources by name, ranges and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import relational as R
from corpusloom.plans.views import PAIRS, documents, pairs, table
from corpusloom.session import shared_folder
from corpusloom.sources import readers, writers

_LINE = r"regexp_replace(regexp_replace(coalesce({}, ''), '[\r\n\t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def keyed_range(spark, d):
    """A key range as a scan with a filter that reaches the file."""
    return readers.keyed_range(table(spark, d, "orders"), "o_orderkey", 100, 1000).select("o_orderkey", "o_custkey")


KEYED_RANGE = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 1000"


def zipped_lines(spark, d):
    """Both sides of all pairs as files of lines, read again line by line beside each other."""
    folder = shared_folder(spark, "lines")
    writers.parallel_files(pairs(spark, d), "line_no", "br", "pt", folder)
    return readers.zipped_lines(spark, f"{folder}/br", f"{folder}/pt").select("line_no", F.md5(F.col("br").cast("binary")).alias("br_md5"), F.md5(F.col("pt").cast("binary")).alias("pt_md5"))


ZIPPED_LINES = f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY line_no) AS line_no, md5({_LINE.format('br')}) AS br_md5, md5({_LINE.format('pt')}) AS pt_md5 FROM pairs"


def line_count(spark, d):
    folder = shared_folder(spark, "lines")
    writers.parallel_files(pairs(spark, d), "line_no", "br", "pt", folder)
    return spark.range(1).select(F.lit(readers.line_count(spark, f"{folder}/br")).cast("long").alias("lines"))


LINE_COUNT = f"WITH {PAIRS} SELECT count(*) AS lines FROM pairs"


def subtitles(spark, d):
    """Events as subtitle files, one for each type, read as blocks."""
    folder = f"{shared_folder(spark, 'subtitles')}/events"
    e = table(spark, d, "events").select("event_type", "event_id", (F.unix_millis(F.col("ts").cast("timestamp")) % 86_400_000).alias("ms"))
    block = F.concat_ws("\n", F.col("event_id").cast("string"), F.concat(T.srt_time(F.col("ms")), F.lit(" --> "), T.srt_time(F.col("ms") + 1500)), F.concat(F.lit("<i>"), "event_type"), F.concat(F.col("event_id").cast("string"), F.lit("</i> ")), F.lit(""))
    e.withColumn("value", block).repartition("event_type").select("event_type", "value").write.partitionBy("event_type").text(folder)
    return readers.subtitles(spark, f"{folder}/event_type=*/*.txt").select("start_ms", "end_ms", "text")


SUBTITLES = "SELECT (epoch_us(ts) // 1000) % 86400000 AS start_ms, (epoch_us(ts) // 1000) % 86400000 + 1500 AS end_ms, '<i>' || event_type || ' ' || event_id || '</i>' AS text FROM events"


def csv_columns(spark, d):
    """Three columns of documents, texts with line ends and quotes among them, through CSV."""
    path = f"{shared_folder(spark, 'csv')}/documents"
    documents(spark, d).where("text <> ''").select("doc_id", "lang", "text", "source").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    x = readers.csv(spark, path, ["doc_id", "text", "lang"])
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.regexp_replace("text", "\r", "\n").cast("binary")).alias("text_md5"), "lang")


CSV_COLUMNS = "SELECT doc_id, md5(replace(text, chr(13), chr(10))) AS text_md5, lang FROM documents WHERE text <> ''"


def json_lines(spark, d):
    """Documents through JSON lines, nulls kept."""
    path = f"{shared_folder(spark, 'json')}/documents"
    writers.json_lines(documents(spark, d).select("doc_id", "text", "lang"), path)
    x = readers.json_lines(spark, path, "doc_id long, text string, lang string")
    return x.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


JSON_LINES = "SELECT doc_id, md5(text) AS text_md5, lang FROM documents"


def versioned_table(spark, d):
    """A table replaced, upserted and inserted into, old versions deleted."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    v = writers.VersionedTable(spark, "versions_of_customer", shared_folder(spark, "versions"))
    v.replace(c.where("c_custkey % 2 = 0"))
    v.upsert(c.where("c_custkey % 4 = 0").withColumn("c_name", F.lit("new")), "c_custkey")
    out = v.insert(c, "c_custkey")
    v.vacuum()
    return out


VERSIONED_TABLE = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer"


def partitions(spark, d):
    """Orders by status; the writer that comes second replaces the one partition that it has rows of."""
    path = f"{shared_folder(spark, 'partitions')}/orders"
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    writers.replace_partitions(o, path, "o_orderstatus")
    writers.replace_partitions(o.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), path, "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")


PARTITIONS = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0"


def resumed_csv(spark, d):
    """Customers appended to a CSV folder in two runs; ids go on."""
    path = f"{shared_folder(spark, 'csv')}/customer"
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    writers.resume_csv(c.where("c_custkey % 3 <> 0"), path, "c_custkey")
    writers.resume_csv(c.where("c_custkey % 3 = 0"), path, "c_custkey")
    x = readers.csv(spark, path, ["id", "c_custkey", "c_mktsegment"])
    return x.select(F.col("id").cast("long").alias("id"), F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment")


RESUMED_CSV = "SELECT row_number() OVER (ORDER BY c_custkey % 3 = 0, c_custkey) AS id, c_custkey, c_mktsegment FROM customer"


def shuffled_csv(spark, d):
    """Customers in a seeded order, numbered from 1001."""
    path = f"{shared_folder(spark, 'csv')}/customer"
    return writers.csv_rows(table(spark, d, "customer").select("c_custkey"), path, "c_custkey", seed=5, after=1000)


SHUFFLED_CSV = "SELECT 1000 + row_number() OVER (ORDER BY substr(md5('5:' || c_custkey), 1, 15)) AS id, c_custkey FROM customer"


def relation_summary(spark, d):
    """Rows and columns of those relations that are there."""
    for name in ("region", "nation", "documents"):
        table(spark, d, name).createOrReplaceTempView(f"there_{name}")
    return readers.relation_summary(spark, ["there_region", "missing_table", "there_nation", "there_documents"])


RELATION_SUMMARY = "SELECT 'there_region' AS name, 2 AS columns, count(*) AS rows FROM region UNION ALL SELECT 'there_nation', 3, count(*) FROM nation UNION ALL SELECT 'there_documents', 5, count(*) FROM documents"


def first_table(spark, d):
    """The first of several names that is there with the columns."""
    table(spark, d, "nation").createOrReplaceTempView("there_nation")
    table(spark, d, "region").createOrReplaceTempView("there_region")
    return readers.first_table(spark, ["missing_table", "there_region", "there_nation"], {"n_name": "string"})


FIRST_TABLE = "SELECT n_name FROM nation"


def found_examples(spark, d):
    """Pairs in the answers of a model: fenced JSON, one list in another object, or bare keys in prose."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey") % 3
    pt_first = F.format_string('"pt_PT": "%s", "pt_BR": "%s"', "c_name", "c_mktsegment")
    br_first = F.format_string('"pt_BR": "%s", "pt_PT": "%s"', "c_mktsegment", "c_name")
    answer = F.when(k == 0, F.concat(F.lit('```json\n{"exemplos": [{'), pt_first, F.lit("}]}\n```"))).when(k == 1, F.concat(F.lit('{"outer": {"examples": [{'), br_first, F.lit('}, {"pt_PT": ""}]}}'))).otherwise(F.concat(F.lit("as asked: "), br_first, F.lit(" and no more")))
    return readers.examples(c.select("c_custkey", answer.alias("answer")), "answer").select("c_custkey", "place", "pt_PT", "pt_BR")


FOUND_EXAMPLES = "SELECT c_custkey, 0 AS place, c_name AS pt_PT, c_mktsegment AS pt_BR FROM customer"


def domain_splits(spark, d):
    """Documents exported by source and language, two splits of them read again without blank texts."""
    folder = f"{shared_folder(spark, 'domains')}/documents"
    x = documents(spark, d).select("doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")).alias("text"), F.col("source").alias("domain"), F.col("lang").alias("split"))
    x.write.partitionBy("domain", "split").parquet(folder)
    return readers.domain_splits(spark, folder, "text", splits=["en", "fr"]).select("doc_id", "domain", "split")


DOMAIN_SPLITS = "SELECT doc_id, source AS domain, lang AS split FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 7 <> 0 AND trim(text) <> ''"


def attached(spark, d):
    """A join of tables of an attached folder by their names."""
    readers.attach(spark, d, "src")
    return spark.sql("SELECT r_name, count(*) AS nations FROM src_nation JOIN src_region ON n_regionkey = r_regionkey GROUP BY r_name")


ATTACHED = "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def third_page(spark, d):
    """The third page of 25 customers, each page beginning behind the one before."""
    c, last = table(spark, d, "customer").select("c_custkey", "c_name"), None
    for _ in range(2):
        last = readers.page(c, "c_custkey", 25, last).agg(F.max("c_custkey")).first()[0]
    return readers.page(c, "c_custkey", 25, last)


THIRD_PAGE = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50"


def columns_of(spark, d):
    for name in ("region", "nation"):
        table(spark, d, name).createOrReplaceTempView(f"there_{name}")
    return readers.columns_of(spark, ["there_region", "missing_table", "there_nation"])


COLUMNS_OF = """SELECT * FROM (VALUES ('there_region', 0, 'r_regionkey', 'int'), ('there_region', 1, 'r_name', 'string'),
  ('there_nation', 0, 'n_nationkey', 'int'), ('there_nation', 1, 'n_name', 'string'), ('there_nation', 2, 'n_regionkey', 'int')) t(name, place, "column", type)"""


def resumed_pages(spark, d):
    """A catalogue of customers by page of 50, of which two pages are there, goes on behind them with what it doesn't have."""
    c = table(spark, d, "customer").select("c_custkey", F.expr("CAST((c_custkey - 1) DIV 50 + 1 AS INT)").alias("page"))
    number, new = readers.unseen_from(c.where("page <= 2"), "page", "c_custkey", c.where("c_custkey > 90"))
    return new.select("c_custkey", (F.col("page") >= number).alias("on_a_new_page"))


RESUMED_PAGES = "SELECT c_custkey, true AS on_a_new_page FROM customer WHERE c_custkey > 100"


def contiguous_ranges(spark, d):
    """Documents by the seven contiguous ranges that their ids are cut into."""
    x = documents(spark, d).select("doc_id")
    low, high = x.agg(F.min("doc_id"), F.max("doc_id")).first()
    ranges = R.contiguous_ranges(low, high, 7)
    of = F.coalesce(*[F.when(F.col("doc_id").between(a, b), F.lit(k)) for k, (a, b) in enumerate(ranges)])
    return x.groupBy(of.alias("part")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))


CONTIGUOUS_RANGES = """WITH b AS (SELECT min(doc_id) AS low, max(doc_id) - min(doc_id) + 1 AS size FROM documents),
r AS (SELECT k, low + k * (size // 7) + least(k, size % 7) AS a, low + (k + 1) * (size // 7) + least(k + 1, size % 7) - 1 AS b FROM b, range(7) t(k))
SELECT CAST(k AS INTEGER) AS part, min(doc_id) AS low, max(doc_id) AS high, count(*) AS n FROM documents JOIN r ON doc_id BETWEEN a AND b GROUP BY k"""


def quotas(spark, d):
    """A hundred places shared out by the languages' numbers of documents, largest remainders first."""
    counts = documents(spark, d).groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row a language
    given = R.quotas(100, [r["n"] for r in counts])
    return spark.createDataFrame([(r["lang"], n) for r, n in zip(counts, given)], "lang string, places long")


QUOTAS = """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, 100.0 * n / (SELECT sum(n) FROM c) AS x FROM c),
r AS (SELECT lang, floor(x) AS w, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS k FROM e)
SELECT lang, CAST(w + CASE WHEN k <= 100 - (SELECT sum(w) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS places FROM r"""


def old_splits(spark, d):
    """The rates of two earlier splits: a fifth, and 2 and 56 of a hundred thousand."""
    fifth, fine = (R.hash_bucket([F.lower("text"), F.col("lang")], n) for n in (5, 100_000))
    return documents(spark, d).where("text is not null and lang is not null").select("doc_id", F.when(fifth == 0, "valid").otherwise("train").alias("first"), R.split_name(fine, 2, 58).alias("second"))


_HASH = "CAST('0x' || substr(md5(lower(text) || chr(31) || lang), 1, 8) AS BIGINT)"
OLD_SPLITS = f"SELECT doc_id, CASE WHEN {_HASH} % 5 = 0 THEN 'valid' ELSE 'train' END AS first, CASE WHEN {_HASH} % 100000 < 2 THEN 'test' WHEN {_HASH} % 100000 < 58 THEN 'valid' ELSE 'train' END AS second FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"

QUERIES = {
    "s1_keyed_range": (keyed_range, KEYED_RANGE),
    "s2_zipped_lines": (zipped_lines, ZIPPED_LINES),
    "s4_line_count": (line_count, LINE_COUNT),
    "s5_subtitles": (subtitles, SUBTITLES),
    "s7_csv_columns": (csv_columns, CSV_COLUMNS),
    "s8_json_lines": (json_lines, JSON_LINES),
    "s10_domain_splits": (domain_splits, DOMAIN_SPLITS),
    "s11_resumed_pages": (resumed_pages, RESUMED_PAGES),
    "s13_attached": (attached, ATTACHED),
    "s16_third_page": (third_page, THIRD_PAGE),
    "s17_columns": (columns_of, COLUMNS_OF),
    "s14_first_table": (first_table, FIRST_TABLE),
    "s18_relation_summary": (relation_summary, RELATION_SUMMARY),
    "s20_found_examples": (found_examples, FOUND_EXAMPLES),
    "k4_versioned_table": (versioned_table, VERSIONED_TABLE),
    "k7_partitions": (partitions, PARTITIONS),
    "k10_resumed_csv": (resumed_csv, RESUMED_CSV),
    "k11_shuffled_csv": (shuffled_csv, SHUFFLED_CSV),
    "u8_old_splits": (old_splits, OLD_SPLITS),
    "u9_contiguous_ranges": (contiguous_ranges, CONTIGUOUS_RANGES),
    "a35_quotas": (quotas, QUOTAS),
}
