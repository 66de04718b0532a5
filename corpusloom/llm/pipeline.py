"""From raw documents to packed training sequences, stage by stage.

Each stage is given the documents that the one before it kept; its decisions take effect; all but the last return the columns
of documents.  A stage's result is written to the shared folder and read again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, linededup, ngramjoin, packing, quality
from corpusloom.llm.queries import tokenizer_file
from corpusloom.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less sure than this are rejected, as are those without a letter.
MIN_LANGUAGE_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line field predicts to be good.

    Null and empty texts are blank lines and judged as such; texts of any length are read whole; repeated rows are judged alike; a score of exactly
    the threshold stays; an empty table gives none; columns other than those of documents are dropped.
    """
    scored = quality.score_quality(docs.select(COLUMNS), quality.quality_model(spark, sf_dir))
    return scored.where(F.col("predicted") == 1).select(COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a learned language; ``lang`` becomes the predicted one.

    Texts that are null, empty or without a letter have no language and go; texts of any length are read whole; repeated rows are judged alike;
    of languages that are as likely the first in order stands; an empty table gives none; columns other than those of documents are dropped.
    """
    found = langid.predict(docs.select(COLUMNS), langid.language_model(spark, sf_dir))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; every document stays, and ``n_chars`` is counted anew (null for a null text).

    A document of nothing but common lines is a copied one and stays whole, for the next stage to find.  Null sources are one source; rows that
    repeat an id count as one page; blank lines stay; an empty table gives none; columns other than those of documents are dropped.
    """
    cut = linededup.dedup_lines(docs.select(COLUMNS), keep_copied_pages=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of one id the smallest text.

    Rows that repeat an id are documents of their own: of those with equal texts one stays, others only go if they are linked.  Null and blank texts
    are linked with none and stay; rows with a null id take no part and stay; texts of any length are read whole; an empty table gives none;
    columns other than those of documents are dropped.
    """
    work = Workspace(spark, "near-duplicates", few_files=True)
    rows = docs.select(COLUMNS).withColumn("row", F.col("doc_id"))
    with_id = docs.where(F.col("doc_id").isNotNull())
    repeated = with_id.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        order = [F.col("doc_id").asc(), F.col("text").asc_nulls_last()]
        single = with_id.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("s")).select("doc_id", "text", "s.*")
        numbered = single.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
        rows = work.table(numbered).unionByName(rows.where(F.col("doc_id").isNull()))
    found = ngramjoin.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    out_of = found.where(F.col("doc_id").isNotNull() & (F.col("component_id") != F.col("doc_id"))).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(out_of, "row", "left_anti").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are their end id alone; texts of any length are packed whole; repeated rows are packed one by one, in order of id and text;
    an empty table gives none; other columns are ignored.
    """
    pieces = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_stage), ("language", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Models, components and packing cannot be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one written table after the other; what the last one reads stays until the driver's process ends."""
    work = Workspace(spark, "pipeline", few_files=True)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        kept = work.table(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
