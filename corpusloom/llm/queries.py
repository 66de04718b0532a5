"""The queries of this subpackage's operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, html, langid, linededup, merkle, ngramjoin, packing, quality, topk


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine; a parameter of every operator that reads one."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null page is empty.  See ``html.extract_main_text`` for odd pages, ties, repeats and empty tables."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; a null text stays null.  See ``linededup.dedup_lines``."""
    return linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token rows of every conversation and of conversation -7 say when they are read back; null texts are empty.  See ``chat.format_conversations``."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    path = tokenizer_file("byte_bpe_50k.json")
    return chat.read_back(chat.format_conversations(rows, path), path)


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit; null texts are empty.  See ``merkle.compare_with_edits``."""
    made = merkle.compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; null texts and those without a letter are ``und``.  See ``langid.predict``."""
    model = langid.language_model(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.third_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best partners of every vector whose id is divisible by 50.  See ``topk.top_k`` for nulls, ties, repeats and empty tables."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences; null texts are their end id.  See ``packing.pack_documents``."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every text's ids, digest of what they decode to; null texts have none.  See ``bpe.encode_texts``."""
    made = bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, empty and null ones too.  See ``quality.score_quality``."""
    field = quality.quality_model(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score_quality(docs, field)
    return found.select("doc_id", quality.fifth_held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 5-word shingles.  See ``ngramjoin.near_duplicates``."""
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusloom.llm import pipeline

    ops = (op1_html_text, op2_line_dedup, op3_chat_format, op4_merkle_fingerprint, op5_language_id, op6_exact_top_k, op7_packing, op8_bpe_round_trip, op9_quality, op10_ngram_join)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE_SQL, "op6_exact_top_k": topk.ORACLE_SQL}
