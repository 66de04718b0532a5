"""Readers: line-aligned text, subtitles, CSV, JSON lines, JSON logs, examples in free text, tables by name."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_shards(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.parquet(pattern)


def keyed_range(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows of a key range, both ends included, sorted within partitions; the filter reaches the scan."""
    return df.where(F.col(key).between(low, high)).sortWithinPartitions(key)


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``line_no`` (from 1) and the line of a text file, or of the files of a folder in order of their names.

    A line's number is its place within its piece of a file, which the scan's running ids tell, behind the lines of the pieces before; only a row
    a piece is ordered.  Carriage returns stay, as only the newline ends a line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias(name), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__id"))
    pieces = lines.groupBy("__f", "__b").agg(F.min("__id").alias("__low"), F.count("*").alias("__n"), F.lit(1).alias("__one"))
    before = Window.partitionBy("__one").orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("__f", "__b", "__low", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return lines.join(starts, ["__f", "__b"]).select((F.col("__start") + F.col("__id") - F.col("__low") + 1).alias("line_no"), name)


def zipped_lines(spark: SparkSession, left: str, right: str, names: tuple[str, str] = ("br", "pt"), start_at: int = 0) -> DataFrame:
    """Two line-aligned files as (line_no, left, right); the shorter file ends both, ``start_at`` lines are left out."""
    a, b = numbered_lines(spark, left, names[0]), numbered_lines(spark, right, names[1])
    return a.join(b, "line_no").where(F.col("line_no") > start_at)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def file_pair(folder: str, preferred: tuple[str, str] | None = None, endings: tuple[str, str] = (".pt_BR", ".pt")) -> tuple[str, str]:
    """The preferred names if both are there, else the only files with the two endings; more or fewer are an error."""
    root = Path(folder)
    if preferred and all((root / n).is_file() for n in preferred):
        return str(root / preferred[0]), str(root / preferred[1])
    found = []
    for ending in endings:
        matches = sorted(p for p in root.iterdir() if p.name.endswith(ending))
        if len(matches) != 1:
            raise FileNotFoundError(f"{len(matches)} files end in {ending} in {folder}")
        found.append(str(matches[0]))
    return found[0], found[1]


_STAMP = r"(\d{2,}):(\d{2}):(\d{2})[,.](\d{3})"


def _ms(x: Column, first: int) -> Column:
    part = lambda k: F.regexp_extract(x, rf"{_STAMP}\s*-->\s*{_STAMP}", first + k).cast("long")
    return part(0) * 3_600_000 + part(1) * 60_000 + part(2) * 1000 + part(3)


def subtitles(spark: SparkSession, pattern: str) -> DataFrame:
    """Blocks of SubRip files: ``path``, ``block_no`` (from 0), ``start_ms``, ``end_ms``, ``text`` on one line.  What has no time line is left out."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "^﻿", "").alias("value"))
    blocks = files.select("path", F.posexplode(F.split("value", r"\n[ \t]*\n+")).alias("block_no", "block"))
    timed = blocks.where(F.col("block").rlike(rf"{_STAMP}\s*-->\s*{_STAMP}"))
    body = F.regexp_replace(F.col("block"), rf"(?s)^.*?{_STAMP}\s*-->\s*{_STAMP}[^\n]*\n?", "")
    return timed.select("path", "block_no", _ms(F.col("block"), 1).alias("start_ms"), _ms(F.col("block"), 5).alias("end_ms"), F.trim(F.regexp_replace(F.trim(body), r"\s*\n\s*", " ")).alias("text"))


def csv(spark: SparkSession, path: str, columns: Sequence[str], schema: str | None = None) -> DataFrame:
    """Some columns of a CSV file with a header; a missing one is an error that names it."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not in {path}: {', '.join(missing)}")
    return df.select(*columns)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A row a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def best_of_logs(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """From trainer states found in any subfolder: path, least value of the metric, and the step where it was first reached.

    Files that aren't JSON and entries without the metric are skipped.
    """
    schema = f"log_history array<struct<step: long, `{metric}`: double>>"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "trainer_state.json").option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(folder)
    each = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode("log_history").alias("place", "e")).where(F.col(f"e.`{metric}`").isNotNull())
    return each.groupBy("path").agg(F.min(F.struct(F.col(f"e.`{metric}`").alias("value"), F.col("place"), F.col("e.step").alias("step"))).alias("b")).select("path", F.col("b.value").alias("best"), F.col("b.step").alias("step"))


def domain_splits(spark: SparkSession, folder: str, text: str, domains: Sequence[str] | None = None, splits: Sequence[str] | None = None) -> DataFrame:
    """Rows of an export that is partitioned by ``domain`` and ``split``, of all or of the given ones; blank texts are left out.  Only partitions asked for are read."""
    df = spark.read.parquet(folder)
    for column, wanted in (("domain", domains), ("split", splits)):
        df = df if wanted is None else df.where(F.col(column).isin(*wanted))
    return df.where(F.trim(text) != "")


def attach(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Views ``<name>_<table>`` of every Parquet table in a folder, as if it were a second database; the views' names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = sorted(f.getPath().getName() for f in files.listStatus(where) if f.getPath().getName().endswith(".parquet"))
    for t in tables:
        spark.read.parquet(f"{folder}/{t}").createOrReplaceTempView(f"{name}_{t.removesuffix('.parquet')}")
    return [f"{name}_{t.removesuffix('.parquet')}" for t in tables]


def columns_of(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """``name``, ``place`` (from 0), ``column``, ``type`` of those of the tables that are there."""
    rows = [(n, k, f.name, f.dataType.simpleString()) for n in names if spark.catalog.tableExists(n) for k, f in enumerate(spark.table(n).schema)]
    return spark.createDataFrame(rows, "name string, place int, column string, type string")


def page(df: DataFrame, order: str, size: int, after=None) -> DataFrame:
    """The next ``size`` rows in order of a unique key, behind the key ``after``: each page is a filter and a top-k, however far it is."""
    rest = df if after is None else df.where(F.col(order) > F.lit(after))
    return rest.orderBy(order).limit(size)


def batches(df: DataFrame, size: int = 200_000) -> Iterator[list]:
    """Rows in lists of at most ``size``, partition by partition; the driver holds one partition and one list."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while part := list(itertools.islice(rows, size)):
        yield part


def unseen_from(df: DataFrame, page_column: str, key: str, new: DataFrame) -> tuple[int, DataFrame]:
    """Where a paged load goes on: the page behind the last one, and those of ``new`` whose key isn't there yet, once each."""
    last = df.agg(F.max(page_column)).first()[0]
    return (last or 0) + 1, new.dropDuplicates([key]).join(df.select(key), key, "left_anti")


# ---- examples in a model's answer -------------------------------------------------------------------------------------

_PAIR = re.compile(r'"(pt_PT|pt_BR)"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"(pt_PT|pt_BR)"\s*:\s*"((?:[^"\\]|\\.)*)"')
_LISTS = ("exemplos", "examples")


def _objects(value) -> list[dict]:
    """Every list of examples in a decoded value, however deep."""
    if isinstance(value, dict):
        own = [x for k in _LISTS if isinstance(value.get(k), list) for x in value[k] if isinstance(x, dict)]
        return own + [x for k, v in value.items() if k not in _LISTS for x in _objects(v)]
    if isinstance(value, list):
        return [x for v in value for x in _objects(v)]
    if isinstance(value, str) and "{" in value:
        return [{"pt_PT": a, "pt_BR": b} for a, b in examples_in(value)]
    return []


def examples_in(answer: str | None) -> list[tuple[str, str]]:
    """(European, Brazilian) pairs in an answer: its JSON objects, in a fence or bare, else the two keys next to each other in either order.

    Of equal pairs the last stands.
    """
    text = re.sub(r"```[a-zA-Z]*", "", answer or "")
    decoder, at, found = json.JSONDecoder(), 0, []
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        found += _objects(value) or ([value] if isinstance(value, dict) and {"pt_PT", "pt_BR"} <= set(value) else [])
        at = end
    pairs = [(str(x.get("pt_PT") or "").strip(), str(x.get("pt_BR") or "").strip()) for x in found]
    if not pairs:
        for k1, v1, k2, v2 in _PAIR.findall(text):
            if k1 != k2:
                sides = {k1: json.loads(f'"{v1}"', strict=False), k2: json.loads(f'"{v2}"', strict=False)}
                pairs.append((sides["pt_PT"].strip(), sides["pt_BR"].strip()))
    kept: dict[tuple[str, str], None] = {}
    for p in pairs:
        if all(p):
            kept.pop(p, None)
            kept[p] = None
    return list(kept)


def examples(df: DataFrame, answer: str) -> DataFrame:
    """A row for each example in each answer, with ``place`` in it."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pt_PT", T.StringType()), T.StructField("pt_BR", T.StringType())])))
    def found(answers: pd.Series) -> pd.Series:
        return answers.map(lambda a: [{"pt_PT": x, "pt_BR": y} for x, y in examples_in(a)], na_action=None)

    return df.select("*", F.posexplode(found(F.col(answer))).alias("place", "__e")).select("*", "__e.*").drop("__e")


# ---- tables by name ---------------------------------------------------------------------------------------------------


def first_table(spark: SparkSession, names: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """The first of the named tables or views that is there with all the columns; else an empty table of these columns."""
    for name in names:
        if spark.catalog.tableExists(name):
            df = spark.table(name)
            have = {c.lower() for c in df.columns}
            if all(c.lower() in have for c in columns):
                return df.select(*columns)
    return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))


def relation_summary(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Name, number of columns and rows of those of the tables that are there."""
    out = None
    for name in names:
        if spark.catalog.tableExists(name):
            df = spark.table(name)
            one = df.agg(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("rows"))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "name string, columns int, rows long")


def distinct_contents(spark: SparkSession, pattern: str) -> DataFrame:
    """Files by the MD5 of their content, the first path of equal ones: a download cache without repeats."""
    files = spark.read.format("binaryFile").load(pattern).select(F.md5("content").alias("digest"), "path", "length")
    w = Window.partitionBy("digest").orderBy("path")
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
