"""Writers: parallel line files, JSON lines, CSV with running ids, versioned tables, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.examples import parallel_lines
from corpusloom.operators.relational import insert_missing, running_place, upsert


def json_lines(df: DataFrame, path: str) -> None:
    """A line a row, nulls written, other alphabets as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_rows(df: DataFrame, path: str, order: str, seed: int | None = None, after: int = 0, identity: str = "id") -> DataFrame:
    """Appends rows with running ids from ``after`` + 1, in order of a numeric key or of a seeded shuffle of it; returns what was written."""
    if seed is None:
        numbered = running_place(df, order, identity)
    else:
        mixed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
        numbered = running_place(df.withColumn("__mixed", mixed), "__mixed", identity).drop("__mixed")
    numbered = numbered.select((F.col(identity) + 1 + after).alias(identity), *df.columns)
    numbered.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return numbered


def resume_csv(df: DataFrame, path: str, order: str, identity: str = "id") -> DataFrame:
    """Appends rows to a CSV folder that may have rows: the header there stands, ids go on from the greatest one; returns what was written.

    A header without one of the columns is an error that names it; columns that only the header has are empty.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return csv_rows(df, path, order, identity=identity)
    old = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if missing := [c for c in (identity, *df.columns) if c not in old.columns]:
        raise ValueError(f"columns not in the header of {path}: {', '.join(missing)}")
    last = old.agg(F.max(F.col(identity).cast("long"))).first()[0] or 0
    numbered = running_place(df, order, identity).withColumn(identity, F.col(identity) + 1 + last)
    made = numbered.select(*[F.col(c) if c in (identity, *df.columns) else F.lit(None).cast("string").alias(c) for c in old.columns])
    made.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return made


def parallel_files(df: DataFrame, key: str, a: str, b: str, folder: str) -> None:
    """Three folders of part files in one order: lines of each side, and ``key<TAB>idx``."""
    lines = parallel_lines(df, key, a, b).repartitionByRange("idx").sortWithinPartitions("idx")
    lines.select(F.col(f"{a}_line")).write.mode("overwrite").text(f"{folder}/{a}")
    lines.select(F.col(f"{b}_line")).write.mode("overwrite").text(f"{folder}/{b}")
    lines.select(F.concat_ws("\t", F.col(key).cast("string"), F.col("idx").cast("string"))).write.mode("overwrite").text(f"{folder}/ids")


class VersionedTable:
    """A view over the newest of several written versions: a table is replaced without being overwritten while it is read."""

    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")
        self.versions: list[str] = []

    def replace(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.versions.append(path)
        self.spark.read.parquet(path).createOrReplaceTempView(self.name)
        return self.spark.table(self.name)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the newest versions, once no query reads them any more."""
        for path in self.versions[:-keep]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.versions = self.versions[-keep:]

    def insert(self, rows: DataFrame, key: str) -> DataFrame:
        return self.replace(insert_missing(self.spark.table(self.name), rows, key))

    def upsert(self, rows: DataFrame, key: str) -> DataFrame:
        return self.replace(upsert(self.spark.table(self.name), rows, key))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes only the partitions that ``df`` has rows of; a repeated run replaces its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def report(df: DataFrame) -> str:
    """A one-row table as a JSON object."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]
