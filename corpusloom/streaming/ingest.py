"""Files that arrive in a folder, upserted into a table batch by batch, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, pattern: str, schema, target: str, key: str, files_per_batch: int = 1) -> DataFrame:
    """Reads all files that the checkpoint of ``target`` has not seen, then stops; returns the table, one row a key, the last batch's row standing.

    Each batch is written under its own number, so that a batch repeated after a failure replaces itself.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{target}/data/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return current(spark, target, key)


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The table as of the last batch."""
    every = spark.read.parquet(f"{target}/data").drop("batch")
    rest = [c for c in every.columns if c not in (key, "batch_number")]
    return every.groupBy(key).agg(F.max(F.struct("batch_number", *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def compact(spark: SparkSession, target: str, key: str, number: int) -> None:
    """Writes the table as of now as batch ``number`` (the last one that was ingested) and deletes the batches before it, so that reading stays a pass over one."""
    merged = f"{target}/merged"
    current(spark, target, key).withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(merged)
    place = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(place(f"{target}/data")) if f.getPath().getName().startswith("batch=") and int(f.getPath().getName()[6:]) <= number]
    for path in old:
        files.delete(path, True)
    files.rename(place(merged), place(f"{target}/data/batch={number}"))


def sessions(events: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """Session windows by gap; the same on a stream with a watermark and on a table."""
    return events.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")
