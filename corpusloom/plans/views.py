"""The relations that queries start from, as DataFrames and as SQL.

A sentence pair is a user's turn and the assistant's next one; ``line_no`` orders them and ``pair_id`` is the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + u.turn AS line_no, u.conv_id AS pair_id, u.text AS br, a.text AS pt
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    u = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("br"))
    a = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pt"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("conv_id").alias("pair_id"), "br", "pt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
