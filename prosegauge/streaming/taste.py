"""The ledger of taste cases: counts that promote an observation to a trend and a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "case_id string, rule string, comment string, at timestamp"


def weight() -> F.Column:
    """A comment tagged [규칙] counts twice."""
    return F.when(F.contains("comment", F.lit("[규칙]")), 2).otherwise(1)


def stage(weight_sum: F.Column) -> F.Column:
    return F.when(weight_sum >= 4, "rule").when(weight_sum >= 2, "trend").otherwise("observation")


def promote(cases: DataFrame) -> DataFrame:
    """(rule, n_cases, weight, stage); works on a table and on a stream."""
    return cases.groupBy("rule").agg(F.count("*").alias("n_cases"), F.sum(weight()).alias("weight")).withColumn("stage", stage(F.col("weight")))


def read_ledger(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """The append-only JSON lines of a folder."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMA).json(folder)


def watch(spark: SparkSession, folder: str, checkpoint: str, table: str):
    """Keep the promotions of a growing ledger in a memory table; returns the running query."""
    promoted = promote(read_ledger(spark, folder, stream=True))
    return promoted.writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()
