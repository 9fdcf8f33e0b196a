"""Tables of a folder of Parquet files, and the change log that the queries read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as a change log: an 'error' event deletes its user's state, others replace it."""
    e = table(spark, folder, "events")
    tomb = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").alias("ts"),
        F.when(tomb, 1).otherwise(0).cast("int").alias("op"),
        F.when(~tomb, F.col("props")).alias("value"),
    )
