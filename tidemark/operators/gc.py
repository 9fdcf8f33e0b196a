"""Version garbage collection and run splitting."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sizing import record_size
from tidemark.operators.resolve import newest
from tidemark.schema import TOMB


def compact(log: DataFrame, watermark: int, purge_tombs: bool = False) -> DataFrame:
    """Keep every version with ts >= watermark and, of the older ones, the newest of each key.

    Two branches rather than one window with OR: the old branch then plans as WindowGroupLimit.
    purge_tombs also drops old tombstones; only right at the bottom level, with no older run below.
    """
    recent = log.where(F.col("ts") >= watermark)
    old = newest(log.where(F.col("ts") < watermark))
    if purge_tombs:
        old = old.where(F.col("op") != TOMB)
    return recent.unionByName(old)


def watermark(markers: DataFrame, current_ts: int) -> DataFrame:
    """One row: the oldest open snapshot, else the timestamp before the current one."""
    return markers.agg(F.coalesce(F.min("marker"), F.lit(current_ts - 1)).alias("watermark"))


def split_runs(log: DataFrame, target_bytes: int) -> DataFrame:
    """log with run_id: pieces of about target_bytes encoded bytes that don't overlap in key.

    Keys are dealt into ranges first and every range is cut by its own running sum, so no task
    sees the whole log; run_id rises with the key.
    """
    sized = log.withColumn("_size", record_size(F.col("key"), F.col("value"), F.col("op")).cast("long"))
    parts = sized.repartitionByRange("key").withColumn("_part", F.spark_partition_id().cast("long"))
    upto = Window.partitionBy("_part").orderBy("key", F.desc("ts")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy("_part", "key")
    cut = parts.withColumn("_piece", F.floor((F.sum("_size").over(upto) - 1) / target_bytes))
    return cut.withColumn("run_id", F.shiftleft("_part", 32) + F.min("_piece").over(first)).drop("_size", "_part", "_piece")
