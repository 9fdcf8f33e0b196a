"""Transactions over a change log: write sets, overlays, commits and conflicts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.resolve import as_of
from tidemark.schema import TOMB, VALUE


def write_set(ops: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The last operation on each key: a put or delete overwrites earlier ones of its transaction."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return ops.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overlay(snapshot: DataFrame, writes: DataFrame) -> DataFrame:
    """What a transaction reads: its own writes, else its snapshot.

    Chosen by a presence flag, as a written NULL value hides the snapshot's value too.
    """
    mine = writes.select("key", F.col("op").alias("_wop"), F.col("value").alias("_wval"))
    both = snapshot.select("key", "value").join(mine, "key", "full_outer")
    return both.where("_wop is null or _wop = 0").select(
        "key", F.when(F.col("_wop").isNotNull(), F.col("_wval")).otherwise(F.col("value")).alias("value")
    )


def read(log: DataFrame, writes: DataFrame, start_ts: int) -> DataFrame:
    return overlay(as_of(log, start_ts), writes)


def commit(log: DataFrame, writes: DataFrame, commit_ts: int) -> DataFrame:
    """log with the write set at one timestamp; of two commits of a key the later wins."""
    rows = writes.select("key", F.lit(commit_ts).cast("long").alias("ts"), F.col("op").cast(log.schema["op"].dataType).alias("op"), F.when(F.col("op") == VALUE, F.col("value")).alias("value"))
    return log.select("key", "ts", "op", "value").unionByName(rows)


def conflicts(log: DataFrame, writes: DataFrame, start_ts: int, commit_ts: int | None = None) -> DataFrame:
    """Keys of the write set that someone else wrote after start_ts, with that version's newest ts."""
    later = log.where(F.col("ts") > start_ts)
    if commit_ts is not None:
        later = later.where(F.col("ts") < commit_ts)
    return later.join(writes.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("ts").alias("conflict_ts"))


__all__ = ["TOMB", "commit", "conflicts", "overlay", "read", "write_set"]
