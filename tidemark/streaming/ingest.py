"""Structured Streaming front end: every micro-batch becomes one commit."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import TOMB
from tidemark.sources.store import Store


def last_in_batch(batch: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc(order))
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """stream (key, op, value, order) into the store; the last operation of a key in a batch counts.

    The manifest holds the last batch of each stream (by its checkpoint), so a batch that is run again after a failure is committed once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        rows = last_in_batch(batch, order).select("key", F.col("op").cast("byte").alias("op"), F.when(F.col("op") != TOMB, F.col("value")).alias("value"))
        store._append(rows, (checkpoint, number))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
