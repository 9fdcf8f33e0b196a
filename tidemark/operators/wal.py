"""Log replay: autocommitted records, and transactions whose End record is there."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import LOG_END, LOG_TOMB, LOG_TX_TOMB, LOG_TX_VALUE, LOG_VALUE, TOMB, VALUE


def replay(wal: DataFrame) -> DataFrame:
    """Change log (key, ts, op, value). All of a transaction takes its End's ts; without End it is gone.

    Within a transaction the last record of a key counts.
    """
    op = F.when(F.col("rec_type").isin(LOG_TOMB, LOG_TX_TOMB), TOMB).otherwise(VALUE).cast("byte")
    auto = wal.where(F.col("rec_type").isin(LOG_VALUE, LOG_TOMB)).select("key", "ts", op.alias("op"), "value")
    ends = wal.where(F.col("rec_type") == LOG_END).groupBy("txn_id").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("txn_id", "key").orderBy(F.desc("lsn"))
    last = (
        wal.where(F.col("rec_type").isin(LOG_TX_VALUE, LOG_TX_TOMB)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
        .select("txn_id", "key", op.alias("op"), "value")
    )
    return auto.unionByName(last.join(ends, "txn_id").select("key", "ts", "op", "value"))
