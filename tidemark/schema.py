"""The fixed record schemas of the engine."""

from pyspark.sql import types as T

#: Record tags. A tombstone is told from a NULL value by its tag alone.
VALUE, TOMB = 0, 1

#: Log record tags: an autocommitted value or tombstone, and the parts of a transaction.
LOG_VALUE, LOG_TOMB, LOG_START, LOG_TX_VALUE, LOG_TX_TOMB, LOG_END = range(6)

CHANGE_LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("ts", T.LongType(), True),
        T.StructField("op", T.ByteType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)

WAL = T.StructType(
    [
        T.StructField("lsn", T.LongType(), True),
        T.StructField("rec_type", T.ByteType(), True),
        T.StructField("ts", T.LongType(), True),
        T.StructField("txn_id", T.LongType(), True),
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
    ]
)
