"""A Bloom filter over a key column, built and probed with DataFrame functions.

The filter is a table of set bit positions grouped into 64-bit words, so it stays distributed: its
size follows the number of bits asked for, never the driver's memory. Double hashing over xxhash64.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sizing import bloom_params


def _positions(key: Column, bits: int, hashes: int) -> Column:
    h = F.xxhash64(key)
    base, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(base + step * i, F.lit(bits)))


def build(df: DataFrame, key: str, n: int, fpr: float = 0.01) -> DataFrame:
    """Rows (word, mask): the non-zero 64-bit words of the filter. Nulls are not inserted."""
    bits, hashes = bloom_params(max(n, 1), fpr)
    pos = df.where(F.col(key).isNotNull()).select(F.explode(_positions(F.col(key), bits, hashes)).alias("p"))
    return pos.groupBy((F.shiftright("p", 6)).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("mask")
    )


def might_contain(probes: DataFrame, key: str, filt: DataFrame, n: int, fpr: float = 0.01) -> DataFrame:
    """probes with a boolean might_contain: never false for an inserted key; false for null."""
    bits, hashes = bloom_params(max(n, 1), fpr)
    ids = probes.select(F.col(key).alias("_k")).where("_k is not null").distinct()
    pos = ids.select("_k", F.explode(_positions(F.col("_k"), bits, hashes)).alias("p"))
    hit = pos.join(filt, F.shiftright("p", 6) == F.col("word"), "left")
    ok = hit.groupBy("_k").agg(
        F.bool_and(F.coalesce(F.expr("(shiftright(mask, cast(p & 63 AS int)) & 1) = 1"), F.lit(False))).alias("_ok")
    )
    return probes.join(ok, F.col(key) == F.col("_k"), "left").withColumn(
        "might_contain", F.coalesce("_ok", F.lit(False))
    ).drop("_k", "_ok")


def crc(word: Column, mask: Column) -> Column:
    """CRC-32 of a row of a filter, for a stored copy: of its place and its 64 bits, big-endian."""
    return F.crc32(F.unhex(F.concat(F.lpad(F.hex(word), 16, "0"), F.lpad(F.hex(mask), 16, "0"))))


def encode(filt: DataFrame) -> DataFrame:
    """(word, mask, crc): the filter as it is stored."""
    return filt.select("word", "mask", crc(F.col("word").cast("long"), F.col("mask")).alias("crc"))


def decode(stored: DataFrame) -> DataFrame:
    """(word, mask) of an encoded filter; reading a row whose checksum is wrong raises."""
    wrong = F.raise_error(F.lit("the checksum of a Bloom filter is wrong")).cast("long")
    ok = F.col("crc") == crc(F.col("word").cast("long"), F.col("mask"))
    return stored.select("word", F.when(ok, F.col("mask")).otherwise(wrong).alias("mask"))
