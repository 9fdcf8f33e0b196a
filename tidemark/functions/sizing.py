"""Scalar functions: record sizes, Bloom filter sizing, clock arithmetic."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import TOMB

#: Encoded bytes of a record besides its key and value: tag 1, ts 8, key length 2, value length 2 (values only).
VALUE_HEADER, TOMB_HEADER = 13, 11


def record_size(key: Column, value: Column, op: Column) -> Column:
    """Encoded bytes of a record: 13 + key + value, or 11 + key for a tombstone."""
    return F.when(op == TOMB, TOMB_HEADER + F.octet_length(key)).otherwise(
        VALUE_HEADER + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))
    )


def payload_size(key: Column, value: Column) -> Column:
    """Bytes that count towards a freeze: key and value, without headers."""
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def bloom_bits(n: Column, fpr: Column) -> Column:
    """Bits of a Bloom filter for n keys at a false-positive rate."""
    return F.ceil(-n * F.ln(fpr) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0))))


def bloom_hashes(n: Column, bits: Column) -> Column:
    """Hash functions of a Bloom filter with that many bits for n keys."""
    return F.ceil(bits / n * F.ln(F.lit(2.0)))


def bloom_params(n: int, fpr: float) -> tuple[int, int]:
    """(bits, hashes) on the driver, for writer options."""
    bits = math.ceil(-n * math.log(fpr) / math.log(2) ** 2)
    return bits, math.ceil(bits / n * math.log(2))
