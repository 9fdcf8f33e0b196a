"""Reads over a change log (key, ts, op, value, ...): pure DataFrame to DataFrame.

A log may hold any further columns; they travel with the version they belong to. `ts <= t` is
inclusive. The newest version is picked first and tombstones go after, or a deleted key would
come back with its last value. row_number() == 1 plans as WindowGroupLimit on both sides of the
one shuffle, so at most one row for each key and map task is shuffled.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import TOMB, VALUE


def newest(log: DataFrame, ts: int | None = None, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest version of every key, at most ts; tombstones included."""
    if ts is not None:
        log = log.where(F.col("ts") <= F.lit(ts))
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def drop_tombs(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("op") == VALUE)


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """The live state at ts."""
    return drop_tombs(newest(log, ts))


def live(log: DataFrame) -> DataFrame:
    """The current live state."""
    return drop_tombs(newest(log))


def tombstones(log: DataFrame, ts: int | None = None) -> DataFrame:
    """Keys whose newest version is a tombstone."""
    return newest(log, ts).where(F.col("op") == TOMB)


def union_runs(*runs: DataFrame) -> DataFrame:
    """Run merge: one union, then whatever read follows shuffles once."""
    return reduce(DataFrame.unionByName, runs)


def multi_get(log: DataFrame, probes: DataFrame, ts: int | None = None) -> DataFrame:
    """probes (key, ...) with `value` and `found`; a missing and a deleted key are both not found.

    The log is first cut to the probed keys: Spark broadcasts the probe keys when they are known
    to be small and shuffles both sides when they are not.
    """
    wanted = log.join(probes.select("key").distinct(), "key", "left_semi")
    hit = drop_tombs(newest(wanted, ts)).select("key", F.col("value").alias("value"), F.lit(True).alias("found"))
    return probes.join(hit, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def as_of_join(log: DataFrame, probes: DataFrame, probe_ts: str = "t") -> DataFrame:
    """For every probe row (key, probe_ts, ...) the live value at its own time.

    Written as a union and one running `last`, so a hot key costs its own rows and never the
    product of its versions and probes. Probes with a null key or time find nothing.
    """
    extra = [c for c in probes.columns if c not in ("key", probe_ts)]
    left = log.select("key", F.col("ts").alias("_at"), F.lit(0).alias("_probe"), F.struct("op", "value").alias("_v"), F.lit(None).alias("_row"))
    right = probes.select(
        "key", F.col(probe_ts).cast("long").alias("_at"), F.lit(1).alias("_probe"),
        F.lit(None).cast(left.schema["_v"].dataType).alias("_v"), F.struct(F.lit(1).alias("_is"), *extra).alias("_row"),
    )
    both = left.withColumn("_row", F.lit(None).cast(right.schema["_row"].dataType)).unionByName(right)
    w = Window.partitionBy("key").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_probe = 1")
    hit = (F.col("_last.op") == VALUE) & F.col("key").isNotNull() & F.col("_at").isNotNull()
    return got.select(
        "key", F.col("_at").alias(probe_ts), *[F.col("_row").getField(c).alias(c) for c in extra],
        F.when(hit, F.col("_last.value")).alias("value"), F.coalesce(hit, F.lit(False)).alias("found"),
    )


def semi(probes: DataFrame, log: DataFrame, ts: int | None = None) -> DataFrame:
    """Probe rows whose key is live."""
    return probes.join(drop_tombs(newest(log, ts)).select("key"), "key", "left_semi")


def anti(probes: DataFrame, log: DataFrame, ts: int | None = None) -> DataFrame:
    """Probe rows whose key is missing or deleted."""
    return probes.join(drop_tombs(newest(log, ts)).select("key"), "key", "left_anti")


def history(log: DataFrame) -> DataFrame:
    """Every version with its validity [valid_from, valid_to); valid_to is null for the newest."""
    w = Window.partitionBy("key").orderBy("ts")
    return log.withColumn("valid_from", F.col("ts")).withColumn("valid_to", F.lead("ts").over(w))


def range_scan(log: DataFrame, low=None, high=None, ts: int | None = None) -> DataFrame:
    """Live rows with low <= key <= high. The bounds reach the Parquet scan, before the ranking."""
    return drop_tombs(newest(_between(log, low, high), ts))


def prefix_scan(log: DataFrame, prefix, ts: int | None = None) -> DataFrame:
    return drop_tombs(newest(log.where(F.startswith(F.col("key"), F.lit(prefix))), ts))


def _between(log: DataFrame, low, high) -> DataFrame:
    cond: Column | None = None
    for bound in ([F.col("key") >= F.lit(low)] if low is not None else []) + ([F.col("key") <= F.lit(high)] if high is not None else []):
        cond = bound if cond is None else cond & bound
    return log if cond is None else log.where(cond)
