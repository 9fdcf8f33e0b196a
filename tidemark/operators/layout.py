"""Storage statistics and the compaction planner."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.functions.sizing import payload_size, record_size


def level_stats(log: DataFrame, level: str = "level", run: str = "run_id") -> DataFrame:
    """Runs, records, encoded and payload bytes of every level."""
    return log.groupBy(level).agg(
        F.countDistinct(run).alias("n_runs"),
        F.count(F.lit(1)).alias("n_records"),
        F.sum(record_size(F.col("key"), F.col("value"), F.col("op"))).alias("encoded_bytes"),
        F.sum(payload_size(F.col("key"), F.col("value"))).alias("payload_bytes"),
    )


def run_bounds(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Smallest and largest key and ts of every run."""
    return log.groupBy(run).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n_records"))


def sparse_index(log: DataFrame, block_bytes: int, run: str = "run_id", tasks: int = 256) -> DataFrame:
    """First key and ts of every block of about block_bytes, with its offset, for each run.

    A run is cut into ranges of (key, ts) by a sample of 16 rows for each of about `tasks` ranges, which is all that
    reaches the driver; a range sums its own sizes and begins where the ranges before it end, so a run of any size, or a
    key of many versions, is spread. Rows of a run that are equal in key and ts stand in one range, in any order.
    """
    size = record_size(F.col("key"), F.col("value"), F.col("op")).cast("long")
    at = log.select(F.col(run).alias("_run"), "key", "ts", size.alias("_size")).withColumn("_at", F.struct("key", (-F.col("ts")).alias("back")))
    seed = F.xxhash64(F.lit(11), "_run", "key", "ts")
    cuts = at.select("_run", "_at").orderBy(seed, "_run", "_at").limit(16 * tasks).groupBy("_run").agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    cuts = at.sparkSession.createDataFrame(
        [(r["_run"], [x for k, x in enumerate(r["_cuts"]) if k % 16 == 15]) for r in cuts.collect()],
        StructType([at.schema["_run"], StructField("_cuts", ArrayType(at.schema["_at"].dataType))]),
    )
    dealt = at.join(F.broadcast(cuts.withColumnRenamed("_run", "_of")), F.col("_run").eqNullSafe(F.col("_of")), "left").select(
        "_run", "key", "ts", "_size", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c <= F.col("_at"))).alias("_part")
    )
    before = Window.partitionBy("_of").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(F.col("_run").alias("_of"), F.col("_part").alias("_nth")).agg(F.sum("_size").alias("_sum"))
    bases = bases.select("_of", "_nth", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_run", "_part").orderBy("key", F.desc("ts")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(bases, F.col("_run").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_nth"))).withColumn("_start", F.col("_base") + F.sum("_size").over(upto) - F.col("_size"))
    return placed.groupBy(F.col("_run").alias(run), F.floor(F.col("_start") / block_bytes).alias("block")).agg(
        F.min("_start").alias("offset"), F.min_by("key", "_start").alias("first_key"), F.min_by("ts", "_start").alias("first_ts")
    )


@dataclass(frozen=True)
class LevelPolicy:
    """A level compacts into the next when it has more runs than its threshold; target_bytes is where its output is cut."""

    max_runs: tuple[int, ...] = (32, 32, 100_000)
    level_0_bytes: int = 65_536
    multiplier: int = 1

    def target_bytes(self, level: int) -> int:
        return self.level_0_bytes * self.multiplier ** level


def plan(counts: dict[int, int], policy: LevelPolicy) -> list[tuple[int, int]]:
    """The (from, to) compactions due now, cascading: an L0 compaction may fill L1, and so on."""
    now, due = dict(counts), []
    for level, most in enumerate(policy.max_runs):
        if now.get(level, 0) > most:
            due.append((level, level + 1))
            now[level + 1] = now.get(level + 1, 0) + 1
            now[level] = 0
    return due
