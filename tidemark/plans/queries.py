"""The engine's queries over the test tables, each with the same result in plain SQL."""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import sizing
from tidemark.operators import gc, layout, resolve, txn, wal
from tidemark.schema import LOG_END, LOG_START, LOG_TOMB, LOG_TX_TOMB, LOG_TX_VALUE, LOG_VALUE
from tidemark.sources.store import Config, Store
from tidemark.sources.tables import change_log, table

#: Times of the queries, in SQL: N is the first time after all events, T their middle.
N = "(SELECT max(event_id) + 1 FROM events)"
T, FPR = f"({N} // 2)", 0.01

LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS ts,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value FROM events)"""


def _newest(of: str = "log", where: str = "TRUE", keys: str = "key") -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts DESC) AS rn FROM {of} WHERE {where}) WHERE rn = 1)"


def _end(spark: SparkSession, d: str, parts: int = 1, of: int = 1) -> int:
    """The time when parts/of of all events have passed: one number from a scan of one column."""
    return (table(spark, d, "events").agg(F.max("event_id")).first()[0] + 1) * parts // of


def _mid(spark: SparkSession, d: str) -> int:
    return _end(spark, d, 1, 2)


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))


PROBES = f"probes AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey * 7 % {N} AS t FROM customer)"


def _runs(spark: SparkSession, d: str) -> list[DataFrame]:
    log = change_log(spark, d)
    return [log.where(F.col("ts") % 4 == n) for n in range(4)]


def _levels(spark: SparkSession, d: str) -> DataFrame:
    log = change_log(spark, d)
    return log.withColumn("run_id", F.floor(F.col("ts") / 500).cast("long")).withColumn("level", (F.floor(F.col("ts") / 500) % 4).cast("long"))


LEVELS = "lv AS (SELECT *, ts // 500 AS run_id, (ts // 500) % 4 AS level FROM log)"
SIZE = "CASE WHEN op = 1 THEN 11 + octet_length(key::BLOB) ELSE 13 + octet_length(key::BLOB) + octet_length(coalesce(value, '')::BLOB) END"


def _writes(spark: SparkSession, d: str) -> DataFrame:
    """The operations of a transaction that began at T: every third event after it."""
    log = change_log(spark, d)
    return txn.write_set(log.where((F.col("ts") > _mid(spark, d)) & (F.col("ts") % 3 == 0)).withColumnRenamed("ts", "seq"))


WRITES = f"w AS {_newest(where=f'ts > {T} AND ts % 3 = 0')}"


def _wal(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: ten in a row are a transaction, but for those of every fifth ten; some lack End."""
    log = change_log(spark, d)
    tx, kind = F.floor(F.col("ts") / 10).cast("long"), F.floor(F.col("ts") / 10) % 5 == 0
    rows = log.select(
        (F.col("ts") * 3 + 1).alias("lsn"),
        F.when(kind, F.when(F.col("op") == 1, LOG_TOMB).otherwise(LOG_VALUE)).otherwise(F.when(F.col("op") == 1, LOG_TX_TOMB).otherwise(LOG_TX_VALUE)).alias("rec_type"),
        F.when(kind, F.col("ts")).alias("ts"), F.when(~kind, tx).alias("txn_id"), "key", "value",
    )
    of_tx = log.select(tx.alias("txn_id")).distinct().where("txn_id % 5 <> 0")
    null = F.lit(None).cast("string")
    starts = of_tx.select((F.col("txn_id") * 30).alias("lsn"), F.lit(LOG_START).alias("rec_type"), (F.col("txn_id") * 10).alias("ts"), "txn_id", null.alias("key"), null.alias("value"))
    ends = of_tx.where("txn_id % 7 <> 3").select((F.col("txn_id") * 30 + 29).alias("lsn"), F.lit(LOG_END).alias("rec_type"), (F.col("txn_id") * 10 + 9).alias("ts"), "txn_id", null.alias("key"), null.alias("value"))
    return rows.unionByName(starts).unionByName(ends)


REPLAY = f"""WITH {LOG}, tx AS (SELECT *, ts // 10 AS txn_id FROM log),
 last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY ts DESC) AS rn FROM tx WHERE txn_id % 5 <> 0) WHERE rn = 1)
 SELECT key, ts, op, value FROM tx WHERE txn_id % 5 = 0
 UNION ALL SELECT key, txn_id * 10 + 9 AS ts, op, value FROM last WHERE txn_id % 7 <> 3"""


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Two transactions from one snapshot, committed one after the other on shared keys."""
    half, top = _mid(spark, d), _end(spark, d)
    base = change_log(spark, d).where(F.col("ts") <= half)
    ops = change_log(spark, d).where(F.col("ts") > half)
    one = txn.write_set(ops.where("ts % 2 = 0").withColumnRenamed("ts", "seq"))
    two = txn.write_set(ops.where("ts % 3 = 0").withColumnRenamed("ts", "seq"))
    log = txn.commit(txn.commit(base, one, top), two, top + 1)
    return resolve.newest(log)


COMMITS = f"""WITH {LOG}, one AS {_newest(where=f'ts > {T} AND ts % 2 = 0')}, two AS {_newest(where=f'ts > {T} AND ts % 3 = 0')},
 al AS (SELECT key, ts, op, value FROM log WHERE ts <= {T} UNION ALL SELECT key, {N}, op, value FROM one UNION ALL SELECT key, {N} + 1, op, value FROM two)
 SELECT key, ts, op, value FROM {_newest('al')}"""


def _bloom(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of Bloom filters for the number of keys of each table."""
    n = change_log(spark, d).agg(F.countDistinct("key").cast("long").alias("n"))
    bits = sizing.bloom_bits(F.col("n"), F.lit(FPR))
    return n.select("n", bits.cast("long").alias("bits"), sizing.bloom_hashes(F.col("n"), bits).cast("long").alias("hashes"))


def _bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Live keys by the filter, then exactly: the filter must lose none of them."""
    from tidemark.functions import bloom

    log = resolve.live(change_log(spark, d)).select("key")
    n = 100_000
    out = bloom.might_contain(_probes(spark, d), "key", bloom.build(log, "key", n, FPR), n, FPR)
    return out.where("might_contain").join(log, "key", "left_semi").select("key")


def _store(spark: SparkSession, d: str) -> tuple[Store, int]:
    """A store of binary keys in the shared folder: the state at T, then what came after it in a transaction, merged to level 1."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    log, half = change_log(spark, d), _mid(spark, d)
    store = Store.create(spark, f"{where.rstrip('/')}/store-{uuid.uuid4().hex}", Config(level_0_bytes=1 << 20))
    first = store.put(resolve.as_of(log, half))
    store.persist()
    later = resolve.newest(log.where(F.col("ts") > half))
    with store.transaction() as tx:
        tx.put_all(later.where("op = 0"))
        tx.delete_all(later.where("op = 1"))
        tx.commit()
    store.persist()
    store.compact(0)
    return store, first


def _text(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _store_as_of(spark: SparkSession, d: str) -> DataFrame:
    store, first = _store(spark, d)
    return _text(store.as_of(first))


def _split(spark: SparkSession, d: str) -> DataFrame:
    """Records and bytes of each key, and the runs it stands in: one."""
    cut = gc.split_runs(change_log(spark, d), 65_536)
    size = sizing.record_size(F.col("key"), F.col("value"), F.col("op"))
    return cut.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"), F.sum(size).cast("long").alias("bytes"), F.countDistinct("run_id").alias("n_runs"))


KV: list[tuple[str, Callable[[SparkSession, str], DataFrame], str]] = [
    ("kv_scan", lambda s, d: change_log(s, d), f"WITH {LOG} SELECT * FROM log"),
    ("latest_live", lambda s, d: resolve.live(change_log(s, d)), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest()} WHERE op = 0"),
    ("as_of_snapshot", lambda s, d: resolve.as_of(change_log(s, d), _mid(s, d)), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest(where=f'ts <= {T}')} WHERE op = 0"),
    ("multi_get", lambda s, d: resolve.multi_get(change_log(s, d), _probes(s, d)), f"WITH {LOG}, {PROBES} SELECT p.key, n.value, n.key IS NOT NULL AS found FROM probes p LEFT JOIN (SELECT * FROM {_newest()} WHERE op = 0) n ON p.key = n.key"),
    ("multi_get_as_of", lambda s, d: resolve.multi_get(change_log(s, d), _probes(s, d), _mid(s, d)), f"WITH {LOG}, {PROBES} SELECT p.key, n.value, n.key IS NOT NULL AS found FROM probes p LEFT JOIN (SELECT * FROM {_newest(where=f'ts <= {T}')} WHERE op = 0) n ON p.key = n.key"),
    (
        "as_of_join",
        lambda s, d: resolve.as_of_join(change_log(s, d), table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_custkey") * 7 % _end(s, d)).alias("t"))),
        f"WITH {LOG}, {PROBES} SELECT p.key, p.t, CASE WHEN l.op = 0 THEN l.value END AS value, coalesce(l.op = 0, false) AS found FROM probes p ASOF LEFT JOIN log l ON p.key = l.key AND p.t >= l.ts",
    ),
    ("live_semi", lambda s, d: resolve.semi(_probes(s, d), change_log(s, d)), f"WITH {LOG}, {PROBES} SELECT key FROM probes p WHERE EXISTS (SELECT 1 FROM {_newest()} n WHERE n.op = 0 AND n.key = p.key)"),
    ("live_anti", lambda s, d: resolve.anti(_probes(s, d), change_log(s, d)), f"WITH {LOG}, {PROBES} SELECT key FROM probes p WHERE NOT EXISTS (SELECT 1 FROM {_newest()} n WHERE n.op = 0 AND n.key = p.key)"),
    ("tombstones", lambda s, d: resolve.tombstones(change_log(s, d)).select("key", "ts"), f"WITH {LOG} SELECT key, ts FROM {_newest()} WHERE op = 1"),
    ("gc_compact", lambda s, d: gc.compact(change_log(s, d), _mid(s, d)), f"WITH {LOG} SELECT * FROM log WHERE ts >= {T} UNION ALL SELECT key, ts, op, value FROM {_newest(where=f'ts < {T}')}"),
    ("gc_purge_tombs", lambda s, d: gc.compact(change_log(s, d), _mid(s, d), purge_tombs=True), f"WITH {LOG} SELECT * FROM log WHERE ts >= {T} UNION ALL SELECT key, ts, op, value FROM {_newest(where=f'ts < {T}')} WHERE op = 0"),
    ("gc_preserves_snapshot", lambda s, d: resolve.as_of(gc.compact(change_log(s, d), _mid(s, d)), _end(s, d, 3, 4)), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest(where=f'ts <= {N} * 3 // 4')} WHERE op = 0"),
    ("merge_runs", lambda s, d: resolve.newest(resolve.union_runs(*_runs(s, d))), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest()}"),
    ("txn_overlay", lambda s, d: txn.read(change_log(s, d), _writes(s, d), _mid(s, d)), f"WITH {LOG}, {WRITES}, snap AS (SELECT * FROM {_newest(where=f'ts <= {T}')} WHERE op = 0) SELECT coalesce(w.key, s.key) AS key, CASE WHEN w.op IS NOT NULL THEN w.value ELSE s.value END AS value FROM snap s FULL JOIN w ON s.key = w.key WHERE w.op IS NULL OR w.op = 0"),
    ("txn_last_commit_wins", _commits, COMMITS),
    ("wal_replay", lambda s, d: wal.replay(_wal(s, d)).select("key", "ts", F.col("op").cast("int").alias("op"), "value"), REPLAY),
    ("write_conflicts", lambda s, d: txn.conflicts(change_log(s, d), _writes(s, d), _mid(s, d), _end(s, d, 9, 10)), f"WITH {LOG}, {WRITES} SELECT key, max(ts) AS conflict_ts FROM log WHERE ts > {T} AND ts < {N} * 9 // 10 AND key IN (SELECT key FROM w) GROUP BY key"),
    ("record_size", lambda s, d: change_log(s, d).select("key", "ts", sizing.record_size(F.col("key"), F.col("value"), F.col("op")).cast("long").alias("bytes")), f"WITH {LOG} SELECT key, ts, CAST({SIZE} AS BIGINT) AS bytes FROM log"),
    ("level_stats", lambda s, d: layout.level_stats(_levels(s, d)), f"WITH {LOG}, {LEVELS} SELECT level, count(DISTINCT run_id) AS n_runs, count(*) AS n_records, CAST(sum({SIZE}) AS BIGINT) AS encoded_bytes, CAST(sum(octet_length(key::BLOB) + octet_length(coalesce(value, '')::BLOB)) AS BIGINT) AS payload_bytes FROM lv GROUP BY level"),
    ("run_bounds", lambda s, d: layout.run_bounds(_levels(s, d)), f"WITH {LOG}, {LEVELS} SELECT run_id, min(key) AS min_key, max(key) AS max_key, min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS n_records FROM lv GROUP BY run_id"),
    (
        "sparse_index",
        lambda s, d: layout.sparse_index(_levels(s, d), 4096),
        f"WITH {LOG}, {LEVELS}, sz AS (SELECT *, CAST({SIZE} AS BIGINT) AS b FROM lv), st AS (SELECT *, CAST(sum(b) OVER (PARTITION BY run_id ORDER BY key, ts DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) - b AS st FROM sz) SELECT run_id, st // 4096 AS block, min(st) AS \"offset\", arg_min(key, st) AS first_key, arg_min(ts, st) AS first_ts FROM st GROUP BY run_id, st // 4096",
    ),
    ("oldest_marker", lambda s, d: gc.watermark(table(s, d, "customer").where("c_acctbal > 1e9").select(F.col("c_custkey").alias("marker")), _mid(s, d)), f"SELECT coalesce(min(c_custkey), {T} - 1) AS watermark FROM customer WHERE c_acctbal > 1e9"),
    ("oldest_marker_open", lambda s, d: gc.watermark(table(s, d, "customer").where("c_custkey > 7").select(F.col("c_custkey").alias("marker")), _mid(s, d)), f"SELECT coalesce(min(c_custkey), {T} - 1) AS watermark FROM customer WHERE c_custkey > 7"),
    ("bloom_params", _bloom, f"WITH {LOG}, c AS (SELECT count(DISTINCT key) AS n FROM log) SELECT n, CAST(ceil(-n * ln({FPR}) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(ceil(ceil(-n * ln({FPR}) / (ln(2) * ln(2))) / n * ln(2)) AS BIGINT) AS hashes FROM c"),
    ("bloom_probe", _bloom_probe, f"WITH {LOG}, {PROBES} SELECT key FROM probes WHERE key IN (SELECT key FROM {_newest()} WHERE op = 0)"),
    ("version_history", lambda s, d: resolve.history(change_log(s, d)).select("key", "op", "value", "valid_from", "valid_to"), f"WITH {LOG} SELECT key, op, value, ts AS valid_from, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS valid_to FROM log"),
    ("key_range_scan", lambda s, d: resolve.range_scan(change_log(s, d), "10", "50"), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest(where=chr(39).join(['key BETWEEN ', '10', ' AND ', '50', '']))} WHERE op = 0"),
    ("prefix_scan", lambda s, d: resolve.prefix_scan(change_log(s, d), "1"), f"WITH {LOG} SELECT key, ts, op, value FROM {_newest(where=chr(39).join(['starts_with(key, ', '1', ')']))} WHERE op = 0"),
    (
        "multi_column_versions",
        lambda s, d: resolve.newest(table(s, d, "conversations").withColumnsRenamed({"turn": "ts"}), keys=("conv_id",)).select("conv_id", "ts", "role"),
        "SELECT conv_id, ts, role FROM (SELECT conv_id, turn AS ts, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1",
    ),
    ("split_runs", _split, f"WITH {LOG} SELECT key, count(*) AS n_records, CAST(sum({SIZE}) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS n_runs FROM log GROUP BY key"),
    ("store_live", lambda s, d: _text(_store(s, d)[0].live()), f"WITH {LOG} SELECT key, value FROM {_newest()} WHERE op = 0"),
    ("store_as_of", _store_as_of, f"WITH {LOG} SELECT key, value FROM {_newest(where=f'ts <= {T}')} WHERE op = 0"),
]
