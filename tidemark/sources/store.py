"""A versioned key-value table in a folder: log segments, levelled Parquet runs, one manifest.

Every change is one new manifest, published by an atomic rename: manifest-<n>.json. Files are
written before the manifest that names them and are deleted only by vacuum(), so a reader or a
crashed writer never meets a half-made state. A commit is durable when it returns.

A write goes to a log segment (Parquet, tagged records), `freeze` closes the active segments,
`flush` replays frozen segments into one sorted run at level 0 and `compact` merges a level into the
next with version garbage collection that respects open snapshots.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.sizing import payload_size, record_size
from tidemark.operators import gc, resolve, txn, wal
from tidemark.operators.layout import LevelPolicy, plan
from tidemark.schema import CHANGE_LOG, LOG_END, LOG_START, LOG_TOMB, LOG_TX_TOMB, LOG_TX_VALUE, LOG_VALUE, TOMB, VALUE, WAL
from tidemark.sources.files import Folder


class Conflict(RuntimeError):
    """Another writer published first, or a checked commit met a later version."""


@dataclass(frozen=True)
class Config:
    """Sizes in bytes; the sums of key and value lengths count. levels besides level 0.

    A compaction into level n cuts its output into runs of about level_0_bytes * multiplier^n encoded bytes that don't
    overlap in key. The default is sized for files of a distributed file system. With `auto`, frozen segments are flushed
    once they hold more than flush_size; at 0 every frozen segment is.
    """

    freeze_size: int = 1 << 20
    flush_size: int = 0
    bloom_fpr: float = 0.01
    bloom_keys: int = 1_000_000
    auto: bool = False
    n_levels: int = 4
    max_runs: tuple[int, ...] = (32, 32, 100_000)
    level_0_bytes: int = 1 << 28
    multiplier: int = 4
    max_records_per_file: int = 5_000_000

    @property
    def policy(self) -> LevelPolicy:
        return LevelPolicy(tuple(self.max_runs), self.level_0_bytes, self.multiplier)


@dataclass
class Manifest:
    version: int = 0
    ts: int = 1
    txn_id: int = 0
    config: dict = field(default_factory=dict)
    active: list[dict] = field(default_factory=list)
    frozen: list[dict] = field(default_factory=list)
    runs: list[dict] = field(default_factory=list)
    snapshots: dict[str, int] = field(default_factory=dict)
    pinned: dict[str, int] = field(default_factory=dict)  # the manifest that each open snapshot reads
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream that was committed


class Store:
    """Handles are cheap: each operation starts from the newest manifest."""

    RETRIES = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | None = None, overwrite: bool = False) -> Store:
        store = cls(spark, path)
        if store.folder.names():
            if not overwrite:
                raise FileExistsError(path)
            store.folder.delete()
        if not store.folder.write_json("manifest-00000000.json", asdict(Manifest(config=asdict(config or Config())))):
            raise Conflict(path)
        return store

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Store:
        store = cls(spark, path)
        store.manifest()
        return store

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Freeze and flush what is in the log; nothing is lost without it."""
        self.freeze(force=True)
        self.flush()

    def manifest(self) -> Manifest:
        names = [n for n in self.folder.names() if n.startswith("manifest-")]
        if not names:
            raise FileNotFoundError(self.path)
        return Manifest(**self.folder.read_json(names[-1]))

    @property
    def config(self) -> Config:
        c = self.manifest().config
        return Config(**c | {"max_runs": tuple(c["max_runs"])})

    def _publish(self, change: Callable[[Manifest], object]) -> object:
        """Apply change to the newest manifest and publish it, again after a lost race."""
        for _ in range(self.RETRIES):
            m = self.manifest()
            out = change(m)
            m.version += 1
            if self.folder.write_json(f"manifest-{m.version:08d}.json", asdict(m)):
                return out
        raise Conflict(f"{self.path}: no manifest published in {self.RETRIES} tries")

    def _tick(self, m: Manifest) -> int:
        m.ts += 1
        return m.ts

    # -- writes

    def put(self, rows: DataFrame) -> int:
        """Upsert (key, value). Returns the commit's timestamp. A key may stand in one row only: a ValueError, and nothing written, if not."""
        return self._append(rows.select("key", F.lit(VALUE).cast("byte").alias("op"), "value"))

    def delete(self, rows: DataFrame) -> int:
        """Tombstones for (key), present or not."""
        return self._append(rows.select("key", F.lit(TOMB).cast("byte").alias("op"), F.lit(None).cast("binary").alias("value")))

    def _append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        tag = F.when(F.col("op") == TOMB, LOG_TOMB).otherwise(LOG_VALUE)
        records = rows.select(F.lit(0).cast("long").alias("lsn"), tag.cast("byte").alias("rec_type"), F.lit(None).cast("long").alias("ts"), F.lit(None).cast("long").alias("txn_id"), "key", "value")
        return self._log(records, batch)

    def _log(self, records: DataFrame, batch: tuple[str, int] | None = None) -> int | None:
        """One segment of records without ts; the ts is the manifest's word, so no reader sees a part of it."""
        name = f"wal/{uuid.uuid4().hex}"
        records.select(*[F.col(f.name).cast(f.dataType) for f in WAL]).write.parquet(f"{self.path}/{name}")
        size = self.spark.read.schema(WAL).parquet(f"{self.path}/{name}").agg(F.coalesce(F.sum(payload_size(F.coalesce("key", F.lit(b"")), F.col("value"))), F.lit(0)), F.count(F.lit(1))).first()

        again = self.spark.read.schema(WAL).parquet(f"{self.path}/{name}").where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not again.isEmpty():
            self.folder.delete(name)
            raise ValueError("a key stands in several rows of one commit")

        def change(m: Manifest) -> int | None:
            if batch and m.batches.get(batch[0], -1) >= batch[1]:
                return None  # this batch was committed before its stream failed
            ts = self._tick(m)
            if batch:
                m.batches[batch[0]] = batch[1]
            m.active.append({"path": name, "ts": ts, "bytes": size[0], "rows": size[1]})
            return ts

        ts = self._publish(change)
        if self.config.auto:
            self.freeze()
            self.flush(force=False)
            self.compact()
        return ts

    # -- reads

    def wal(self, m: Manifest | None = None) -> DataFrame:
        """The log's records, each with its segment's timestamp."""
        m = m or self.manifest()
        return self._segments(m.frozen + m.active)

    def _segments(self, segments: list[dict]) -> DataFrame:
        """One scan over all segments; their timestamps come from a map by folder name."""
        if not segments:
            return self.spark.createDataFrame([], WAL)
        stamp = F.create_map(*[x for s in segments for x in (F.lit(s["path"].rpartition("/")[2]), F.lit(s["ts"]).cast("long"))])
        folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
        df = self.spark.read.schema(WAL).parquet(*[f"{self.path}/{s['path']}" for s in segments])
        return df.withColumn("ts", F.coalesce("ts", F.element_at(stamp, folder)))

    def log(self, m: Manifest | None = None, key_range: tuple | None = None, ts: int | None = None) -> DataFrame:
        """Every stored version (key, ts, op, value). Runs outside key_range, or that begin after ts, aren't opened."""
        m = m or self.manifest()
        runs = [r for r in m.runs if (key_range is None or _overlaps(r, *key_range)) and (ts is None or r["min_ts"] <= ts)]
        parts = [wal.replay(self.wal(m))] if m.frozen or m.active else []
        if runs:
            parts.append(self.spark.read.schema(CHANGE_LOG).parquet(*[f"{self.path}/{r['path']}" for r in runs]))
        return resolve.union_runs(*parts) if parts else self.spark.createDataFrame([], CHANGE_LOG)

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def as_of(self, ts: int) -> DataFrame:
        return resolve.as_of(self.log(ts=ts), ts)

    def get(self, key: bytes, ts: int | None = None) -> bytes | None:
        """One key, with the predicate pushed to the scan."""
        row = resolve.drop_tombs(resolve.newest(self.log(key_range=(key, key), ts=ts).where(F.col("key") == F.lit(key)), ts)).select("value").first()
        return None if row is None else bytes(row[0])

    def multi_get(self, probes: DataFrame, ts: int | None = None) -> DataFrame:
        return resolve.multi_get(self.log(ts=ts), probes, ts)

    def range_scan(self, low: bytes | None = None, high: bytes | None = None, ts: int | None = None) -> DataFrame:
        return resolve.range_scan(self.log(key_range=(low, high), ts=ts), low, high, ts)

    def history(self) -> DataFrame:
        return resolve.history(self.log())

    # -- snapshots and transactions

    @contextmanager
    def snapshot(self) -> Iterator[Snapshot]:
        """A reader's view: pins a manifest and holds garbage collection back."""
        snap = self._open_snapshot()
        try:
            yield snap
        finally:
            self.release(snap.id)

    def _open_snapshot(self) -> Snapshot:
        mark = uuid.uuid4().hex

        def change(m: Manifest) -> Manifest:
            ts = self._tick(m)
            m.txn_id += 1
            m.snapshots[mark], m.pinned[mark] = ts, m.version + 1
            return m

        m = self._publish(change)
        return Snapshot(self, mark, m.snapshots[mark], m.txn_id, m)

    def release(self, mark: str) -> None:
        if mark in self.manifest().snapshots:
            self._publish(lambda m: (m.snapshots.pop(mark, None), m.pinned.pop(mark, None)))

    def watermark(self, m: Manifest | None = None) -> int:
        m = m or self.manifest()
        return min(m.snapshots.values(), default=m.ts - 1)

    def transaction(self) -> Transaction:
        return Transaction(self, self._open_snapshot())

    # -- maintenance

    def freeze(self, force: bool = False) -> bool:
        """Close the active segments once they hold more than freeze_size, or if forced."""
        most = self.config.freeze_size
        full = lambda m: m.active and (force or sum(s["bytes"] for s in m.active) > most)
        if not full(self.manifest()):
            return False

        def change(m: Manifest) -> bool:
            if full(m):
                m.frozen, m.active = m.frozen + m.active, []
            return True

        return bool(self._publish(change))

    def flush(self, force: bool = True) -> dict | None:
        """Frozen segments to one run at level 0, and out of the log, in one manifest."""
        m = self.manifest()
        if not m.frozen or not force and sum(s["bytes"] for s in m.frozen) <= self.config.flush_size:
            return None
        gone = {s["path"] for s in m.frozen}
        run = self._write_run(wal.replay(self._segments(m.frozen)), 0)

        def change(now: Manifest) -> None:
            if not gone <= {s["path"] for s in now.frozen}:
                raise Conflict("another writer flushed these segments")
            now.frozen = [s for s in now.frozen if s["path"] not in gone]
            now.runs += [run] if run else []

        self._publish(change)
        return run

    def persist(self) -> dict | None:
        self.freeze(force=True)
        return self.flush()

    def compact(self, level: int | None = None, purge_tombs: bool = False) -> list[tuple[int, int]]:
        """The compactions that are due, or the one of a given level, forced.

        purge_tombs drops old tombstones too, in compactions whose target and deeper levels hold no run they could hide.
        """
        m, done = self.manifest(), []
        counts = {n: sum(r["level"] == n for r in m.runs) for n in range(self.config.n_levels)}
        for a, b in [(level, level + 1)] if level is not None else plan(counts, self.config.policy):
            if self._compact(a, b, purge_tombs):
                done.append((a, b))
        return done

    def _compact(self, a: int, b: int, purge_tombs: bool = False) -> bool:
        m = self.manifest()
        runs = [r for r in m.runs if r["level"] == a]
        if not runs or b >= self.config.n_levels:
            return False
        mark = self.watermark(m)
        purge = purge_tombs and not any(r["level"] >= b for r in m.runs)
        df = self.spark.read.schema(CHANGE_LOG).parquet(*[f"{self.path}/{r['path']}" for r in runs])
        new = self._write_runs(gc.compact(df, mark, purge), b)
        gone = {r["path"] for r in runs}

        def change(now: Manifest) -> None:
            if not gone <= {r["path"] for r in now.runs}:
                raise Conflict("another writer compacted these runs")
            if any(ts < mark for ts in now.snapshots.values()):
                raise Conflict("an older snapshot was opened meanwhile")
            if purge and any(r["level"] >= b for r in now.runs):
                raise Conflict("older runs came below meanwhile")
            now.runs = [r for r in now.runs if r["path"] not in gone] + new

        self._publish(change)
        return True

    def _writer(self, df: DataFrame) -> DataFrameWriter:
        c = self.config
        return (
            df.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(c.bloom_fpr))
            .option("parquet.bloom.filter.expected.ndv#key", str(c.bloom_keys)).option("maxRecordsPerFile", c.max_records_per_file)
        )

    def _columns(self, log: DataFrame) -> DataFrame:
        return log.select(*[F.col(f.name).cast(f.dataType) for f in CHANGE_LOG])

    def _write_run(self, log: DataFrame, level: int) -> dict | None:
        """A sorted run: key ranges, Bloom filter and statistics in the Parquet files."""
        name = f"level_{level}/run_{uuid.uuid4().hex}"
        self._writer(self._columns(log).repartitionByRange("key").sortWithinPartitions("key", F.desc("ts"))).parquet(f"{self.path}/{name}")
        found = self._stats(self.spark.read.schema(CHANGE_LOG).parquet(f"{self.path}/{name}"), level, lambda r: name)
        if not found:
            self.folder.delete(name)
        return found[0] if found else None

    def _write_runs(self, log: DataFrame, level: int) -> list[dict]:
        """Sorted runs of about the level's target bytes, disjoint in key, as folders of one write."""
        name = f"level_{level}/runs_{uuid.uuid4().hex}"
        cut = gc.split_runs(self._columns(log), self.config.policy.target_bytes(level)).sortWithinPartitions("run_id", "key", F.desc("ts"))
        self._writer(cut).partitionBy("run_id").parquet(f"{self.path}/{name}")
        schema = StructType([*CHANGE_LOG, StructField("run_id", LongType())])
        found = self._stats(self.spark.read.schema(schema).parquet(f"{self.path}/{name}"), level, lambda r: f"{name}/run_id={r['run_id']}", "run_id")
        if not found:
            self.folder.delete(name)
        return found

    def _stats(self, df: DataFrame, level: int, path: Callable[[Row], str], *by: str) -> list[dict]:
        """The manifest's entry of every run, read back from what was written."""
        size = record_size(F.col("key"), F.col("value"), F.col("op"))
        stats = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
        ).where("rows > 0").collect()
        return [
            {"path": path(r), "level": level, "rows": r["rows"], "bytes": r["bytes"], "min_key": bytes(r["low"]).hex(), "max_key": bytes(r["high"]).hex(), "min_ts": r["min_ts"], "max_ts": r["max_ts"]}
            for r in sorted(stats, key=lambda r: bytes(r["low"]))
        ]

    def vacuum(self, keep_manifests: int = 1) -> list[str]:
        """Delete files that none of the last manifests names, nor one that an open snapshot reads. Not beside running writers."""
        names = [n for n in self.folder.names() if n.startswith("manifest-")]
        pinned = {f"manifest-{v:08d}.json" for v in self.manifest().pinned.values()}
        last = [n for n in names if n in pinned or n in names[-keep_manifests:]]
        kept = [Manifest(**self.folder.read_json(n)) for n in last]
        used = {"/".join(x["path"].split("/")[:2]) for m in kept for x in m.active + m.frozen + m.runs}
        gone = [n for n in names if n not in last]
        for top in ["wal", *[f"level_{n}" for n in range(self.config.n_levels)]]:
            gone += [p for n in self.folder.names(top) if (p := f"{top}/{n}") not in used]
        for p in gone:
            self.folder.delete(p)
        return gone


def _overlaps(run: dict, low: bytes | None, high: bytes | None) -> bool:
    return (high is None or bytes.fromhex(run["min_key"]) <= high) and (low is None or bytes.fromhex(run["max_key"]) >= low)


@dataclass
class Snapshot:
    """The store at `ts`, as of one manifest: later commits never show."""

    store: Store
    id: str
    ts: int
    txn_id: int
    manifest: Manifest

    def log(self) -> DataFrame:
        return self.store.log(self.manifest)

    def read(self) -> DataFrame:
        return resolve.as_of(self.store.log(self.manifest, ts=self.ts), self.ts)


class Transaction:
    """Snapshot isolation with buffered writes. Without commit() nothing of it is ever stored.

    Single operations are buffered on the driver; batches stay DataFrames. As a context manager it is rolled back
    at the end of the block unless it was committed.
    """

    def __init__(self, store: Store, snapshot: Snapshot):
        self.store, self.snapshot, self._seq = store, snapshot, 0
        self._rows: list[tuple] = []
        self._frames: list[DataFrame] = []
        self.open = True

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, *exc) -> None:
        if self.open:
            self.rollback()

    def _next(self) -> int:
        if not self.open:
            raise RuntimeError("the transaction is over")
        self._seq += 1
        return self._seq

    def put(self, key: bytes, value: bytes) -> None:
        self._rows.append((self._next(), bytearray(key), VALUE, bytearray(value)))

    def delete(self, key: bytes) -> None:
        self._rows.append((self._next(), bytearray(key), TOMB, None))

    def put_all(self, rows: DataFrame) -> None:
        self._frames.append(rows.select(F.lit(self._next()).cast("long").alias("seq"), F.col("key").cast("binary").alias("key"), F.lit(VALUE).cast("byte").alias("op"), F.col("value").cast("binary").alias("value")))

    def delete_all(self, rows: DataFrame) -> None:
        self._frames.append(rows.select(F.lit(self._next()).cast("long").alias("seq"), F.col("key").cast("binary").alias("key"), F.lit(TOMB).cast("byte").alias("op"), F.lit(None).cast("binary").alias("value")))

    def writes(self) -> DataFrame:
        small = self.store.spark.createDataFrame(self._rows, "seq long, key binary, op byte, value binary")
        return txn.write_set(resolve.union_runs(small, *self._frames))

    def read(self) -> DataFrame:
        return txn.overlay(self.snapshot.read(), self.writes())

    def get(self, key: bytes) -> bytes | None:
        """The key's own write, else its snapshot's value: one key is looked up, on both sides."""
        mine = self.writes().where(F.col("key") == F.lit(key)).select("op", "value").first()
        if mine is not None:
            return None if mine["op"] == TOMB else bytes(mine["value"])
        log = self.store.log(self.snapshot.manifest, key_range=(key, key), ts=self.snapshot.ts).where(F.col("key") == F.lit(key))
        row = resolve.as_of(log, self.snapshot.ts).select("value").first()
        return None if row is None else bytes(row[0])

    def rollback(self) -> None:
        self.open = False
        self.store.release(self.snapshot.id)

    def commit(self, check_conflicts: bool = False) -> int:
        """Publish at one timestamp. The last committer of a key wins, unless conflicts are checked."""
        self._next()
        writes = self.writes()
        if check_conflicts and (hit := txn.conflicts(self.store.log(), writes, self.snapshot.ts).first()):
            self.rollback()
            raise Conflict(f"key {bytes(hit['key'])!r} was written at {hit['conflict_ts']}")
        tx = self.snapshot.txn_id
        tag = F.when(F.col("op") == TOMB, LOG_TX_TOMB).otherwise(LOG_TX_VALUE).cast("byte")
        rows = writes.select(F.lit(2).cast("long").alias("lsn"), tag.alias("rec_type"), F.lit(None).cast("long").alias("ts"), F.lit(tx).cast("long").alias("txn_id"), "key", "value")
        marks = self.store.spark.createDataFrame([(1, LOG_START, None, tx, None, None), (3, LOG_END, None, tx, None, None)], WAL)
        ts = self.store._log(marks.unionByName(rows))
        self.rollback()
        return ts
