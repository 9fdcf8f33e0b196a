import pytest
from pyspark.sql import functions as F

from tidemark.operators import gc, resolve
from tidemark.operators.layout import LevelPolicy, plan, sparse_index
from tidemark.sources.store import Config, Conflict, Store
from tidemark.streaming.ingest import ingest


def frame(spark, *pairs):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in pairs], "key binary, value binary")


def keys(spark, *ks):
    return spark.createDataFrame([(bytearray(k),) for k in ks], "key binary")


def state(df):
    return {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}


def test_store_life(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store.create(spark, path, Config())
    with pytest.raises(FileExistsError):
        Store.create(spark, path)
    t1 = store.put(frame(spark, (b"a", b"1"), (b"b", b"1"), (b"", b""), (b"\x00\xff", b"x")))
    t2 = store.put(frame(spark, (b"a", b"2")))
    t3 = store.delete(keys(spark, b"b", b"zz"))
    assert t1 < t2 < t3
    want = {b"a": b"2", b"": b"", b"\x00\xff": b"x"}
    assert state(store.live()) == want
    assert state(store.as_of(t1))[b"a"] == b"1" and store.get(b"a", t2 - 1) == b"1"
    assert store.as_of(t1 - 1).count() == 0
    assert store.get(b"b") is None and store.get(b"b", t2) == b"1" and store.get(b"") == b""
    store.persist()
    assert not store.manifest().active and len(store.manifest().runs) == 1
    assert state(Store.load(spark, path).live()) == want
    with store.snapshot() as snap:
        store.put(frame(spark, (b"a", b"3")))
        store.persist()
        assert state(snap.read()) == want
        assert store.watermark() == snap.ts
        store.compact(0)
        assert state(snap.read()) == want and state(store.live())[b"a"] == b"3"
        assert state(store.as_of(snap.ts)) == want
    store.put(frame(spark, (b"a", b"4")))
    store.persist()
    store.compact(0)
    store.compact(1)
    assert store.compact(7) == []
    store.vacuum()
    assert state(Store.load(spark, path).live())[b"a"] == b"4"
    assert store.range_scan(b"a", b"a").count() == 1 and store.history().where("valid_to is null").count() == 5
    got = {bytes(r["key"]): r["found"] for r in store.multi_get(keys(spark, b"a", b"b", b"no")).collect()}
    assert got == {b"a": True, b"b": False, b"no": False}


def test_transactions(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store.create(spark, path)
    store.put(frame(spark, (b"k", b"tree"), (b"d", b"1")))
    one, two, lost = store.transaction(), store.transaction(), store.transaction()
    store.put(frame(spark, (b"new", b"n")))
    one.put(b"k", b"x")
    one.put(b"k", b"one")
    one.delete(b"d")
    two.put(b"k", b"two")
    lost.put(b"k", b"lost")
    assert one.get(b"k") == b"one" and one.get(b"d") is None and one.get(b"new") is None and two.get(b"d") == b"1"
    assert store.get(b"k") == b"tree"
    one.commit()
    assert store.get(b"k") == b"one" and two.get(b"k") == b"two"
    two.commit()
    lost.rollback()
    late = store.transaction()
    late.put(b"k", b"late")
    store.put(frame(spark, (b"k", b"now")))
    with pytest.raises(Conflict):
        late.commit(check_conflicts=True)
    assert state(Store.load(spark, path).live()) == {b"k": b"now", b"new": b"n"}
    store.persist()
    assert state(Store.load(spark, path).live()) == {b"k": b"now", b"new": b"n"}
    assert store.manifest().snapshots == {}


def test_auto_maintenance(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "m"), Config(freeze_size=1, auto=True, max_runs=(1, 1, 9)))
    for i in range(4):
        store.put(frame(spark, (b"k%d" % (i % 2), b"v%d" % i)))
    assert state(store.live()) == {b"k0": b"v2", b"k1": b"v3"}
    assert any(r["level"] > 0 for r in store.manifest().runs)
    assert store.flush() is None and not store.freeze(force=True)


def test_gc_keeps_every_snapshot(spark):
    log = spark.createDataFrame([(k, t, int(t % 5 == 0), None if t % 5 == 0 else f"v{t}") for k in "abc" for t in range(1, 21)], "key string, ts long, op int, value string")
    for w in (1, 5, 10, 21):
        small = gc.compact(log, w)
        for t in range(w, 22):
            assert sorted(resolve.as_of(small, t).collect()) == sorted(resolve.as_of(log, t).collect())
    pieces = gc.split_runs(log, 60).groupBy("run_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    spans = sorted((r["lo"], r["hi"]) for r in pieces)
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_edges(spark):
    empty = spark.createDataFrame([], "key string, ts long, op int, value string")
    assert resolve.live(empty).count() == 0 and gc.compact(empty, 3).count() == 0
    one = spark.createDataFrame([("a", 3, 0, None)], "key string, ts long, op int, value string")
    assert resolve.as_of(one, 3).count() == 1 and resolve.as_of(one, 2).count() == 0
    probes = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), (None, 3, 3), ("a", None, 4)], "key string, t long, n int")
    assert {r["n"]: r["found"] for r in resolve.as_of_join(one, probes).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_plan():
    assert plan({0: 33, 1: 32}, LevelPolicy()) == [(0, 1), (1, 2)]
    assert plan({0: 32}, LevelPolicy()) == []


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, bytearray(b"a"), 0, bytearray(b"1")), (2, bytearray(b"a"), 0, bytearray(b"2")), (3, bytearray(b"b"), 1, None)], "seq long, key binary, op int, value binary").write.parquet(src)
    store = Store.create(spark, str(tmp_path / "st"))
    stream = spark.readStream.schema("seq long, key binary, op int, value binary").parquet(src)
    ingest(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert state(store.live()) == {b"a": b"2"}


def test_vacuum_keeps_what_open_snapshots_read(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "v"))
    store.put(frame(spark, (b"a", b"1")))
    store.persist()
    with store.snapshot() as snap:
        t = store.put(frame(spark, (b"a", b"2")))
        store.persist()
        assert len(store.as_of(t - 1).inputFiles()) < len(store.as_of(t).inputFiles()) and state(store.as_of(t - 1)) == {b"a": b"1"}
        store.compact(0)
        store.vacuum()
        assert state(snap.read()) == {b"a": b"1"}
    store.vacuum()
    assert state(Store.load(spark, str(tmp_path / "v")).live()) == {b"a": b"2"} and store.manifest().pinned == {}


def test_left_files_of_dead_writers_and_taken_names(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "_temp.dead").write_text("{")
    (tmp_path / "d" / "_lock.manifest-00000001.json").write_text("")
    assert store.put(frame(spark, (b"a", b"1"))) == 2 and store.get(b"a") == b"1"
    assert not store.folder.write_json("manifest-00000001.json", {}) and store.manifest().version == 1


def test_keys_are_unique_in_a_commit(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "u"))
    with pytest.raises(ValueError):
        store.put(frame(spark, (b"a", b"1"), (b"a", b"2")))
    assert store.live().count() == 0 and store.manifest().active == []


def test_dropped_transactions(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "x"))
    store.put(frame(spark, (b"a", b"1")))
    with store.transaction() as t:
        t.put(b"a", b"2")
        t.delete(b"b")
        assert t.get(b"a") == b"2" and t.get(b"b") is None and t.get(b"no") is None
    with pytest.raises(KeyError), store.transaction() as t:
        raise KeyError
    assert store.manifest().snapshots == {} and store.get(b"a") == b"1"


def test_streams_commit_a_batch_once(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "b"))
    rows = spark.createDataFrame([(bytearray(b"a"), 0, bytearray(b"1"))], "key binary, op byte, value binary")
    assert store._append(rows, ("s", 0)) == 2 and store._append(rows, ("s", 0)) is None and store._append(rows, ("t", 0)) == 3


def test_bloom_codec(spark):
    from tidemark.functions import bloom

    made = bloom.build(spark.range(5000).select(F.concat(F.lit("key_"), "id").alias("k")), "k", 5000, 0.01)
    stored = bloom.encode(made)
    assert sorted(bloom.decode(stored).collect()) == sorted(made.collect())
    probes = spark.range(4000, 15000).select("id", F.concat(F.lit("key_"), "id").alias("k"))
    hit = bloom.might_contain(probes, "k", bloom.decode(stored), 5000, 0.01)
    assert hit.where("id < 5000 and not might_contain").count() == 0 and hit.where("id >= 5000 and might_contain").count() < 300
    with pytest.raises(Exception, match="checksum"):
        bloom.decode(stored.withColumn("mask", F.col("mask") + 1)).collect()


def test_compaction_cuts_runs_by_size(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "c"), Config(level_0_bytes=600, multiplier=1))
    want = {b"k%03d" % i: b"v" * 40 for i in range(100)}
    store.put(frame(spark, *want.items()))
    store.persist()
    store.delete(keys(spark, b"k000", b"k050"))
    store.persist()
    store.compact(0)
    runs = store.manifest().runs
    assert len(runs) > 3 and sum(r["rows"] for r in runs) == 102
    assert all(a["max_key"] < b["min_key"] for a, b in zip(runs, runs[1:]))
    want = {k: v for k, v in want.items() if k not in (b"k000", b"k050")}
    assert store.vacuum() and state(store.live()) == want and store.get(b"k051") == b"v" * 40 and store.get(b"k050") is None
    for _ in range(2):  # the last commit is behind the watermark once the clock has gone on
        with store.snapshot():
            pass
    store.compact(1, purge_tombs=True)
    assert store.log().where("op = 1").count() == 0 and state(store.live()) == want


def test_tombs_stay_above_older_runs(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "p"))
    store.put(frame(spark, (b"a", b"1")))
    store.persist()
    store.compact(0)
    store.delete(keys(spark, b"a"))
    store.persist()
    for _ in range(2):
        with store.snapshot():
            pass
    store.compact(0, purge_tombs=True)
    assert store.log().where("op = 1").count() == 1 and store.get(b"a") is None


def test_auto_flush_waits_for_its_size(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "w"), Config(freeze_size=1, flush_size=10, auto=True))
    for n, runs in ((1, 0), (2, 0), (3, 1)):
        store.put(frame(spark, (b"k%d" % n, b"vv")))
        assert len(store.manifest().runs) == runs


def test_sparse_index_of_spread_runs(spark):
    rows = [(k, f"k{t % n:03d}", t, int(t % 9 == 0), None if t % 9 == 0 else "v" * (t % 13)) for k, n in (("one", 1), ("many", 90), (None, 7)) for t in range(700)]
    log = spark.createDataFrame(rows, "run_id string, key string, ts long, op int, value string")
    got = {(r["run_id"], r["block"]): (r["offset"], r["first_key"], r["first_ts"]) for r in sparse_index(log, 200, tasks=12).collect()}
    want = {}
    for run in ("one", "many", None):
        at = 0
        for _, k, t, op, v in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], -r[2])):
            want.setdefault((run, at // 200), (at, k, t))
            at += 11 + len(k) if op else 13 + len(k) + len(v)
    assert got == want
    assert sparse_index(log.limit(0), 200).count() == 0
