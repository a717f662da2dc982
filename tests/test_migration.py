"""Shard maps, topologies, plans, their execution, checkpoints, and the live extension."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import MigrationError, StoreError, TopologyError
from tessera.operators import topology
from tessera.plans import migration as M
from tessera.sources.checkpoint import CheckpointStore, MemoryCheckpoints, decoded, encoded
from tessera.sources.shard_map import MapStore, enumerate_map
from tessera.streaming import events

KEYS = "shard_key string, shard_id string"


def table(spark, **assigned):
    return spark.createDataFrame(list(assigned.items()), KEYS)


def pairs(df):
    return {r["shard_key"]: r["shard_id"] for r in df.collect()}


def test_store(spark, tmp_path):
    store = MapStore(spark, f"file://{tmp_path}")
    assert store.rows().count() == 0
    assert [r["created"] for r in store.try_assign(table(spark, a="s1", b="s2")).collect()] == [True, True]
    again = store.try_assign(table(spark, b="s9", c="s3"))
    assert pairs(again) == {"b": "s2", "c": "s3"}
    store.assign(table(spark, a="s5"))
    assert pairs(store.rows()) == {"a": "s5", "b": "s2", "c": "s3"}
    assert [r["shard_key"] for r in enumerate_map(store.rows()).collect()] == ["a", "b", "c"]
    changed = store.history().head()
    assert (changed["old_shard_id"], changed["new_shard_id"]) == ("s1", "s5")
    with pytest.raises(StoreError):
        MapStore(spark, "x", name="drop table")


def test_store_survives_a_stopped_writer(spark, tmp_path):
    seen = []
    store = MapStore(spark, f"file://{tmp_path}", on_change=lambda df: seen.append(df.count()))
    for i in range(6):
        store.assign(table(spark, a=f"s{i}", b="s0"))
    assert seen == [2, 1, 1, 1, 1, 1] and pairs(store.rows()) == {"a": "s5", "b": "s0"}
    assert len(list((tmp_path / "shard_map_versions").iterdir())) == MapStore.KEPT
    spark.createDataFrame([("x", "y")], KEYS).write.parquet(str(tmp_path / "shard_map_versions" / "torn"))  # written, never pointed to
    assert pairs(store.rows()) == {"a": "s5", "b": "s0"}
    other = MapStore(spark, f"file://{tmp_path}")
    held, other._pointers = other._pointers(), lambda: held[:-1]
    with pytest.raises(StoreError, match="another writer"):
        other.assign(table(spark, a="s9"))
    assert pairs(store.rows())["a"] == "s5"
    for f in (tmp_path / "shard_map_pointers").iterdir():
        f.unlink()
    with pytest.raises(StoreError, match="no pointer"):
        store.rows()


def test_topology(spark):
    rows = spark.createDataFrame([(f"k{i}", f"s{i % 2}") for i in range(10)], KEYS)
    assert topology.validate(rows) == (10, {"s0": 5, "s1": 5})
    with pytest.raises(TopologyError):
        topology.validate(rows.unionByName(rows.limit(1)))
    with pytest.raises(TopologyError, match="Snapshot key cap"):
        topology.snapshot(rows, 9)
    with pytest.raises(ValueError):
        topology.snapshot(rows, 0)
    shuffled = rows.orderBy(F.desc("shard_key"))
    for digest in (topology.fingerprint, topology.fingerprint_tree):
        a, b = digest(rows).head()[0], digest(shuffled).head()[0]
        assert a == b and len(a) == 64 and a == a.upper()
    assert topology.rebalance(rows, lambda k: F.lit("s0"), only_changes=True).count() == 5


def test_plan(spark):
    source, target = table(spark, a="s1", b="s2", c="s1"), table(spark, a="s2", b="s1", c="s2")
    plan = M.plan(source, target)
    first = [(r["ord"], r["shard_key"]) for r in plan.orderBy("ord").collect()]
    assert [o for o, _ in first] == [0, 1, 2] and first[2][1] == "b"
    assert first == [(r["ord"], r["shard_key"]) for r in M.plan(source, target).orderBy("ord").collect()]
    assert M.moves(table(spark, k1="s1", k2="s1"), table(spark, k1="s2")).count() == 1
    many = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("shard_key"), F.lit("0").alias("shard_id"), "id")
    to = many.withColumn("shard_id", F.when(F.col("id") % 3 == 0, "1").otherwise("0"))
    assert tuple(M.dry_run(many, to).head()) == (1000, 334)


@pytest.mark.parametrize("size", [0, 1, 12])
def test_execution_is_idempotent(spark, size):
    rows = spark.range(size).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("v"))
    stored = rows.select(F.col("id").alias("shard_key"), F.lit("a").alias("shard_id"))
    found = M.plan(stored, stored.withColumn("shard_id", F.lit("b")))
    for _ in range(2):
        found, target, stored = M.execute(found, rows, rows.limit(0), stored, "id")
        assert tuple(M.summary(found).head()) == (size, size, 0)
        assert {r["shard_id"] for r in stored.collect()} <= {"b"}


def test_missing_rows_fail(spark):
    rows = spark.createDataFrame([("k1", "x")], "id string, v string")
    found = M.plan(table(spark, k1="a", k2="a"), table(spark, k1="b", k2="b"))
    done, target, stored = M.execute(found, rows, rows.limit(0), table(spark, k1="a", k2="a"), "id")
    assert {r["shard_key"]: r["state"] for r in done.collect()} == {"k1": "Done", "k2": "Failed"}
    assert pairs(stored) == {"k1": "b", "k2": "a"} and target.count() == 1
    with pytest.raises(MigrationError):
        M.copy_rows(rows, rows.drop("v"), found, "id")


def test_execution_in_batches(spark):
    rows = spark.range(25).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("v"))
    stored = rows.select(F.col("id").alias("shard_key"), F.lit("a").alias("shard_id"))
    found, events, saved = M.plan(stored, stored.withColumn("shard_id", F.lit("b"))), [], []

    def observer(p):
        events.append(p)
        raise OSError("an observer's trouble must not stop the run")

    options = M.Options(batch_moves=10, progress_s=0, checkpoint_s=0)
    done, target, new = M.execute(found, rows, rows.limit(0), stored, "id", options, observer=observer, checkpoint=lambda df: saved.append(df.count()))
    assert tuple(M.summary(done, 1.5).head()) == (25, 25, 0, 1.5) and target.count() == 25 and {r[0] for r in new.select("shard_id").collect()} == {"b"}
    assert [(p.stage, p.batch, p.swapped) for p in events][2::3] == [("swap", 0, 10), ("swap", 1, 20), ("swap", 2, 25)] and saved == [25] * 9
    slow = M.Options(batch_moves=10, progress_s=1e9, checkpoint_s=1e9)
    events.clear()
    M.execute(found, rows, rows.limit(0), stored, "id", slow, observer=events.append)
    assert [p.swapped for p in events] == [0, 25]  # the first, and the last by force
    with pytest.raises(MigrationError):
        M.execute(found, rows, rows.limit(0).drop("v"), stored, "id")


def test_columns_are_compared_in_one_order(spark):
    source = spark.createDataFrame([("a", "1", 2)], "id string, v string, w int")
    target = source.select("w", "id", "v")
    found = spark.createDataFrame([("a",)], "shard_key string")
    for how in (M.Verification.FULL, M.Verification.CHECKSUM, M.Verification.PRESENT):
        assert M.verified(found, source, target, "id", how).head()["verified"]
    renamed = source.select("id", F.upper("v").alias("label"))
    assert M.verified(found, source, renamed, "id", project=lambda df: df.select("id", F.upper("v").alias("label"))).head()["verified"]
    with pytest.raises(MigrationError):
        M.verified(found, source, renamed, "id")


def test_verification(spark):
    schema = "id string, v string, row_version binary"
    source = spark.createDataFrame([("a", "1", b"1"), ("b", "2", None), ("c", "3", b"3"), ("d", "4", b"4")], schema)
    target = spark.createDataFrame([("a", "1", b"1"), ("b", "2", None), ("c", "9", b"9")], schema)
    found = spark.createDataFrame([(k,) for k in "abcd"], "shard_key string")
    run = lambda **how: {r["shard_key"]: r["verified"] for r in M.verified(found, source, target, "id", **how).collect()}
    assert run(how=M.Verification.ROW_VERSION) == {"a": True, "b": False, "c": False, "d": False}
    assert run(how=M.Verification.WEAK) == {"a": True, "b": True, "c": False, "d": False}
    assert run(how=M.Verification.CHECKSUM) == {"a": True, "b": True, "c": False, "d": False}
    assert run(how=M.Verification.FULL) == {"a": True, "b": True, "c": False, "d": False}
    assert all(run(force=True).values())


def test_schedules():
    assert [M.retry_delay_ms(a) for a in (1, 2, 7, 8)] == [100, 200, 6400, 10_000]
    with pytest.raises(ValueError):
        M.retry_delay_ms(0)
    with pytest.raises(ValueError):
        M.Options(base_delay_ms=0)
    governor = M.BudgetGovernor()
    assert governor.report(600, 0) == 192 and governor.report(10, 0) == 211


def test_retries():
    tries, pauses = [], []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert M.retried(run, sleep=pauses.append) == "done" and pauses == [0.1, 0.2]
    with pytest.raises(MigrationError):
        M.retried(lambda: 1 / 0, M.Options(max_retries=1), sleep=pauses.append)


def test_memory_checkpoints(spark):
    store = MemoryCheckpoints()
    assert store.load("p") is None
    store.persist("p", spark.range(1))
    assert store.load("p").count() == 1


def test_checkpoints(spark, tmp_path):
    moves = spark.createDataFrame([("a", 0, "Done"), ("b", 1, "Planned")], "shard_key string, ord long, state string")
    store = CheckpointStore(spark, f"file://{tmp_path}/checkpoints")
    assert store.load("p") is None
    now = F.lit("2024-01-01").cast("timestamp")
    store.persist(encoded(moves, "p", 1, now))
    store.persist(encoded(moves.withColumn("state", F.lit("Done")), "p", 2, now))
    assert {r["state"] for r in decoded(store.load("p")).collect()} == {"Done"}
    store.persist(encoded(moves, "p", 3, now).where("part % 2 = 0"))  # torn: parts are missing
    assert {(r["version"], r["shard_key"], r["last_index"]) for r in decoded(store.load("p")).collect()} == {(2, "a", 1), (2, "b", 1)}
    assert store.load("q") is None


def test_live_events(spark, tmp_path):
    source = spark.range(40).select((F.col("id") % 8).alias("user_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"))
    source.write.parquet(str(tmp_path / "events"))
    live = events.routed(events.read(spark, str(tmp_path / "events"), "user_id long, ts timestamp"), "user_id", ["s0", "s1"])
    store = MapStore(spark, f"file://{tmp_path}/map")
    running = events.keep_map(live, "user_id", store, str(tmp_path / "progress"))
    running.awaitTermination(60)
    assert store.rows().count() == 8
    counted = events.windowed(events.routed(source, "user_id", ["s0", "s1"]), "ts")
    assert counted.agg(F.sum("n")).head()[0] == 40
