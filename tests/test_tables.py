"""Fan-out, targets, merges, policies."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import metrics
from tessera.errors import AllShardsFailed, InsufficientHealthyShards, OrderingNotSupported, QueryError, RoutingError, StoreError
from tessera.fixtures import Skew, schedule, shuffled, skewed_rows
from tessera.metrics import Latencies, collect, described
from tessera.operators import health, merge, terminals
from tessera.operators.health import HealthPolicy, fold
from tessera.operators.ring import RouterOptions, router
from tessera.plans.table import Client, ShardedTable, isolated, query
from tessera.sources.registry import Registry, files, jdbc, next_page_size, oscillates, rows
from tessera.sources.shard_map import MapStore
from tessera.staging import discard, shared_dir, staged

PEOPLE = {"0": [(1, "Alice", 30), (2, "Bob", 25)], "1": [(3, "Carol", 40)], "2": [(4, "Dave", 35), (5, "Eve", 22)]}
SCHEMA = "id int, name string, age int"


@pytest.fixture()
def people(spark):
    return ShardedTable.union({k: spark.createDataFrame(v, SCHEMA) for k, v in PEOPLE.items()}, "people")


def names(df):
    return {r["name"] for r in df.collect()}


def test_where_and_select(people):
    assert names(people.where(F.col("age") >= 30).select("name").rows()) == {"Alice", "Carol", "Dave"}
    assert names(Client(people).query(F.col("age") >= 30, ["name"]).rows()) == {"Alice", "Carol", "Dave"}


def test_steps_do_not_change_the_table(people):
    people.where(F.col("age") > 100)
    assert people.rows().count() == 5


def test_targets(people):
    table = people.where_shard("2", "99", "-1", "0", "2")
    assert table.targets().ids == ("0", "2") and table.targets().invalid == 2
    assert names(table.rows()) == {"Alice", "Bob", "Dave", "Eve"}
    assert people.where_shard("9").rows().count() == 0
    assert people.where_shard("9").where_shard().rows().count() == 5


def test_other_branches_are_pruned(people):
    plan = people.where_shard("1").rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_predicates_must_be_columns(people):
    with pytest.raises(QueryError):
        people.where(lambda r: r.age > 3)


def test_projection_is_needed_where_columns_differ(people):
    assert query(people, result=["id", "name", "age"]).rows().count() == 5
    with pytest.raises(QueryError) as e:
        query(people, result=["name"])
    assert e.value.context["phase"] == "Projection"


def test_later_projections_compose(people):
    table = people.select("name", (F.col("age") + 1).alias("older")).select("older")
    assert table.rows().columns == ["older"]


def test_by_column_and_by_key(spark):
    table = ShardedTable.by_column(spark.range(100).withColumnRenamed("id", "k"), F.pmod("k", F.lit(4)), 4)
    assert table.where_shard("3").rows().count() == 25
    assert table.where_key(F.col("k"), lambda k: F.pmod(k, F.lit(4)), 42).rows().select("k").collect()[0][0] == 42


def test_strict_tables_refuse_order(people):
    from dataclasses import replace

    with pytest.raises(OrderingNotSupported):
        replace(people, strict=True).order_by("age")
    assert [r["age"] for r in people.order_by("age").collect()] == [22, 25, 30, 35, 40]
    shape = people.where(F.col("age") > 1).select("name").shape()
    assert (shape.source, shape.predicates, shape.has_projection) == ("people", 1, True)


@pytest.mark.parametrize(("shards", "down", "want"), [
    ([[1, 4, 9], [2, 3, 10], [5, 6, 7, 8]], False, list(range(1, 11))),
    ([[9, 4, 1], [10, 3, 2], [8, 7, 6, 5]], True, list(range(10, 0, -1))),
])
def test_ordered_merge(spark, shards, down, want):
    table = ShardedTable.union({str(i): spark.createDataFrame([(v, p) for p, v in enumerate(s)], "v int, seq int") for i, s in enumerate(shards)})
    assert [r["v"] for r in merge.ordered(table.rows(), "v", "seq", down).collect()] == want


def test_ties_go_by_shard(spark):
    shards = [[1, 2, 2, 2, 5], [1, 2, 4], [2, 3, 5]]
    table = ShardedTable.union({str(i): spark.createDataFrame([(v, p) for p, v in enumerate(s)], "v int, seq int") for i, s in enumerate(shards)})
    up = [(r["v"], r["shard_index"]) for r in merge.ordered(table.rows(), "v", "seq").collect()]
    assert up == sorted(up)
    down = [(r["v"], r["shard_index"]) for r in merge.ordered(table.rows(), "v", "seq", True).collect()]
    assert down == sorted(down, reverse=True)
    ranks = merge.ranked(table.rows(), merge.order("v", "seq")).orderBy("rank").collect()
    assert [(r["v"], r["shard_index"]) for r in ranks] == up and [r["rank"] for r in ranks] == list(range(1, 12))
    assert merge.top(table.rows(), "v", "seq", 2, True).count() == 2


def test_terminals(spark, people):
    df = people.rows()
    assert terminals.count(df).head()["n"] == 5 and terminals.any_rows(df).head()["found"]
    assert not terminals.any_rows(df.where("age > 99")).head()["found"]
    assert terminals.first_or_raise(df, "age")["name"] == "Eve" and len(list(terminals.stream(df))) == 5
    assert terminals.first_or_none(df.where("age > 99")) is None
    with pytest.raises(QueryError):
        terminals.first_or_raise(df.where("age > 99"))


def test_registry(spark, tmp_path):
    registry = Registry.of({k: rows(v, SCHEMA) for k, v in PEOPLE.items()})
    with pytest.raises(StoreError):
        registry.add("0", rows([], SCHEMA))
    with pytest.raises(KeyError):
        registry.get("7")
    with pytest.raises(ValueError):
        Registry().add_many(0, lambda i: rows([], SCHEMA))
    with pytest.raises(ValueError):
        registry.add(" ", rows([], SCHEMA))
    with registry.use(spark, "1") as df:
        assert df.count() == 1
    registry.add("lost", files(str(tmp_path / "none")))
    assert ShardedTable.open(spark, registry, best_effort=True).rows().count() == 5
    with pytest.raises(Exception):
        ShardedTable.open(spark, registry)
    with pytest.raises(AllShardsFailed):
        ShardedTable.open(spark, Registry().add("lost", files(str(tmp_path / "none"))), best_effort=True)


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_sources(spark, tmp_path, kind):
    spark.createDataFrame(PEOPLE["0"], SCHEMA).write.format(kind).option("header", "true").save(str(tmp_path / kind))
    assert names(files(str(tmp_path / kind), kind, header="true")(spark)) == {"Alice", "Bob"}


def test_health(spark, people):
    reports = lambda *s: spark.createDataFrame([(str(i), x) for i, x in enumerate(s)], "shard_id string, status string")
    asked = people.where_shard("0", "1", "2")
    one_bad = reports("Healthy", "Unhealthy", "Healthy")
    assert health.gated(asked, one_bad).targets().ids == ("0", "2")
    assert health.gated(asked, one_bad, health.Behaviour.INCLUDE) is asked
    assert health.gated(people, one_bad) is people
    assert health.gated(people, one_bad, gate_all=True).targets().ids == ("0", "2")
    with pytest.raises(InsufficientHealthyShards) as e:
        health.gated(asked, one_bad, health.Behaviour.QUARANTINE)
    assert (e.value.total, e.value.healthy, e.value.unhealthy) == (3, 2, ["1"])
    with pytest.raises(InsufficientHealthyShards):
        health.gated(asked, reports("Healthy", "Unhealthy", "Unhealthy"), need=health.Availability(at_least=2))
    assert health.Availability(percentage=0.75).met(3, 4) and not health.ALL_SHARDS.met(3, 4)
    assert health.gated(asked, reports("Unhealthy", "Unhealthy", "Unhealthy")).rows().count() == 0


def test_health_fold(spark):
    seen = [True, False, False, False, True, True, False, True]
    df = spark.createDataFrame([("a", i, i, ok) for i, ok in enumerate(seen)], "shard_id string, ts int, seq int, ok boolean")
    got = [r["status"] for r in health.fold(df).orderBy("seq").collect()]
    assert got == ["Healthy", "Healthy", "Healthy", "Unhealthy", "Unhealthy", "Healthy", "Healthy", "Healthy"]


def test_page_sizes():
    assert next_page_size(64, 10) == 96 and next_page_size(100, 80) == 64 and next_page_size(8000, 1) == 8192
    with pytest.raises(ValueError):
        next_page_size(0, 1)


def test_isolated_shards(people):
    def write(shard_id, df):
        if shard_id == "1":
            raise OSError("lost")
        return df

    got, failed = isolated(people, write)
    assert names(got) == {"Alice", "Bob", "Dave", "Eve"} and list(failed) == ["1"]
    with pytest.raises(AllShardsFailed):
        isolated(people.where_shard("1"), write)


def test_probing(spark, tmp_path):
    registry = Registry.of({"a": rows(PEOPLE["0"], SCHEMA), "b": files(str(tmp_path / "none"))})
    assert {r["shard_id"]: r["status"] for r in health.probed(spark, registry).collect()} == {"a": "Healthy", "b": "Unhealthy"}
    assert health.always_healthy(spark, ["a", "b"]).count() == 2
    assert oscillates([0, 1000, 2000, 3000, 4000, 4500], 4600) and not oscillates([0, 1000], 4600)


def test_observers_cannot_spoil_a_query(people):
    got, record = metrics.collect(people, tag="people", observer=lambda m: 1 / 0)
    assert len(got) == 5 and record.status == "ok"


def test_metrics(people):
    got, record = metrics.collect(people.where(F.col("age") >= 30).where_shard("0", "1", "9"))
    assert len(got) == 2 and record.status == "ok" and record.items == {"0": 1, "1": 1, "2": 0}
    assert (record.targets, record.invalid_targets) == (2, 1)


def test_a_layout_is_pruned(spark, tmp_path):
    rows = spark.range(1000).withColumn("v", F.col("id") * 2)
    table = ShardedTable.by_column(rows, F.pmod("id", F.lit(4)), 4, names=["a", "b", "c", "d"]).lay_out(str(tmp_path / "t"))
    one = table.where_shard("c", "nowhere").select("id", "v").rows()
    assert one.count() == 250 and {r["id"] % 4 for r in one.collect()} == {2}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert table.targets() is None and table.rows().columns == ["id", "v", "shard_id", "shard_index"]


def test_isolated_shards_run_side_by_side(spark):
    import threading

    table = ShardedTable.by_column(spark.range(8), F.pmod("id", F.lit(4)), 4)
    together = threading.Barrier(4, timeout=30)  # passes only if four run at a time

    def write(shard_id, df):
        together.wait()
        return df.limit(10)

    rows, failed = isolated(table, write, at_once=4)
    assert rows.count() == 8 and not failed
    with pytest.raises(ValueError):
        isolated(table, write, at_once=0)


def test_relational_source(spark):
    url = "jdbc:derby:memory:shards;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no database driver here")
    spark.range(20).withColumn("v", F.col("id") % 3).write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    registry = Registry().add_many(2, lambda i: jdbc(url, f"(select * from t where mod(\"id\", 2) = {i}) x", 5, driver=driver))
    found = ShardedTable.open(spark, registry).where(F.col("v") == 1).where_shard("1").select("id").rows()
    assert sorted(r["id"] for r in found.collect()) == [1, 7, 13, 19]
    with pytest.raises(ValueError):
        jdbc(url, "t", 0)


def test_health_policy(spark):
    now, up = [0.0], [True]

    def shard(session):
        if not up[0]:
            raise OSError("down")
        return session.range(1)

    policy = HealthPolicy(spark, Registry().add("a", shard), clock=lambda: now[0], timeout_s=0)
    assert policy.probe().head()["status"] == "Healthy" and policy.due() == []
    up[0] = False
    for _ in range(3):
        now[0] += 30
        policy.probe()
    assert policy.status == {"a": "Unhealthy"} and policy.counters["unhealthy"] == 1
    now[0] += 30
    policy.probe()  # still cooling down
    assert policy.counters["probes"] == 4 and policy.counters["skipped"] == 1
    assert [policy.record("a", True), policy.record("a", True)] == ["Unhealthy", "Healthy"] and policy.counters["recovered"] == 1
    with pytest.raises(ValueError):
        HealthPolicy(spark, Registry(), unhealthy_after=0)


def test_health_fold_does_not_depend_on_pieces(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(40_000), i, rng.random() < 0.5) for i in range(400)]
    probes = spark.createDataFrame(rows, "shard_id string, t long, seq long, ok boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want, state = [], {}
    for shard, _, seq, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        run, status = state.get(shard, (0, "Unknown"))
        run = max(run, 0) + 1 if ok else min(run, 0) - 1
        status = "Unhealthy" if run <= -3 else "Healthy" if run >= 2 or ok and status == "Unknown" else status
        state[shard] = run, status
        want.append((shard, seq, status))
    for piece in (1, 600, 10**9):
        assert sorted((r["shard_id"], r["seq"], r["status"]) for r in fold(probes, piece_s=piece).collect()) == sorted(want)


def test_router(spark, tmp_path):
    options = RouterOptions(store=lambda s: MapStore(s, f"file://{tmp_path}"))
    own = router(spark, ["s0", "s1"], options)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(40)], "shard_key string")
    first = {r["shard_key"]: r["shard_id"] for r in own.route(keys).collect()}
    own.add("s2")
    with pytest.raises(RoutingError):
        own.add("s2")
    again = own.route(keys).collect()
    assert all(r["was_existing"] and r["shard_id"] == first[r["shard_key"]] for r in again)
    assert own.remove("s0") and not own.remove("s9") and own.shards == ["s1", "s2"]
    moved = {r["shard_key"]: r["shard_id"] for r in own.route(keys).collect()}
    assert set(moved.values()) == {"s1", "s2"} and all(moved[k] == s for k, s in first.items() if s == "s1")
    made = router(spark, ["s0"], RouterOptions(router=lambda s, shards, o: (shards, o.replication)))
    assert made == (["s0"], 100)


def test_fixtures(spark):
    assert schedule(3, 2, Skew.HARSH) == [2, 11, 20] and schedule(1, 5) == [5] and schedule(2, 1, Skew.MILD) == [1, 3]
    assert shuffled(range(20), 7) == shuffled(range(20), 7) != list(range(20))
    rows = skewed_rows(spark, 3, 10, Skew.MILD)
    assert {r["shard_index"]: r["count"] for r in rows.groupBy("shard_index").count().collect()} == {0: 10, 1: 20, 2: 30}
    assert rows.select("id").distinct().count() == 60 and rows.agg(F.max("seq")).head()[0] == 29


def test_latencies(spark):
    latencies = Latencies((0, 10_000))
    table = ShardedTable.by_column(spark.range(8), F.pmod("id", F.lit(2)), 2, "numbers").where(F.col("id") > 1)
    for _ in range(2):
        collect(table, observer=latencies.record)
    (tags, counts), = latencies.counts.items()
    assert sum(counts) == 2 and counts[0] == 0 and dict(tags)["predicates"] == 1 and dict(tags)["status"] == "ok"
    with described(spark, "outer"):
        with described(spark, "inner"):
            pass
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "outer"
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Conf:
        def get(self, name, default):
            return default

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(StoreError):
        shared_dir(session)


def test_staged_tables_can_be_removed(spark):
    df = staged(spark.range(5), "numbers")
    assert df.count() == 5
    discard(df, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(df.staged_path).count()
