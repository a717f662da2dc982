"""Golden hash values, and the ring's known distribution."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import RoutingError
from tessera.functions import hashing as H
from tessera.operators import ring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(("key", "want"), [("user-123", 3754352380), ("k0", 2595005905), ("æøå", 3683394156)])
def test_string_hash(spark, key, want):
    assert one(spark, H.string_key_hash(F.lit(key))) == want


@pytest.mark.parametrize(("key", "want"), [(5, 2847314981), (-1, 454268333), (123456789, 2089016946)])
def test_int_hash(spark, key, want):
    assert one(spark, H.int_key_hash(F.lit(key))) == want


@pytest.mark.parametrize(("key", "want"), [(-7, 2389684893), (0, 4117779887)])
def test_long_hash(spark, key, want):
    assert one(spark, H.long_key_hash(F.lit(key).cast("long"))) == want


def test_fnv(spark):
    assert one(spark, H.fnv1a32(F.lit("user-123"))) == 2358496403
    assert one(spark, H.fnv1a32(F.lit(""))) == 2166136261
    wide = one(spark, H.fnv1a64(F.lit("user-123")))
    assert (wide["h"] << 32 | wide["l"]) == 10997457010273760083
    assert one(spark, H.mod64(H.fnv1a64(F.lit("user-123")), 7)) == 10997457010273760083 % 7


@pytest.mark.parametrize("text", ["", "a", "æøå漢🙂", "x" * 300])
def test_fnv64_is_the_published_function(spark, text):
    want = 14695981039346656037
    for b in text.encode():
        want = (want ^ b) * 1099511628211 % 2**64
    got = one(spark, H.fnv1a64(F.lit(text)))
    assert got["h"] << 32 | got["l"] == want


def test_guid_is_mixed_endian(spark):
    import hashlib
    import uuid

    key = uuid.UUID("00112233-4455-6677-8899-aabbccddeeff")
    want = int.from_bytes(hashlib.sha256(key.bytes_le).digest()[:4], "little")
    assert one(spark, H.guid_key_hash(F.lit(str(key)))) == want


def test_other_key_types_are_refused():
    with pytest.raises(RoutingError):
        H.key_hash(F.lit(1.0), T.DoubleType())


def test_ring_distribution(spark):
    shards = [f"s{i}" for i in range(1, 9)]
    keys = spark.range(10_000).select(F.concat(F.lit("k"), "id").alias("shard_key")).withColumn("h", H.string_key_hash(F.col("shard_key")))
    routed = ring.route(keys, "h", shards, ring.RouterOptions(replication=120))
    found = {r["shard_id"]: r["n"] for r in routed.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [found[s] for s in shards] == [1112, 1259, 1046, 1063, 1437, 1206, 1412, 1465]
    stats = ring.distribution(routed).head()
    assert stats["cv"] < 0.35
    assert "BroadcastHashJoin" in routed._jdf.queryExecution().toString()


def test_ring_options():
    with pytest.raises(ValueError):
        ring.RouterOptions(replication=0)
    with pytest.raises(RoutingError):
        ring.by_modulo(F.lit(1), ["a", "a"])
    with pytest.raises(RoutingError):
        ring.by_modulo(F.lit(1), [])


def test_equal_points_keep_the_first_shard(spark):
    constant = ring.RouterOptions(replication=3, ring_hash=lambda c: F.lit(7).cast("long"))
    assert [tuple(r) for r in ring.ring(spark, ["b", "a"], constant).collect()] == [(7, "b", 0)]
