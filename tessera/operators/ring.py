"""Consistent-hash rings and routing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import RoutingError
from ..functions.hashing import TWO32, key_hash, string_key_hash
from ..sources.shard_map import MapStore
from ..staging import staged

BROADCAST_POINTS = 2_000_000


@dataclass(frozen=True)
class RouterOptions:
    """How keys find shards."""

    consistent: bool = True
    replication: int = 100
    ring_hash: Callable[[Column], Column] = field(default=string_key_hash)
    key_hash: Callable[[Column], Column] | None = None
    store: Callable[[SparkSession], MapStore] | None = None
    router: Callable[[SparkSession, Sequence[str], RouterOptions], Router] | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.replication <= 10_000:
            raise ValueError("the replication factor must be between 1 and 10000")


def _checked(shards: Sequence[str]) -> list[str]:
    if not shards:
        raise RoutingError("there must be at least one shard", shard_count=0)
    if len(set(shards)) != len(shards):
        raise RoutingError("shard ids must be unique", shard_count=len(shards))
    if any(not s or not s.strip() for s in shards):
        raise RoutingError("a shard id must not be blank")
    return list(shards)


def points(spark: SparkSession, shards: Sequence[str], options: RouterOptions = RouterOptions()) -> DataFrame:
    """point and shard_id of every virtual node before collisions are settled, with shard_index and replica."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(_checked(shards))], "shard_index int, shard_id string")
    rows = rows.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(options.replication - 1))))
    return rows.withColumn("point", options.ring_hash(F.concat("shard_id", F.lit("-replica-"), F.col("replica").cast("string"))))


def ring(spark: SparkSession, shards: Sequence[str], options: RouterOptions = RouterOptions()) -> DataFrame:
    """point, shard_id, shard_index: on a collision, the node inserted first stays."""
    first = F.row_number().over(Window.partitionBy("point").orderBy("shard_index", "replica"))
    return points(spark, shards, options).withColumn("n", first).where("n = 1").select("point", "shard_id", "shard_index")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The ring as half-open arcs (lo, hi], cut at multiples of 2^24 so that keys find them by equality first."""
    whole = Window.orderBy("point")  # the ring's own points: shards times replicas, never keys
    arcs = nodes.withColumn("lo", F.coalesce(F.lag("point").over(whole), F.lit(-1))).withColumn("hi", F.col("point"))
    wrap = nodes.agg(F.min_by("shard_id", "point").alias("shard_id"), F.max("point").alias("lo")).withColumn("hi", F.lit(TWO32 - 1))
    arcs = arcs.select("shard_id", "lo", "hi").unionByName(wrap.where(F.col("lo") < F.col("hi")))
    return arcs.withColumn("bucket", F.explode(F.sequence(F.shiftright(F.col("lo") + 1, 24), F.shiftright("hi", 24))))


def lookup(keys: DataFrame, hash_column: str, nodes: DataFrame, shards: int, replication: int) -> DataFrame:
    """keys with shard_id: the owner of the first ring point at or after the hash, wrapping round."""
    arcs = _arcs(nodes)
    if shards * replication <= BROADCAST_POINTS:
        arcs = F.broadcast(arcs)
    h = F.col(hash_column)
    hit = (F.shiftright(h, 24) == arcs["bucket"]) & (h > arcs["lo"]) & (h <= arcs["hi"])
    return keys.join(arcs, hit).drop("bucket", "lo", "hi")


def route(df: DataFrame, hash_column: str, shards: Sequence[str], options: RouterOptions = RouterOptions()) -> DataFrame:
    """df with shard_id, by ring or by hash modulo."""
    if options.consistent:
        return lookup(df, hash_column, ring(df.sparkSession, shards, options), len(shards), options.replication)
    return df.withColumn("shard_id", by_modulo(F.col(hash_column), shards))


def by_modulo(key_hash: Column, shards: Sequence[str]) -> Column:
    names = F.array(*map(F.lit, _checked(shards)))
    return F.element_at(names, (F.pmod(key_hash, F.lit(len(shards))) + 1).cast("int"))


def resolve(routed: DataFrame, stored: DataFrame, shards: Sequence[str], key: str = "shard_key") -> DataFrame:
    """routed(key, shard_id) with stored assignments taken first: shard_id and was_existing.

    An assignment to a shard that is gone is not taken; the key is routed anew.
    """
    live = F.col("_old").isin(*_checked(shards))
    old = stored.select(F.col("shard_key").alias(key), F.col("shard_id").alias("_old"))
    out = routed.join(old, key, "left").withColumn("was_existing", F.coalesce(live, F.lit(False)))
    return out.withColumn("shard_id", F.when(F.col("was_existing"), F.col("_old")).otherwise(F.col("shard_id"))).drop("_old")


def delta(resolved: DataFrame, key: str = "shard_key") -> DataFrame:
    """The assignments to store: those that didn't exist."""
    return resolved.where(~F.col("was_existing")).select(F.col(key).alias("shard_key"), "shard_id").distinct()


def route_metrics(resolved: DataFrame) -> DataFrame:
    """Hits and misses of a routing."""
    existing = F.count_if("was_existing")
    return resolved.agg(F.count(F.lit(1)).alias("routed"), existing.alias("hits"), (F.count(F.lit(1)) - existing).alias("misses"))


def churn(before: DataFrame, after: DataFrame, key: str = "shard_key") -> DataFrame:
    """How many keys moved between two routings."""
    a, b = before.select(key, F.col("shard_id").alias("a")), after.select(key, F.col("shard_id").alias("b"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("a") != F.col("b")).alias("moved"))


def distribution(routed: DataFrame) -> DataFrame:
    """Keys a shard: shards, mean and coefficient of variation."""
    counts = routed.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("shards"), F.avg("n").alias("mean_keys"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))


class Router:
    """Routes keys to the shards it knows; assignments stay with the map store, if there is one."""

    def __init__(self, spark: SparkSession, shards: Sequence[str], options: RouterOptions = RouterOptions()):
        self.spark, self.options, self.shards = spark, options, _checked(shards)
        self.store = options.store(spark) if options.store else None

    def add(self, shard_id: str) -> None:
        """A new shard; one that is known already is an error."""
        if shard_id in self.shards:
            raise RoutingError(f"shard {shard_id} is known already", shard_id=shard_id)
        self.shards = _checked([*self.shards, shard_id])

    def remove(self, shard_id: str) -> bool:
        """Whether the shard was known. The last one can't go."""
        if shard_id not in self.shards:
            return False
        self.shards = _checked([s for s in self.shards if s != shard_id])
        return True

    def route(self, keys: DataFrame, key: str = "shard_key") -> DataFrame:
        """keys with shard_id and was_existing; new assignments go to the store."""
        hashed = keys.withColumn("_h", key_hash(F.col(key), keys.schema[key].dataType, self.options.key_hash))
        found = route(hashed, "_h", self.shards, self.options).drop("_h")
        if self.store is None:
            return found.withColumn("was_existing", F.lit(False))
        resolved = staged(resolve(found, self.store.rows(), self.shards, key), "routed")  # decided once
        self.store.assign(delta(resolved, key))
        return resolved


def router(spark: SparkSession, shards: Sequence[str], options: RouterOptions = RouterOptions()) -> Router:
    """The router that the options ask for."""
    return (options.router or Router)(spark, shards, options)
