"""Topologies: full key-to-shard maps, checked, fingerprinted and rebalanced."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TopologyError
from ..functions.hashing import mod64


def snapshot(stored: DataFrame, max_keys: int = 1_000_000, order: str | None = None) -> DataFrame:
    """The map as a topology; refused beyond max_keys rows. Of a key's rows the last by ``order`` (else by shard) stays."""
    if max_keys <= 0:
        raise ValueError("the key cap must be positive")
    if stored.limit(max_keys + 1).count() > max_keys:
        raise TopologyError(f"Snapshot key cap of {max_keys} exceeded", cap=max_keys)
    by = F.struct(*([order] if order else []), "shard_id")
    return stored.groupBy("shard_key").agg(F.max_by("shard_id", by).alias("shard_id"))


def counts(topology: DataFrame) -> DataFrame:
    return topology.groupBy("shard_id").agg(F.count(F.lit(1)).alias("keys"))


def duplicates(topology: DataFrame) -> DataFrame:
    return topology.groupBy("shard_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def validate(topology: DataFrame) -> tuple[int, dict[str, int]]:
    """Total keys and keys a shard; duplicate keys are an error."""
    if (twice := duplicates(topology).head()) is not None:
        raise TopologyError(f"duplicate key {twice['shard_key']}", key=twice["shard_key"])
    found = {r["shard_id"]: r["keys"] for r in counts(topology).collect()}  # a row a shard
    return sum(found.values()), found


def fingerprint(topology: DataFrame) -> DataFrame:
    """One upper-case SHA-256 for the whole topology, whatever the order of its rows.

    It digests ``key->shard`` joined by ``;`` in byte order of the keys. A digest of one string
    is sequential and that string is as long as the topology, so use ``fingerprint_tree``
    beyond some millions of keys.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col("shard_key").cast("string").alias("k"), F.col("shard_id").alias("s"))))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit("->"), p["s"])), ";")
    return topology.agg(F.upper(F.sha2(text, 256)).alias("fingerprint"))


def fingerprint_tree(topology: DataFrame, digits: int = 3) -> DataFrame:
    """A digest for topologies of any size: a tree over the key's SHA-256.

    A leaf digests the pairs whose key's digest starts with the same ``digits`` hex digits; 16
    neighbours are digested into one, level by level, so no task holds more than a leaf or 16
    digests. Take a digit more for each 16 times more keys.
    """
    if not 1 <= digits <= 16:
        raise ValueError("a leaf is named by 1 to 16 digits")
    key = F.col("shard_key").cast("string")
    pairs = F.array_sort(F.collect_list(F.concat(key, F.lit("->"), F.col("shard_id"))))
    level = topology.groupBy(F.substring(F.sha2(key, 256), 1, digits).alias("part")).agg(F.sha2(F.array_join(pairs, ";"), 256).alias("digest"))
    for n in reversed(range(digits)):
        below = F.array_sort(F.collect_list(F.struct("part", "digest")))
        level = level.groupBy(F.substring("part", 1, n).alias("part")).agg(F.sha2(F.array_join(F.transform(below, lambda p: F.concat(p["part"], p["digest"])), ""), 256).alias("digest"))
    return level.agg(F.upper(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256))).alias("fingerprint"))


def rebalance(topology: DataFrame, assign: Callable[[Column], Column], only_changes: bool = False) -> DataFrame:
    """The topology with each key's shard by this rule."""
    new = topology.select("shard_key", F.col("shard_id").alias("_old"), assign(F.col("shard_key")).alias("shard_id"))
    return (new.where("shard_id <> _old") if only_changes else new).drop("_old")


def rebalance_by_hash(topology: DataFrame, shards: Sequence[str], halves: Callable[[Column], Column], only_changes: bool = False) -> DataFrame:
    """By an unsigned 64-bit hash modulo the number of shards."""
    if not shards:
        raise ValueError("there must be at least one shard")
    names = F.array(*map(F.lit, shards))
    return rebalance(topology, lambda key: F.element_at(names, (mod64(halves(key), len(shards)) + 1).cast("int")), only_changes)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("shard_key", "shard_id").exceptAll(b.select("shard_key", "shard_id"))
