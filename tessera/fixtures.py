"""Deterministic, skewed shards for tests and benchmarks."""

from __future__ import annotations

import enum
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Skew(enum.Enum):
    """How much slower or larger the last shard is than the first."""

    NONE = 1
    MILD = 3
    HARSH = 10


def schedule(shards: int, base: float, skew: Skew = Skew.NONE) -> list[float]:
    """A delay or size for each shard, growing evenly from base to base times the skew."""
    if shards < 1 or base < 0:
        raise ValueError("there must be a shard, and delays must not be negative")
    return [base * (1 + (skew.value - 1) * i / max(1, shards - 1)) for i in range(shards)]


def shuffled(items: Sequence, seed: int) -> list:
    """The items in an order that depends on the seed only."""
    out = list(items)
    random.Random(seed).shuffle(out)
    return out


def skewed_rows(spark: SparkSession, shards: int, rows: int, skew: Skew = Skew.NONE) -> DataFrame:
    """shard_index, seq and id: ``rows`` rows in the first shard, more in later ones by the skew; ids are unique."""
    sizes = [round(x) for x in schedule(shards, rows, skew)]
    starts = [sum(sizes[:i]) for i in range(shards)]
    index = F.lit(0)
    for i, start in enumerate(starts[1:], 1):
        index = F.when(F.col("id") >= start, i).otherwise(index)
    out = spark.range(sum(sizes)).withColumn("shard_index", index)
    return out.select("shard_index", (F.col("id") - F.element_at(F.array(*map(F.lit, starts)), F.col("shard_index") + 1)).alias("seq"), "id")
