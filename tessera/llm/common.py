"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import discard, shared_dir, staged

__all__ = ["bounded_sample", "discard", "fold", "fresh", "held_out", "shared_dir", "spread", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str = "doc_id") -> Column:
    """crc32 of the key as text, mod 5; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5


def held_out(key: Column | str = "doc_id") -> Column:
    """True for the fold that no model learns from; a null key belongs to no fold."""
    return F.coalesce(fold(key) == 0, F.lit(False))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that isn't among these, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most so many rows of df: one for each of the keys that are the smallest by a seeded hash of the key.

    Of the rows of one key, that of the smallest hash is taken. ``rows`` bounds the broadcast
    side too. Meant for fitting models only.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    keys = keys.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)
    found = df.join(F.broadcast(keys), key, "left_semi")
    return found.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("row")).select("row.*")


def spread(spark: SparkSession, most: int = 64) -> int:
    """In how many parts a bounded sample is worked on."""
    return max(1, min(most, spark.sparkContext.defaultParallelism))
