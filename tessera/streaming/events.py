"""An extension: live events routed to shards, and their assignments kept up to date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import long_key_hash
from ..operators.ring import by_modulo
from ..sources.shard_map import MapStore


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def routed(events: DataFrame, key: str, shards: Sequence[str]) -> DataFrame:
    return events.withColumn("shard_id", by_modulo(long_key_hash(F.col(key)), shards))


def windowed(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events a shard and window; what comes later than ``late`` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "shard_id").agg(F.count(F.lit(1)).alias("n"))


def keep_map(events: DataFrame, key: str, store: MapStore, checkpoint: str) -> StreamingQuery:
    """Assign every key at its first event; later batches find it assigned."""
    def batch(df: DataFrame, number: int) -> None:
        store.try_assign(df.select(F.col(key).cast("string").alias("shard_key"), "shard_id").distinct())

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
