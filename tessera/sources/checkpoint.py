"""Migration checkpoints: the latest state of each plan, as JSON rows, one for each part of its moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = "struct<version:int,last_index:bigint,states:array<struct<shard_key:string,state:string>>>"


def encoded(found: DataFrame, plan_id: str, version: int, at: Column, parts: int = 16) -> DataFrame:
    """Rows plan_id, version, part, parts, updated_at, payload for moves(ord, shard_key, state) of one plan.

    A part holds the moves whose key hashes to it; choose parts so that one fits in a row,
    some tens of thousands of moves. Parts without moves have a row too, so that a whole
    version can be told from a torn one.
    """
    key = F.col("shard_key").cast("string")
    states = F.sort_array(F.collect_list(F.struct(key.alias("shard_key"), "state")))
    last = F.max(F.when(F.col("state") != "Planned", F.col("ord")))
    held = found.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")).agg(states.alias("states"), last.alias("last_index"))
    rows = found.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).join(held, "part", "left")
    states = F.coalesce("states", F.array().cast("array<struct<shard_key:string,state:string>>")).alias("states")
    payload = F.to_json(F.struct(F.lit(version).alias("version"), F.coalesce("last_index", F.lit(-1)).cast("long").alias("last_index"), states))
    return rows.select(F.lit(plan_id).alias("plan_id"), F.lit(version).alias("version"), "part", F.lit(parts).alias("parts"), at.alias("updated_at"), payload.alias("payload"))


def decoded(rows: DataFrame) -> DataFrame:
    """plan_id, version, last_index, shard_key, state."""
    read = rows.select("plan_id", F.from_json("payload", PAYLOAD).alias("p"))
    last = read.groupBy("plan_id", F.col("p.version").alias("version")).agg(F.max("p.last_index").alias("last_index"))  # a row a plan
    states = read.select("plan_id", F.col("p.version").alias("version"), F.explode("p.states").alias("s"))
    return states.join(last, ["plan_id", "version"]).select("plan_id", "version", "last_index", "s.shard_key", "s.state")


def latest(rows: DataFrame) -> DataFrame:
    """The rows of each plan's last version that has all its parts."""
    whole = rows.groupBy("plan_id", "version", "updated_at").agg(F.countDistinct("part").alias("n"), F.max("parts").alias("parts")).where("n = parts")
    last = whole.groupBy("plan_id").agg(F.max(F.struct("version", "updated_at")).alias("last")).select("plan_id", "last.version", "last.updated_at")
    return rows.join(last, ["plan_id", "version", "updated_at"])


class MemoryCheckpoints:
    """The latest checkpoint of each plan, for tests and dry runs."""

    def __init__(self) -> None:
        self._latest: dict[str, DataFrame] = {}

    def persist(self, plan_id: str, rows: DataFrame) -> None:
        self._latest[plan_id] = rows

    def load(self, plan_id: str) -> DataFrame | None:
        return self._latest.get(plan_id)


class CheckpointStore:
    """Appends checkpoints to a folder and loads the latest of a plan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def persist(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def load(self, plan_id: str) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        found = latest(self.spark.read.parquet(self.path).where(F.col("plan_id") == plan_id))
        return None if found.isEmpty() else found
