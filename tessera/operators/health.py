"""Health: reports folded from probe events, gating of targets, and availability."""

from __future__ import annotations

import enum
import logging
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InsufficientHealthyShards
from ..plans.table import ShardedTable
from ..sources.registry import Registry

log = logging.getLogger(__name__)


class Behaviour(enum.Enum):
    INCLUDE = 0
    SKIP = 1
    QUARANTINE = 2
    DEGRADE = 3


@dataclass(frozen=True)
class Availability:
    """What must be healthy for a query to run."""

    all_healthy: bool = False
    at_least: int = 0
    percentage: float = 0.0

    def met(self, healthy: int, total: int) -> bool:
        if self.all_healthy and healthy < total:
            return False
        return healthy >= self.at_least and (total == 0 or healthy / total >= self.percentage)


BEST_EFFORT = Availability()
ALL_SHARDS = Availability(all_healthy=True)


def fold(probes: DataFrame, unhealthy_after: int = 3, healthy_after: int = 2, piece_s: int = 3600) -> DataFrame:
    """probes(shard_id, ts, seq, ok) with the shard's status after each event.

    So many failures in a row make a shard unhealthy, so many successes make it healthy
    again; the first success makes an unknown shard healthy. healthy_after 1 is the rule
    of periodic probes, which recover at once.

    A shard's events are ordered, but no task sees its whole history: they are folded in
    pieces of ``piece_s`` seconds. What a piece hands to the next (its last run of equal
    events, its last decision) is one row, and those rows are folded in turn.
    """
    piece = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (piece_s * 1_000_000)).cast("long")
    local = Window.partitionBy("shard_id", "_piece").orderBy("ts", "seq")
    probes = probes.withColumn("_piece", piece)
    probes = probes.withColumn("_run", F.sum(F.when(F.lag("ok").over(local).eqNullSafe(F.col("ok")), 0).otherwise(1)).over(local))
    probes = probes.withColumn("_streak", F.row_number().over(Window.partitionBy("shard_id", "_piece", "_run").orderBy("ts", "seq")))
    by_time = F.struct("ts", "seq")
    pieces = probes.groupBy("shard_id", "_piece").agg(F.max("_run").alias("_runs"), F.max_by("ok", by_time).alias("_last"), F.max_by("_streak", by_time).alias("_length"), F.max(F.col("ok").cast("int")).alias("_met"))
    # A piece of one run that goes on where the piece before it ended lengthens that run.
    over = Window.partitionBy("shard_id").orderBy("_piece")
    goes_on = (F.col("_runs") == 1) & F.lag("_last").over(over).eqNullSafe(F.col("_last"))
    pieces = pieces.withColumn("_chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(over))
    pieces = pieces.withColumn("_length", F.sum("_length").over(Window.partitionBy("shard_id", "_chain").orderBy("_piece")))
    carried = pieces.select("shard_id", "_piece", F.lag("_last").over(over).alias("_ok_before"), F.lag("_length").over(over).alias("_before"), F.max("_met").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_met_before"))
    probes = probes.join(carried, ["shard_id", "_piece"])
    streak = F.col("_streak") + F.when((F.col("_run") == 1) & F.col("ok").eqNullSafe(F.col("_ok_before")), F.col("_before")).otherwise(0)
    decided = F.when(~F.col("ok") & (streak >= unhealthy_after), "Unhealthy").when(F.col("ok") & (streak >= healthy_after), "Healthy")
    probes = probes.withColumn("_decided", F.last(decided, ignorenulls=True).over(local))
    probes = probes.withColumn("_met", F.greatest(F.max(F.col("ok").cast("int")).over(local), F.coalesce("_met_before", F.lit(0))))
    ends = probes.groupBy("shard_id", "_piece").agg(F.max_by("_decided", by_time).alias("_decision"))
    ends = ends.select("shard_id", "_piece", F.last("_decision", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_decision"))
    probes = probes.join(ends, ["shard_id", "_piece"])
    status = F.coalesce("_decided", "_decision", F.when(F.col("_met") == 1, "Healthy").otherwise("Unknown"))
    return probes.withColumn("status", status).drop("_piece", "_run", "_streak", "_ok_before", "_before", "_met_before", "_met", "_decided", "_decision")


def latest(folded: DataFrame) -> DataFrame:
    """shard_id, status and ts: each shard's last report."""
    return folded.groupBy("shard_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("ts"))


def healthy(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """The targets(shard_id) that may be queried: healthy, unknown or never reported."""
    return targets.join(reports.where(F.col("status").isin("Degraded", "Unhealthy")), "shard_id", "left_anti")


def gated(table: ShardedTable, reports: DataFrame, behaviour: Behaviour = Behaviour.SKIP, need: Availability = BEST_EFFORT, gate_all: bool = False) -> ShardedTable:
    """The table restricted to healthy shards. Without explicit targets nothing is gated, unless gate_all.

    reports has a row a shard, and is collected.
    """
    targets = table.targets()
    if behaviour is Behaviour.INCLUDE or targets is None and not gate_all:
        return table
    asked: Sequence[str] = table.shard_ids if targets is None else targets.ids
    bad = {r["shard_id"] for r in reports.where(F.col("status").isin("Degraded", "Unhealthy")).collect()}
    good = [s for s in asked if s not in bad]
    if behaviour is Behaviour.QUARANTINE and len(good) < len(asked) or not need.met(len(good), len(asked)):
        raise InsufficientHealthyShards(len(asked), len(good), [s for s in asked if s in bad])
    return table.where_shard(*good) if good else table.where(F.lit(False))


def always_healthy(spark: SparkSession, shards: Sequence[str]) -> DataFrame:
    """The reports of a policy that probes nothing."""
    return spark.createDataFrame([(s, "Healthy") for s in shards], "shard_id string, status string")


def probed(spark: SparkSession, registry: Registry) -> DataFrame:
    """shard_id, status and description, by reading one row of every registered shard."""
    found = []
    for shard_id, shard in registry.shards.items():
        try:
            shard.open(spark).limit(1).collect()
            found.append((shard_id, "Healthy", None))
        except Exception as e:
            found.append((shard_id, "Unhealthy", str(e).splitlines()[0][:200]))
    return spark.createDataFrame(found, "shard_id string, status string, description string")


class HealthPolicy:
    """A live policy: probes shards when asked, and hears of queries' outcomes.

    So many failures in a row make a shard unhealthy; an unhealthy one is not probed again
    before its cooldown has passed, and one good probe, or ``healthy_after`` good queries,
    make it healthy. Counters follow what happened. Shards are probed side by side.
    """

    def __init__(self, spark: SparkSession, registry: Registry, unhealthy_after: int = 3, healthy_after: int = 2, cooldown_s: float = 60.0, interval_s: float = 30.0, timeout_s: float = 5.0, at_once: int = 8, clock: Callable[[], float] = time.monotonic):
        if min(unhealthy_after, healthy_after, at_once) < 1 or min(cooldown_s, interval_s, timeout_s) < 0:
            raise ValueError("thresholds must be positive, times not negative")
        self.spark, self.registry, self.clock, self.at_once = spark, registry, clock, at_once
        self.unhealthy_after, self.healthy_after = unhealthy_after, healthy_after
        self.cooldown_s, self.interval_s, self.timeout_s = cooldown_s, interval_s, timeout_s
        self.status = dict.fromkeys(registry.shards, "Unknown")
        self.streak = dict.fromkeys(registry.shards, 0)  # failures count down, successes up
        self.seen: dict[str, float] = {}
        self.counters = {"probes": 0, "probe_ms": 0.0, "failed": 0, "unhealthy": 0, "recovered": 0, "skipped": 0}

    def record(self, shard_id: str, ok: bool, probe: bool = False) -> str:
        """An outcome of a query or probe, and the status that follows."""
        run, before = self.streak[shard_id], self.status[shard_id]
        self.streak[shard_id] = run = max(run, 0) + 1 if ok else min(run, 0) - 1
        self.seen[shard_id] = self.clock()
        if ok and (before == "Unknown" or before == "Unhealthy" and (probe or run >= self.healthy_after)):
            self.status[shard_id] = "Healthy"
            self.counters["recovered"] += before == "Unhealthy"
        elif not ok:
            self.counters["failed"] += 1
            if -run >= self.unhealthy_after:
                self.status[shard_id] = "Unhealthy"
                self.counters["unhealthy"] += before != "Unhealthy"
        return self.status[shard_id]

    def due(self) -> list[str]:
        """The shards whose last outcome is older than the interval, or the cooldown where they are unhealthy."""
        wait = lambda s: self.cooldown_s if self.status[s] == "Unhealthy" else self.interval_s
        return [s for s in self.registry.shards if s not in self.seen or self.clock() - self.seen[s] >= wait(s)]

    def probe(self) -> DataFrame:
        """Probe the shards that are due, and report on all."""
        due = self.due()
        self.counters["skipped"] += len(self.registry.shards) - len(due)

        def run(shard_id: str) -> tuple[bool, float]:
            began = time.monotonic()
            try:
                self.registry.get(shard_id).open(self.spark).limit(1).collect()
                return time.monotonic() - began <= self.timeout_s or not self.timeout_s, time.monotonic() - began
            except Exception as e:
                log.warning("shard %s failed its probe: %s", shard_id, e)
                return False, time.monotonic() - began

        with ThreadPoolExecutor(self.at_once) as pool:
            for shard_id, (ok, took) in zip(due, pool.map(run, due), strict=True):
                self.counters["probes"] += 1
                self.counters["probe_ms"] += took * 1000
                self.record(shard_id, ok, probe=True)
        return self.reports()

    def reports(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.status.items()), "shard_id string, status string")


def availability(targets: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: total and healthy targets and the healthy share."""
    joined = targets.join(reports.select("shard_id", "status"), "shard_id", "left")
    ok = F.count_if(~F.coalesce(F.col("status").isin("Degraded", "Unhealthy"), F.lit(False)))
    return joined.agg(F.count(F.lit(1)).alias("total"), ok.alias("healthy"), (ok / F.count(F.lit(1))).alias("share"))
