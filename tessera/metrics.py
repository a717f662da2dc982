"""Counters of what queries read, by shard, observed while they run."""

from __future__ import annotations

import logging
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .plans.table import ShardedTable

log = logging.getLogger(__name__)


@dataclass
class QueryMetrics:
    """One record a query run."""

    source: str
    targets: int
    invalid_targets: int
    ordering: bool = False
    status: str = "running"
    ms: float = 0.0
    items: dict[str, int] = field(default_factory=dict)
    merge: str = "unordered"
    predicates: int = 0
    projected: bool = False
    failed_shards: int = 0

    def tags(self) -> dict[str, object]:
        """What a latency is recorded under."""
        return {"source": self.source, "merge": self.merge, "ordering": self.ordering, "targets": self.targets, "invalid": self.invalid_targets, "predicates": self.predicates, "projected": self.projected, "failed_shards": self.failed_shards, "status": self.status}


class Latencies:
    """A histogram of query latencies for each set of tags; give ``record`` to ``collect`` as its observer."""

    def __init__(self, bounds_ms: tuple[float, ...] = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10_000)):
        if list(bounds_ms) != sorted(set(bounds_ms)):
            raise ValueError("bounds must ascend")
        self.bounds = bounds_ms
        self.counts: dict[tuple, list[int]] = {}

    def record(self, metrics: QueryMetrics) -> None:
        self.counts.setdefault(tuple(metrics.tags().items()), [0] * (len(self.bounds) + 1))[bisect_left(self.bounds, metrics.ms)] += 1


@contextmanager
def described(spark: SparkSession, what: str) -> Iterator[None]:
    """Jobs inside carry this description; the thread's own comes back afterwards."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setJobDescription(what)
    try:
        yield
    finally:
        context.setLocalProperty("spark.job.description", before)


def collect(table: ShardedTable, ordering: bool = False, tag: str | None = None, observer: Callable[[QueryMetrics], None] | None = None) -> tuple[list, QueryMetrics]:
    """The rows, and one metrics record, which an observer gets whether the query ends well or not.

    Jobs carry the tag, so that another thread can cancel them with ``interruptTag``.
    """
    spark = table.frame.sparkSession
    targets = table.targets()
    out = QueryMetrics(
        table.source, len(table.shard_ids) if targets is None else len(targets.ids), 0 if targets is None else targets.invalid, ordering,
        merge="ordered" if ordering else "unordered", predicates=len(table.predicates), projected=table.projection is not None,
    )
    began, seen = time.monotonic(), Observation()
    df = table.rows()
    watch = "shard_id" in df.columns
    if tag:
        spark.addTag(tag)
    try:
        counts = [F.count_if(F.col("shard_id") == s).alias(s) for s in table.shard_ids] if watch else [F.count(F.lit(1)).alias("all")]
        with described(spark, f"query of {table.source}, {out.targets} shards"):
            rows = df.observe(seen, *counts).collect()
        out.items = dict(seen.get)
        out.status = "ok"
        return rows, out
    except Exception:
        out.status = "failed"
        raise
    finally:
        out.ms = (time.monotonic() - began) * 1000
        if tag:
            spark.removeTag(tag)
        if observer:
            try:
                observer(out)
            except Exception:  # an observer's own trouble must not spoil the query
                log.exception("a metrics observer failed")


def state_counts(found: DataFrame) -> DataFrame:
    """Moves by state."""
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def migration_counts(found: DataFrame) -> DataFrame:
    """For each pair of shards: moves, how far they came, and the share that failed."""
    done, failed, n = F.count_if(F.col("state") == "Done"), F.count_if(F.col("state") == "Failed"), F.count(F.lit(1))
    return found.groupBy("source_shard", "target_shard").agg(n.alias("planned"), done.alias("done"), failed.alias("failed"), (n - done - failed).alias("open"), (failed / n).alias("failed_share"))
