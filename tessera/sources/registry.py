"""Shards and where their rows come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreError

Factory = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Shard:
    """A named place with a factory for its rows."""

    shard_id: str
    factory: Factory

    def __post_init__(self) -> None:
        if not self.shard_id or not self.shard_id.strip():
            raise ValueError("a shard id must not be blank")

    def open(self, spark: SparkSession) -> DataFrame:
        return self.factory(spark)


def files(path: str, kind: str = "parquet", **options: str) -> Factory:
    """Rows of files: parquet, orc, json, csv or text."""
    return lambda spark: spark.read.format(kind).options(**options).load(path)


def jdbc(url: str, table: str, fetch_size: int = 512, timeout_s: int = 0, **options: str) -> Factory:
    """Rows of a database table; filters and columns are pushed down, pages are the driver's fetch size."""
    if fetch_size <= 0:
        raise ValueError("the fetch size must be positive")
    return lambda spark: spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(fetch_size), queryTimeout=str(timeout_s), **options).load()


def rows(data: Iterable[tuple], schema: str) -> Factory:
    """Rows in memory."""
    kept = list(data)
    return lambda spark: spark.createDataFrame(kept, schema)


def frame(df: DataFrame) -> Factory:
    return lambda spark: df


@dataclass
class Registry:
    """Shards in the order in which they were added; that order breaks ties."""

    shards: dict[str, Shard] = field(default_factory=dict)

    def add(self, shard_id: str, factory: Factory) -> Registry:
        if shard_id in self.shards:
            raise StoreError(f"shard {shard_id} is registered already", shard_id=shard_id)
        self.shards[shard_id] = Shard(shard_id, factory)
        return self

    def add_many(self, count: int, factory: Callable[[int], Factory]) -> Registry:
        if count < 1:
            raise ValueError("there must be at least one shard")
        for i in range(count):
            self.add(str(i), factory(i))
        return self

    def get(self, shard_id: str) -> Shard:
        if shard_id not in self.shards:
            raise KeyError(shard_id)
        return self.shards[shard_id]

    @contextmanager
    def use(self, spark: SparkSession, shard_id: str):
        """The shard's rows, cached while they are in use."""
        df = self.get(shard_id).open(spark).persist()
        try:
            yield df
        finally:
            df.unpersist()

    @staticmethod
    def of(locations: Mapping[str, Factory]) -> Registry:
        out = Registry()
        for shard_id, factory in (locations or {}).items():
            out.add(shard_id, factory)
        return out


def next_page_size(size: int, batch_ms: float, target_ms: float = 75.0, least: int = 64, most: int = 8192) -> int:
    """The page that follows a batch: half as large again below the target time, half above it."""
    if not 0 < least <= most or size <= 0:
        raise ValueError("page sizes must be positive and ordered")
    wanted = size * 1.5 if batch_ms < target_ms else size * 0.5 if batch_ms > target_ms else size
    return max(least, min(most, int(wanted)))


def oscillates(decided_ms: list[float], now_ms: float, window_ms: float = 5000.0, decisions: int = 6) -> bool:
    """Whether page sizes changed so often lately that they hunt around their target."""
    return sum(now_ms - window_ms <= t <= now_ms for t in decided_ms) >= decisions
