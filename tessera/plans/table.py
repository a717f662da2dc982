"""A sharded table: rows that carry the shard they came from.

It is a DataFrame underneath. Branches carry literal shard columns, so Catalyst pushes
predicates and projections through their union and drops the branches that targets rule
out; nothing here schedules shards by hand.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AllShardsFailed, OrderingNotSupported, QueryError
from ..sources.registry import Registry

log = logging.getLogger(__name__)
SHARD_COLUMNS = ("shard_id", "shard_index")


@dataclass(frozen=True)
class Targets:
    """Shards that a query is restricted to, in shard order, and how many ids named none."""

    ids: tuple[str, ...]
    invalid: int


@dataclass(frozen=True)
class QueryShape:
    source: str
    predicates: int
    has_projection: bool
    supports_ordering: bool
    supports_pagination: bool


@dataclass(frozen=True)
class ShardedTable:
    """Immutable; every step returns a new one, and nothing runs before an action."""

    frame: DataFrame
    shard_ids: tuple[str, ...]
    source: str = "rows"
    predicates: tuple[Column, ...] = ()
    projection: tuple[Column | str, ...] | None = None
    asked: tuple[str, ...] | None = None
    strict: bool = False

    @staticmethod
    def union(frames: Mapping[str, DataFrame], source: str = "rows") -> ShardedTable:
        """One branch for each shard; all must have the same columns."""
        if not frames:
            raise QueryError("a sharded table needs a shard", phase="Source")
        parts = [df.withColumns({"shard_id": F.lit(k), "shard_index": F.lit(i)}) for i, (k, df) in enumerate(frames.items())]
        return ShardedTable(reduce(lambda a, b: a.unionByName(b), parts), tuple(frames), source)

    @staticmethod
    def open(spark: SparkSession, registry: Registry, best_effort: bool = False, source: str = "rows") -> ShardedTable:
        """The registry's shards. With best effort, shards that can't be read are left out, if any is left."""
        frames, failed = {}, {}
        for shard_id, shard in registry.shards.items():
            try:
                frames[shard_id] = shard.open(spark)
                if best_effort:
                    frames[shard_id].limit(1).collect()
            except Exception as e:
                if not best_effort:
                    raise
                failed[shard_id] = e
                frames.pop(shard_id, None)
        if not frames:
            raise AllShardsFailed("no shard could be read", phase="Source", failures=failed)
        return ShardedTable.union(frames, source)

    @staticmethod
    def by_column(df: DataFrame, index: Column, count: int, source: str = "rows", names: Sequence[str] | None = None) -> ShardedTable:
        """Rows of one table that an index expression (0 to count - 1) spreads over shards: a single scan.

        names are the shards' ids, by index; without them, the indexes. As the shard follows
        from a row's values, a target only filters; ``laid_out`` tables are pruned.
        """
        ids = tuple(map(str, range(count) if names is None else names))
        if len(ids) != count or len(set(ids)) != count:
            raise QueryError("there must be one name for each shard", phase="Source", names=ids, shards=count)
        shard = F.col("shard_index").cast("string") if names is None else F.element_at(F.array(*map(F.lit, ids)), F.col("shard_index") + 1)
        return ShardedTable(df.withColumn("shard_index", index.cast("int")).withColumn("shard_id", shard), ids, source)

    def lay_out(self, path: str) -> ShardedTable:
        """Write the rows with a folder for each shard, and return the table that reads them.

        A target then lists and reads its own folders only. Tasks are dealt by shard and, within
        a shard, over as many files as its rows need, so a large shard isn't one task's.
        """
        spread = self.rows().withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(16)))
        spread.repartition("shard_id", "_deal").drop("_deal").write.partitionBy("shard_id", "shard_index").parquet(path)
        return ShardedTable.laid_out(self.frame.sparkSession, path, self.shard_ids, self.source)

    @staticmethod
    def laid_out(spark: SparkSession, path: str, shard_ids: Sequence[str], source: str = "rows") -> ShardedTable:
        """A table that ``lay_out`` wrote."""
        rows = spark.read.parquet(path)
        data = [c for c in rows.columns if c not in SHARD_COLUMNS]
        kept = rows.select(*data, F.col("shard_id").cast("string").alias("shard_id"), F.col("shard_index").cast("int").alias("shard_index"))
        return ShardedTable(kept, tuple(shard_ids), source)

    def where(self, condition: Column) -> ShardedTable:
        """And this condition. Python functions are refused: they couldn't be pushed to the shards."""
        if not isinstance(condition, Column):
            raise QueryError("a predicate must be a Column", phase="Predicate")
        return replace(self, predicates=(*self.predicates, condition))

    def select(self, *columns: Column | str) -> ShardedTable:
        """Project. A later projection works on an earlier one's columns."""
        if self.projection is None:
            return replace(self, projection=columns)
        return replace(self, frame=self.rows(), predicates=(), projection=columns, asked=None)

    def where_shard(self, *ids: str) -> ShardedTable:
        """Restrict to these shards. The last call counts; no id means all shards."""
        return replace(self, asked=tuple(map(str, ids)) or None)

    def targets(self) -> Targets | None:
        if self.asked is None:
            return None
        known = {k: i for i, k in enumerate(self.shard_ids)}
        valid = sorted({x.strip() for x in self.asked} & set(known), key=known.__getitem__)
        return Targets(tuple(valid), sum(x.strip() not in known for x in self.asked))

    def rows(self) -> DataFrame:
        """The unordered merge of the shards, with provenance unless the projection leaves it out."""
        df = self.frame
        if (targets := self.targets()) is not None:
            df = df.where(F.col("shard_id").isin(*targets.ids) if targets.ids else F.lit(False))
        for condition in self.predicates:
            df = df.where(condition)
        return df if self.projection is None else df.select(*self.projection)

    def where_key(self, key: Column, shard_of: Callable[[Column], Column], value: object) -> ShardedTable:
        """Rows with this key, read only from the shard that the routing rule gives it."""
        index = self.frame.sparkSession.range(1).select(shard_of(F.lit(value)).alias("i")).head()["i"]
        return self.where(key == F.lit(value)).where_shard(str(index))

    def order_by(self, *columns: Column | str) -> DataFrame:
        if self.strict:
            raise OrderingNotSupported("this query is unordered; use an ordered merge", phase="Ordering")
        return self.rows().orderBy(*columns)

    def shape(self) -> QueryShape:
        return QueryShape(self.source, len(self.predicates), self.projection is not None, not self.strict, not self.strict)


def query(table: ShardedTable, where: Column | None = None, select: Iterable[Column | str] | None = None, result: Iterable[str] | None = None) -> ShardedTable:
    """A query in one call. Without a projection the result must have the source's columns."""
    if where is not None:
        table = table.where(where)
    if select is not None:
        return table.select(*select)
    if result is not None and list(result) != [c for c in table.frame.columns if c not in SHARD_COLUMNS]:
        raise QueryError("the result differs from the source and there is no projection", phase="Projection", source=table.frame.columns, result=list(result))
    return table


def isolated(table: ShardedTable, write: Callable[[str, DataFrame], DataFrame], at_once: int = 8) -> tuple[DataFrame, dict[str, Exception]]:
    """Best effort with one job a shard: what the shards that answered returned, and the failures of the others.

    write materialises a shard's rows, for instance in the shared folder, and returns them.
    Up to ``at_once`` shards run side by side; results are merged in shard order.
    """
    if at_once < 1:
        raise ValueError("at least one shard must run at a time")
    done, failed = [], {}
    targets = table.targets()
    ids = table.shard_ids if targets is None else targets.ids

    def run(shard_id: str) -> DataFrame | Exception:
        try:
            return write(shard_id, table.where_shard(shard_id).rows())
        except Exception as e:
            log.warning("shard %s failed: %s", shard_id, e)
            return e

    with ThreadPoolExecutor(at_once) as pool:
        for shard_id, found in zip(ids, pool.map(run, ids), strict=True):
            if isinstance(found, Exception):
                failed[shard_id] = found
            else:
                done.append(found)
    if not done:
        raise AllShardsFailed("no shard answered", phase="Execution", failures=failed)
    return reduce(lambda a, b: a.unionByName(b), done), failed


class Client:
    """A facade over one sharded table."""

    def __init__(self, table: ShardedTable):
        self.table = table

    def query(self, where: Column | None = None, select: Iterable[Column | str] | None = None) -> ShardedTable:
        return query(self.table, where, select)
