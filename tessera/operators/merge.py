"""Merges across shards.

Unordered merges are unions. Ordered merges are range-partitioned, spillable sorts by
(key, shard, place within the shard), which is what a heap merge of sorted shards yields;
shards needn't be sorted. Places must come from the data, a unique column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.table import ShardedTable
from ..staging import staged


def unordered(table: ShardedTable) -> DataFrame:
    return table.rows()


def tagged(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Every shard's rows with shard_id and shard_index."""
    return ShardedTable.union(frames).rows()


def project(table: ShardedTable, *columns: Column | str) -> DataFrame:
    """The merged rows projected, without provenance."""
    return table.rows().select(*columns)


def order(key: str, seq: str, descending: bool = False, shard_ascending: bool | None = None) -> list[Column]:
    """The order of a merge. Descending turns the shard order round too, unless told otherwise; places always ascend."""
    up = not descending if shard_ascending is None else shard_ascending
    return [F.col(key).desc() if descending else F.col(key).asc(), F.col("shard_index").asc() if up else F.col("shard_index").desc(), F.col(seq).asc()]


def ordered(df: DataFrame, key: str, seq: str, descending: bool = False, shard_ascending: bool | None = None) -> DataFrame:
    """A k-way ordered merge."""
    return df.orderBy(*order(key, seq, descending, shard_ascending))


#: The eager merge has the same result, and the same plan.
ordered_eager = ordered


def merge_sorted_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """A merge of sorted streams; the first stream wins ties."""
    return ordered(df, key, seq)


def top(df: DataFrame, key: str, seq: str, k: int, descending: bool = False) -> DataFrame:
    """The first k rows of an ordered merge."""
    return ordered(df, key, seq, descending).limit(k)


def ranked(df: DataFrame, by: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's place (from 1) in a total order, without one task for all rows.

    Rows are dealt by range, numbered within their partition and shifted by the sizes of
    the partitions before it, one number each.
    """
    dealt = staged(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    shifts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_shift")))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.withColumn("_own", own).join(shifts, "_part").withColumn(name, F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def by_shard(df: DataFrame) -> DataFrame:
    """Tagged rows taken apart: rows of each shard counted."""
    return df.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))


def shard(df: DataFrame, shard_id: str) -> DataFrame:
    """One shard's rows of a tagged merge."""
    return df.where(F.col("shard_id") == shard_id).drop("shard_id", "shard_index")
