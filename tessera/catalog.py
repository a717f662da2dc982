"""The registered queries of the sharded engine and their oracle SQL."""

from __future__ import annotations

import collections
import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures, metrics
from .functions import hashing as H
from .operators import health, merge, ring, terminals, topology
from .plans import migration as M
from .plans.table import Client, ShardedTable, isolated, query
from .sources import checkpoint, shard_map
from .sources.registry import Registry, files, frame, next_page_size
from .staging import shared_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

S4, S3 = ["s0", "s1", "s2", "s3"], ["s0", "s1", "s2"]


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n))


def _customers(spark, sf_dir, n: int = 4) -> ShardedTable:
    return ShardedTable.by_column(_t(spark, sf_dir, "customer"), _mod("c_custkey", n), n, "customer")


def _orders(spark, sf_dir, n: int = 4) -> ShardedTable:
    return ShardedTable.by_column(_t(spark, sf_dir, "orders"), _mod("o_custkey", n), n, "orders")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest orders of three of four shards, by an ordered merge."""
    return ordered_top_k(spark, sf_dir)


# --- fan-out, predicates, projections, targets ---


@registered("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def fanout_where_select(spark, sf_dir):
    return _customers(spark, sf_dir).where(F.col("c_acctbal") > 0).select("c_custkey", "c_name", "c_acctbal").rows()


@registered("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 IN (0, 2) AND c_acctbal > 500")
def fanout_union_branches(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    table = ShardedTable.union({str(i): rows.where(_mod("c_custkey", 3) == i) for i in range(3)}, "customer")
    return table.where(F.col("c_acctbal") > 500).where_shard("2", "0").select("c_custkey", "c_name").rows()


@registered("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey < 1000")
def fanout_multi_where(spark, sf_dir):
    table = _orders(spark, sf_dir).where(F.col("o_totalprice") > 1000).where(F.col("o_orderstatus") == "F").where(F.col("o_custkey") < 1000)
    return table.select("o_orderkey", "o_custkey", "o_totalprice").rows()


@registered("SELECT p_partkey, upper(p_name) AS name FROM part WHERE p_size >= 20")
def query_where_select_facade(spark, sf_dir):
    table = ShardedTable.by_column(_t(spark, sf_dir, "part"), _mod("p_partkey", 3), 3, "part")
    return Client(table).query(F.col("p_size") >= 20, ["p_partkey", F.upper("p_name").alias("name")]).rows()


@registered("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_retailprice < 1200")
def query_without_projection(spark, sf_dir):
    table = ShardedTable.by_column(_t(spark, sf_dir, "part"), _mod("p_partkey", 3), 3, "part")
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return query(table, F.col("p_retailprice") < 1200, result=names).rows().select(*names)


@registered("SELECT o_orderkey, o_totalprice * 2 AS double_price FROM orders WHERE o_totalprice * 2 > 100000")
def select_then_where(spark, sf_dir):
    table = _orders(spark, sf_dir).select("o_orderkey", (F.col("o_totalprice") * 2).alias("double_price"))
    return ShardedTable(table.rows(), table.shard_ids).where(F.col("double_price") > 100000).rows()


@registered("SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey % 4 = 1")
def target_single_shard(spark, sf_dir):
    return _customers(spark, sf_dir).where_shard("1").select("c_custkey", "shard_id").rows()


@registered("SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey % 4 IN (0, 3)")
def target_multi_shard_dedup(spark, sf_dir):
    return _customers(spark, sf_dir).where_shard("3", "0", "3", "0").select("c_custkey", "shard_id").rows()


@registered("SELECT c_custkey, CAST(c_custkey % 4 AS VARCHAR) AS shard_id, 2 AS invalid FROM customer WHERE c_custkey % 4 IN (0, 2)")
def target_invalid_ignored(spark, sf_dir):
    table = _customers(spark, sf_dir).where_shard("2", "99", "-1", "0")
    return table.select("c_custkey", "shard_id", F.lit(table.targets().invalid).alias("invalid")).rows()


@registered("SELECT c_custkey, c_name FROM customer WHERE false")
def target_all_invalid_empty(spark, sf_dir):
    return _customers(spark, sf_dir).where_shard("99", "x").select("c_custkey", "c_name").rows()


@registered("SELECT c_custkey, c_name, CAST(c_custkey % 4 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey = 42")
def target_by_key(spark, sf_dir):
    return _customers(spark, sf_dir).where_key(F.col("c_custkey"), lambda k: F.pmod(k, F.lit(4)), 42).select("c_custkey", "c_name", "shard_id").rows()


@registered("SELECT c_custkey, c_name, 'eu-' || CAST(c_custkey % 4 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey % 4 IN (1, 2)")
def target_named_shards(spark, sf_dir):
    table = ShardedTable.by_column(_t(spark, sf_dir, "customer"), _mod("c_custkey", 4), 4, "customer", names=[f"eu-{i}" for i in range(4)])
    return table.where_shard("eu-2", "eu-1", "1").select("c_custkey", "c_name", "shard_id").rows()


@registered("SELECT c_custkey, c_name, CAST(c_custkey % 4 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey % 4 IN (1, 3)")
def target_pruned_layout(spark, sf_dir):
    """Shards in folders of their own: a target reads its folders only."""
    table = _customers(spark, sf_dir).lay_out(f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/customer")
    return table.where_shard("1", "3").select("c_custkey", "c_name", "shard_id").rows()


@registered("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 4 <> 2 AND c_acctbal > 0")
def fanout_isolated(spark, sf_dir):
    """Shards side by side, one of which fails."""
    def write(shard_id: str, rows: DataFrame) -> DataFrame:
        return staged(rows.where(F.raise_error(F.lit("down"))) if shard_id == "2" else rows, f"shard{shard_id}")

    return isolated(_customers(spark, sf_dir).where(F.col("c_acctbal") > 0).select("c_custkey", "c_name"), write, at_once=4)[0]


@registered("SELECT CAST(c_custkey % 4 AS VARCHAR) AS shard_id, count(*) AS items FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def query_metrics(spark, sf_dir):
    """What a query's metrics record counted, by shard."""
    _, seen = metrics.collect(_customers(spark, sf_dir).where(F.col("c_acctbal") > 5000).select("c_custkey", "shard_id"))
    return spark.createDataFrame(list(seen.items.items()), "shard_id string, items long")


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_documents(spark, sf_dir):
    """Shards of JSON documents, one file tree each."""
    path, rows = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for i in range(2):
        rows.where(_mod("n_nationkey", 2) == i).write.json(f"{path}/{i}")
    registry = Registry().add_many(2, lambda i: files(f"{path}/{i}", "json"))
    return ShardedTable.open(spark, registry).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")).rows()


@registered("SELECT * FROM (VALUES (0, CAST(100 AS BIGINT)), (1, 400), (2, 700), (3, 1000)) AS t(shard_index, n)")
def fixture_skew(spark, sf_dir):
    return fixtures.skewed_rows(spark, 4, 100, fixtures.Skew.HARSH).groupBy("shard_index").agg(F.count(F.lit(1)).alias("n"))


# --- merges and terminals ---


@registered("SELECT n_nationkey, n_name, n_regionkey, CAST(n_regionkey AS VARCHAR) AS shard_id, n_regionkey AS shard_index FROM nation")
def broadcast_tagged(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation")
    return merge.tagged({str(i): rows.where(F.col("n_regionkey") == i) for i in range(5)}).select("n_nationkey", "n_name", "n_regionkey", "shard_id", "shard_index")


@registered("SELECT s_suppkey, s_acctbal * 2 AS projected FROM supplier")
def broadcast_project(spark, sf_dir):
    table = ShardedTable.by_column(_t(spark, sf_dir, "supplier"), _mod("s_suppkey", 4), 4, "supplier")
    return merge.project(table, "s_suppkey", (F.col("s_acctbal") * 2).alias("projected"))


@registered("SELECT CAST(user_id % 4 AS VARCHAR) AS shard_id, count(*) AS n FROM events GROUP BY 1")
def demux_by_shard(spark, sf_dir):
    return merge.by_shard(ShardedTable.by_column(_t(spark, sf_dir, "events"), _mod("user_id", 4), 4).rows())


@registered("SELECT event_id, user_id FROM events WHERE user_id % 4 = 2")
def demux_one_shard(spark, sf_dir):
    return merge.shard(ShardedTable.by_column(_t(spark, sf_dir, "events"), _mod("user_id", 4), 4).rows(), "2").select("event_id", "user_id")


def _dated(spark, sf_dir) -> DataFrame:
    return _orders(spark, sf_dir).rows().select("o_orderkey", "o_orderdate", F.col("shard_index").cast("long").alias("shard_index"))


@registered("SELECT o_orderkey, o_orderdate, o_custkey % 4 AS shard_index, row_number() OVER (ORDER BY o_orderdate, o_custkey % 4, o_orderkey) AS rank FROM orders")
def merge_ranked(spark, sf_dir):
    return merge.ranked(_dated(spark, sf_dir), merge.order("o_orderdate", "o_orderkey"))


@registered("SELECT o_orderkey, o_orderdate, o_custkey % 4 AS shard_index FROM orders ORDER BY o_orderdate, o_custkey % 4, o_orderkey")
def merge_ordered_asc(spark, sf_dir):
    return merge.ordered(_dated(spark, sf_dir), "o_orderdate", "o_orderkey")


@registered("SELECT o_orderkey, o_orderdate, o_custkey % 4 AS shard_index FROM orders ORDER BY o_orderdate DESC, o_custkey % 4 DESC, o_orderkey")
def merge_ordered_desc(spark, sf_dir):
    return merge.ordered(_dated(spark, sf_dir), "o_orderdate", "o_orderkey", descending=True)


@registered("SELECT c_custkey, c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey % 4, c_custkey) AS rank FROM customer WHERE c_acctbal > 0")
def merge_ordered_projected(spark, sf_dir):
    rows = _customers(spark, sf_dir).where(F.col("c_acctbal") > 0).select("c_custkey", F.col("c_mktsegment").alias("segment"), "shard_index").rows()
    return merge.ranked(rows, merge.order("segment", "c_custkey", descending=True, shard_ascending=True)).drop("shard_index")


@registered("SELECT event_id, ts FROM events ORDER BY ts, user_id % 3, event_id")
def merge_sorted_by(spark, sf_dir):
    rows = ShardedTable.by_column(_t(spark, sf_dir, "events"), _mod("user_id", 3), 3).rows().select("event_id", "ts", "shard_index")
    return merge.merge_sorted_by(rows, "ts", "event_id").drop("shard_index")


@registered("SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn")
def merge_composite_key(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role").orderBy("conv_id", "turn")


@registered("SELECT o_orderkey, o_totalprice, CAST(o_custkey % 4 AS VARCHAR) AS shard_id FROM orders WHERE o_custkey % 4 IN (0, 1, 3) ORDER BY o_totalprice DESC, o_custkey % 4 DESC, o_orderkey LIMIT 25")
def ordered_top_k(spark, sf_dir):
    rows = _orders(spark, sf_dir).where_shard("0", "1", "3").rows()
    return merge.top(rows, "o_totalprice", "o_orderkey", 25, descending=True).select("o_orderkey", "o_totalprice", "shard_id")


@registered("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def terminal_count(spark, sf_dir):
    return terminals.count(ShardedTable.by_column(_t(spark, sf_dir, "lineitem"), _mod("l_orderkey", 8), 8).where(F.col("l_quantity") > 25).rows())


@registered("SELECT count(*) > 0 AS found FROM lineitem WHERE l_discount > 0.05")
def terminal_any(spark, sf_dir):
    return terminals.any_rows(_t(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0.05))


@registered("SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity < 0")
def terminal_any_none(spark, sf_dir):
    return terminals.any_rows(_t(spark, sf_dir, "lineitem").where(F.col("l_quantity") < 0))


@registered("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1")
def terminal_first_ordered(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return terminals.first(rows, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")


# --- hashes ---


def _le32(hexes: str) -> str:
    h = f"sha256({hexes})"
    return f"CAST('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2) AS BIGINT)"


def _le_bytes(key: str, size: int) -> str:
    """The blob of a non-negative integer's little-endian bytes."""
    digits = f"lpad(hex(CAST({key} AS UBIGINT)), {2 * size}, '0')"
    return "unhex(" + " || ".join(f"substr({digits}, {2 * k + 1}, 2)" for k in reversed(range(size))) + ")"


@registered(f"SELECT c_custkey, {_le32('c_name')} AS h FROM customer")
def hash_string_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.string_key_hash(F.col("c_name")).alias("h"))


@registered(f"SELECT page_id, {_le32('url')} AS h FROM pages")
def hash_url_key(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", H.string_key_hash(F.col("url")).alias("h"))


@registered(f"SELECT n_nationkey, {_le32(_le_bytes('n_nationkey', 4))} AS h FROM nation")
def hash_int_key(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select("n_nationkey", H.int_key_hash(F.col("n_nationkey")).alias("h"))


@registered(f"SELECT c_custkey, {_le32(_le_bytes('(4294967296 - c_custkey) % 4294967296', 4))} AS h FROM customer")
def hash_negative_int_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.int_key_hash((-F.col("c_custkey")).cast("int")).alias("h"))


@registered(f"SELECT c_custkey, {_le32(_le_bytes('4294967295 - c_custkey', 4))} AS h FROM customer")
def hash_uint_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.uint_key_hash(F.lit(4294967295) - F.col("c_custkey")).alias("h"))


@registered(f"SELECT o_orderkey, {_le32(_le_bytes('o_orderkey', 8))} AS h FROM orders")
def hash_long_key(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders")
    return rows.select("o_orderkey", H.key_hash(F.col("o_orderkey"), rows.schema["o_orderkey"].dataType).alias("h"))


_GUID = "unhex(" + " || ".join(f"substr(md5(c_name), {2 * k + 1}, 2)" for k in (3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15)) + ")"


@registered(f"SELECT c_custkey, {_le32(_GUID)} AS h FROM customer")
def hash_guid_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.guid_key_hash(F.md5("c_name")).alias("h"))


_CHARS = "list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(substr(c_name, i, 1)) AS HUGEINT))"


@registered(f"SELECT c_custkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), {_CHARS}), lambda a, x: (CAST(xor(CAST(a AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * 16777619) % 4294967296) AS BIGINT) AS h FROM customer")
def hash_fnv1a32(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.fnv1a32(F.col("c_name")).alias("h"))


@registered(f"""SELECT c_custkey, CAST(v // 4294967296 AS BIGINT) AS h, CAST(v % 4294967296 AS BIGINT) AS l FROM (
  SELECT c_custkey, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), {_CHARS}), lambda a, x: (CAST(xor(CAST(a AS UBIGINT), CAST(x AS UBIGINT)) AS HUGEINT) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS v FROM customer)""")
def hash_fnv1a64(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", H.fnv1a64(F.col("c_name")).alias("v")).select("c_custkey", "v.h", "v.l")


# --- routing ---


def _hashed(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shard_key"), H.string_key_hash(F.col("c_name")).alias("h"))


_HASHED = f"SELECT c_custkey AS shard_key, {_le32('c_name')} AS h FROM customer"


def _ring_sql(shards: list[str], replication: int) -> str:
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    point = _le32("shard_id || '-replica-' || CAST(replica AS VARCHAR)")
    return f"""SELECT point, shard_id, shard_index FROM (
      SELECT *, row_number() OVER (PARTITION BY point ORDER BY shard_index, replica) AS n FROM (
        SELECT shard_index, shard_id, replica, {point} AS point FROM (VALUES {names}) AS s(shard_index, shard_id), range({replication}) AS r(replica)) AS p) AS q WHERE n = 1"""


def _route_sql(keys: str, shards: list[str], replication: int) -> str:
    return f"""SELECT k.shard_key, coalesce(r.shard_id, (SELECT arg_min(shard_id, point) FROM ({_ring_sql(shards, replication)}) AS w)) AS shard_id
      FROM ({keys}) AS k ASOF LEFT JOIN ({_ring_sql(shards, replication)}) AS r ON k.h <= r.point"""


@registered(f"SELECT shard_key, 's' || CAST(h % 4 AS VARCHAR) AS shard_id FROM ({_HASHED}) AS k")
def route_hash_mod(spark, sf_dir):
    return ring.route(_hashed(spark, sf_dir), "h", S4, ring.RouterOptions(consistent=False)).select("shard_key", "shard_id")


@registered(f"SELECT shard_id, replica, {_le32("shard_id || '-replica-' || CAST(replica AS VARCHAR)")} AS point FROM (VALUES (0, 's0'), (1, 's1'), (2, 's2'), (3, 's3')) AS s(shard_index, shard_id), (SELECT CAST(range AS INTEGER) AS replica FROM range(50)) AS r")
def ring_points(spark, sf_dir):
    return ring.points(spark, S4, ring.RouterOptions(replication=50)).select("shard_id", "replica", "point")


@registered(f"SELECT point, shard_id FROM ({_ring_sql(S4, 100)}) AS x")
def ring_collision_first_wins(spark, sf_dir):
    return ring.ring(spark, S4).select("point", "shard_id")


@registered(_route_sql(_HASHED, S4, 100))
def route_consistent(spark, sf_dir):
    return ring.route(_hashed(spark, sf_dir), "h", S4).select("shard_key", "shard_id")


@registered(_route_sql(f"SELECT o_orderkey AS shard_key, {_le32(_le_bytes('o_orderkey', 8))} AS h FROM orders", S4, 100))
def route_consistent_orders(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard_key"), H.long_key_hash(F.col("o_orderkey")).alias("h"))
    return ring.route(keys, "h", S4).select("shard_key", "shard_id")


_STORED = "SELECT c_custkey AS shard_key, 's' || CAST(c_custkey % 3 AS VARCHAR) AS shard_id FROM customer WHERE c_custkey % 2 = 0"


def _stored(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").where(_mod("c_custkey", 2) == 0)
    return rows.select(F.col("c_custkey").alias("shard_key"), F.concat(F.lit("s"), _mod("c_custkey", 3)).alias("shard_id"))


@registered(f"""SELECT r.shard_key, coalesce(m.shard_id, r.shard_id) AS shard_id, m.shard_id IS NOT NULL AS was_existing
  FROM ({_route_sql(_HASHED, S4, 100)}) AS r LEFT JOIN ({_STORED}) AS m ON m.shard_key = r.shard_key""")
def route_with_existing_map(spark, sf_dir):
    routed = ring.route(_hashed(spark, sf_dir), "h", S4).select("shard_key", "shard_id")
    return ring.resolve(routed, _stored(spark, sf_dir), S4)


_LEFT = ["s0", "s1", "s3"]
_REPAIR = f"""SELECT r.shard_key, CASE WHEN m.shard_id <> 's2' THEN m.shard_id ELSE r.shard_id END AS shard_id, coalesce(m.shard_id <> 's2', false) AS was_existing
  FROM ({_route_sql(_HASHED, _LEFT, 100)}) AS r LEFT JOIN ({_STORED}) AS m ON m.shard_key = r.shard_key"""


@registered(_REPAIR)
def route_removed_shard_reassign(spark, sf_dir):
    routed = ring.route(_hashed(spark, sf_dir), "h", _LEFT).select("shard_key", "shard_id")
    return ring.resolve(routed, _stored(spark, sf_dir), _LEFT)


@registered(f"SELECT shard_key, shard_id FROM ({_REPAIR}) AS x WHERE NOT was_existing")
def route_new_assignments(spark, sf_dir):
    return ring.delta(route_removed_shard_reassign(spark, sf_dir))


@registered(f"SELECT count(*) AS routed, count(*) FILTER (WHERE was_existing) AS hits, count(*) FILTER (WHERE NOT was_existing) AS misses FROM ({_REPAIR}) AS x")
def route_metrics(spark, sf_dir):
    return ring.route_metrics(route_removed_shard_reassign(spark, sf_dir))


@registered(_route_sql(_HASHED, ["s1", "s2", "s3"], 100).replace("SELECT k.shard_key", "SELECT k.shard_key, false AS was_existing"))
def router_add_and_remove(spark, sf_dir):
    """A router that a shard joined and another left."""
    own = ring.router(spark, S3, ring.RouterOptions(key_hash=F.col))
    own.add("s3")
    own.remove("s0")
    keys = _hashed(spark, sf_dir)
    return ring.route(keys, "h", own.shards, own.options).select("shard_key", "shard_id", F.lit(False).alias("was_existing"))


def _churn_sql(before: list[str], after: list[str]) -> str:
    return f"SELECT count(*) AS keys, count(*) FILTER (WHERE a.shard_id <> b.shard_id) AS moved FROM ({_route_sql(_HASHED, before, 100)}) AS a JOIN ({_route_sql(_HASHED, after, 100)}) AS b ON a.shard_key = b.shard_key"


def _churn(spark, sf_dir, before: list[str], after: list[str]) -> DataFrame:
    keys = _hashed(spark, sf_dir)
    return ring.churn(ring.route(keys, "h", before), ring.route(keys, "h", after))


@registered(_churn_sql(S3, S4))
def ring_add_shard_churn(spark, sf_dir):
    return _churn(spark, sf_dir, S3, S4)


@registered(_churn_sql(S4, S3))
def ring_remove_shard_churn(spark, sf_dir):
    return _churn(spark, sf_dir, S4, S3)


@registered(f"SELECT count(*) AS shards, avg(n) AS mean_keys, round(stddev_pop(n) / avg(n), 9) AS cv FROM (SELECT shard_id, count(*) AS n FROM ({_route_sql(_HASHED, S4, 120)}) AS x GROUP BY shard_id) AS y")
def ring_distribution_stats(spark, sf_dir):
    found = ring.distribution(ring.route(_hashed(spark, sf_dir), "h", S4, ring.RouterOptions(replication=120)))
    return found.withColumn("cv", F.round("cv", 9))


# --- shard map ---

_MAP = "SELECT o_orderkey AS shard_key, 's' || CAST(o_orderkey % 3 AS VARCHAR) AS shard_id FROM orders WHERE o_orderkey % 2 = 0"
_BATCH = "SELECT o_orderkey AS shard_key, 's' || CAST(o_custkey % 4 AS VARCHAR) AS shard_id FROM orders WHERE o_orderkey % 5 = 0"


def _map(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "orders")
    named = lambda key, n: F.concat(F.lit("s"), _mod(key, n)).alias("shard_id")
    key = F.col("o_orderkey").alias("shard_key")
    return rows.where(_mod("o_orderkey", 2) == 0).select(key, named("o_orderkey", 3)), rows.where(_mod("o_orderkey", 5) == 0).select(key, named("o_custkey", 4))


@registered(f"SELECT b.shard_key, coalesce(m.shard_id, b.shard_id) AS shard_id, m.shard_id IS NULL AS created FROM ({_BATCH}) AS b LEFT JOIN ({_MAP}) AS m ON m.shard_key = b.shard_key")
def map_try_assign_cas(spark, sf_dir):
    return shard_map.try_assign(*_map(spark, sf_dir))


@registered("SELECT o_custkey AS shard_key, 's' || CAST(min(o_orderkey) % 4 AS VARCHAR) AS shard_id, true AS created FROM orders GROUP BY o_custkey")
def map_try_assign_race(spark, sf_dir):
    batch = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard_key"), F.concat(F.lit("s"), _mod("o_orderkey", 4)).alias("shard_id"), F.col("o_orderkey").alias("written"))
    return shard_map.try_assign(spark.createDataFrame([], "shard_key bigint, shard_id string"), batch, "written")


@registered(f"SELECT b.shard_key, coalesce(m.shard_id, b.shard_id) AS shard_id FROM ({_BATCH}) AS b LEFT JOIN ({_MAP}) AS m ON m.shard_key = b.shard_key")
def map_get_or_add(spark, sf_dir):
    return shard_map.get_or_add(*_map(spark, sf_dir))


@registered(f"SELECT b.shard_key, m.shard_id FROM (SELECT o_orderkey AS shard_key FROM orders WHERE o_orderkey % 3 = 0) AS b LEFT JOIN ({_MAP}) AS m ON m.shard_key = b.shard_key")
def map_lookup(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").where(_mod("o_orderkey", 3) == 0).select(F.col("o_orderkey").alias("shard_key"))
    return shard_map.lookup(_map(spark, sf_dir)[0], keys)


@registered(f"SELECT shard_key, shard_id FROM ({_MAP}) AS m WHERE shard_key NOT IN (SELECT shard_key FROM ({_BATCH}) AS b) UNION ALL SELECT shard_key, shard_id FROM ({_BATCH}) AS c")
def map_upsert(spark, sf_dir):
    return shard_map.upsert(*_map(spark, sf_dir))


@registered(f"SELECT b.shard_key, m.shard_id AS old_shard_id, b.shard_id AS new_shard_id, TIMESTAMP '2024-01-01 00:00:00' AS changed_at FROM ({_BATCH}) AS b LEFT JOIN ({_MAP}) AS m ON m.shard_key = b.shard_key WHERE m.shard_id IS DISTINCT FROM b.shard_id")
def map_history(spark, sf_dir):
    return shard_map.history(*_map(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@registered(f"SELECT shard_key, shard_id FROM ({_MAP}) AS m ORDER BY shard_key")
def map_enumerate(spark, sf_dir):
    return shard_map.enumerate_map(_map(spark, sf_dir)[0])


@registered(f"SELECT 'shardmap:' || CAST(shard_key AS VARCHAR) AS key, shard_id AS value FROM ({_MAP}) AS m")
def map_export(spark, sf_dir):
    return shard_map.exported(_map(spark, sf_dir)[0])


# --- topology ---


def _topology(spark, sf_dir, n: int) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shard_key"), F.concat(F.lit("s"), _mod("c_custkey", n)).alias("shard_id"))


def _topology_sql(n: int) -> str:
    return f"SELECT c_custkey AS shard_key, 's' || CAST(c_custkey % {n} AS VARCHAR) AS shard_id FROM customer"


@registered(_topology_sql(3))
def topology_snapshot(spark, sf_dir):
    return topology.snapshot(_topology(spark, sf_dir, 3), 100_000_000)


@registered(f"SELECT shard_id, count(*) AS keys FROM ({_topology_sql(3)}) AS t GROUP BY shard_id")
def topology_counts(spark, sf_dir):
    return topology.counts(_topology(spark, sf_dir, 3))


@registered("SELECT o_custkey AS shard_key, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def topology_duplicates(spark, sf_dir):
    return topology.duplicates(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard_key")))


@registered("SELECT upper(sha256(string_agg(c_name || '->s' || CAST(c_custkey % 3 AS VARCHAR), ';' ORDER BY c_name))) AS fingerprint FROM customer")
def topology_fingerprint(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("shard_key"), F.concat(F.lit("s"), _mod("c_custkey", 3)).alias("shard_id"))
    return topology.fingerprint(rows)


def _tree_sql() -> str:
    level = "SELECT substr(sha256(k), 1, 3) AS part, sha256(string_agg(p, ';' ORDER BY p)) AS digest FROM (SELECT c_name AS k, c_name || '->s' || CAST(c_custkey % 3 AS VARCHAR) AS p FROM customer) AS t GROUP BY 1"
    for n in (2, 1, 0):
        level = f"SELECT substr(part, 1, {n}) AS part, sha256(string_agg(part || digest, '' ORDER BY part)) AS digest FROM ({level}) AS l{n} GROUP BY 1"
    return f"SELECT upper(digest) AS fingerprint FROM ({level}) AS t"


@registered(_tree_sql())
def topology_fingerprint_tree(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("shard_key"), F.concat(F.lit("s"), _mod("c_custkey", 3)).alias("shard_id"))
    return topology.fingerprint_tree(rows)


@registered("SELECT o_custkey AS shard_key, 's' || CAST(arg_max(o_orderkey, o_orderkey) % 3 AS VARCHAR) AS shard_id FROM orders GROUP BY 1")
def topology_snapshot_last_wins(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard_key"), F.concat(F.lit("s"), _mod("o_orderkey", 3)).alias("shard_id"), "o_orderkey")
    return topology.snapshot(rows, 100_000_000, order="o_orderkey")


@registered(f"SELECT shard_key, shard_id FROM ({_topology_sql(3)}) AS a EXCEPT ALL SELECT shard_key, shard_id FROM ({_topology_sql(4)}) AS b")
def topology_difference(spark, sf_dir):
    return topology.difference(_topology(spark, sf_dir, 3), _topology(spark, sf_dir, 4))


_FIVE = "CASE WHEN shard_key % 5 = 0 THEN 's0' ELSE 's1' END"


def _five(key: Column) -> Column:
    return F.when(F.pmod(key, F.lit(5)) == 0, "s0").otherwise("s1")


@registered(f"SELECT shard_key, {_FIVE} AS shard_id FROM ({_topology_sql(3)}) AS t")
def rebalance_all(spark, sf_dir):
    return topology.rebalance(_topology(spark, sf_dir, 3), _five)


@registered(f"SELECT shard_key, {_FIVE} AS shard_id FROM ({_topology_sql(3)}) AS t WHERE shard_id <> {_FIVE}")
def rebalance_only_changes(spark, sf_dir):
    return topology.rebalance(_topology(spark, sf_dir, 3), _five, only_changes=True)


_FNV64 = ORACLE_SQL["hash_fnv1a64"]


@registered(f"SELECT c.c_name AS shard_key, 's' || CAST((CAST(f.h AS HUGEINT) * 4294967296 + f.l) % 3 AS VARCHAR) AS shard_id FROM ({_FNV64}) AS f JOIN customer AS c ON c.c_custkey = f.c_custkey")
def rebalance_hash(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("shard_key"), F.lit("s9").alias("shard_id"))
    return topology.rebalance_by_hash(rows, S3, H.fnv1a64)


# --- planning and migration ---


def _plan_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _topology(spark, sf_dir, 3), _topology(spark, sf_dir, 4).where(_mod("shard_key", 7) != 0)


_TO = f"SELECT shard_key, shard_id FROM ({_topology_sql(4)}) AS t WHERE shard_key % 7 <> 0"
_MOVES = f"SELECT a.shard_key, a.shard_id AS source_shard, b.shard_id AS target_shard FROM ({_topology_sql(3)}) AS a JOIN ({_TO}) AS b ON a.shard_key = b.shard_key WHERE a.shard_id <> b.shard_id"


@registered(_MOVES)
def plan_moves(spark, sf_dir):
    return M.moves(*_plan_inputs(spark, sf_dir))


_FNV64_KEY = _FNV64.replace("length(c_name)", "length(CAST(c_custkey AS VARCHAR))").replace("substr(c_name", "substr(CAST(c_custkey AS VARCHAR)")


@registered(f"""SELECT m.shard_key, m.source_shard, m.target_shard, row_number() OVER (ORDER BY m.source_shard, m.target_shard, f.h, f.l, m.shard_key) - 1 AS ord, 'Planned' AS state
  FROM ({_MOVES}) AS m JOIN ({_FNV64_KEY}) AS f ON f.c_custkey = m.shard_key""")
def plan_moves_ordered(spark, sf_dir):
    return M.plan(*_plan_inputs(spark, sf_dir))


@registered(f"SELECT count(*) AS examined, count(*) FILTER (WHERE b.shard_id <> a.shard_id) AS moves FROM ({_topology_sql(3)}) AS a LEFT JOIN ({_TO}) AS b ON a.shard_key = b.shard_key")
def plan_dry_run(spark, sf_dir):
    return M.dry_run(*_plan_inputs(spark, sf_dir))


@registered(f"SELECT source_shard, target_shard, count(*) AS moves FROM ({_MOVES}) AS m GROUP BY ALL")
def plan_pair_counts(spark, sf_dir):
    return M.pair_counts(M.moves(*_plan_inputs(spark, sf_dir)))


def _rows_with_versions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves, source rows, and target rows of which some were mutated and some are missing."""
    version = F.when(_mod("c_custkey", 6) != 0, F.md5(F.col("c_name")).cast("binary")).alias("row_version")
    source = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", version)
    mutated = _mod("c_custkey", 10) == 0
    target = source.where(_mod("c_custkey", 11) != 0).select(
        "c_custkey", F.when(mutated, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), "c_acctbal",
        F.when(mutated, F.md5(F.concat("c_name", F.lit("!"))).cast("binary")).otherwise(F.col("row_version")).alias("row_version"),
    )
    return M.moves(*_plan_inputs(spark, sf_dir)), source, target


def _verified(spark, sf_dir, **how) -> DataFrame:
    found, source, target = _rows_with_versions(spark, sf_dir)
    return M.verified(found, source, target, "c_custkey", **how).select("shard_key", "verified")


@registered(f"SELECT shard_key, shard_key % 11 <> 0 AND shard_key % 10 <> 0 AND shard_key % 6 <> 0 AS verified FROM ({_MOVES}) AS m")
def verify_rowversion(spark, sf_dir):
    return _verified(spark, sf_dir, how=M.Verification.ROW_VERSION)


@registered(f"SELECT shard_key, shard_key % 11 <> 0 AND shard_key % 10 <> 0 AS verified FROM ({_MOVES}) AS m")
def verify_checksum(spark, sf_dir):
    return _verified(spark, sf_dir, how=M.Verification.CHECKSUM)


@registered(f"SELECT shard_key, shard_key % 11 <> 0 AND shard_key % 10 <> 0 AS verified FROM ({_MOVES}) AS m")
def verify_full(spark, sf_dir):
    return _verified(spark, sf_dir, how=M.Verification.FULL)


@registered(f"SELECT shard_key, shard_key % 11 <> 0 AND (shard_key % 10 <> 0 OR shard_key % 6 = 0) AS verified FROM ({_MOVES}) AS m")
def verify_weak(spark, sf_dir):
    return _verified(spark, sf_dir, how=M.Verification.WEAK)


@registered(f"SELECT shard_key, true AS verified FROM ({_MOVES}) AS m")
def verify_force(spark, sf_dir):
    return _verified(spark, sf_dir, force=True)


@registered(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 0 OR c_custkey IN (SELECT shard_key FROM ({_MOVES}) AS m)")
def migrate_copy_upsert(spark, sf_dir):
    source = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    stale = source.where(_mod("c_custkey", 4) == 0).withColumn("c_acctbal", F.col("c_acctbal") + F.lit(0.0))
    return M.copy_rows(source, stale, M.moves(*_plan_inputs(spark, sf_dir)), "c_custkey")


@registered(f"SELECT a.shard_key, coalesce(m.target_shard, a.shard_id) AS shard_id FROM ({_topology_sql(3)}) AS a LEFT JOIN ({_MOVES}) AS m ON m.shard_key = a.shard_key")
def migrate_swap(spark, sf_dir):
    ready = M.moves(*_plan_inputs(spark, sf_dir)).withColumn("state", F.lit("Verified"))
    return M.swapped(_topology(spark, sf_dir, 3), ready)[0]


@registered(f"SELECT shard_key, source_shard, target_shard FROM ({_MOVES}) AS m WHERE shard_key % 3 = 0")
def migrate_resume(spark, sf_dir):
    found = M.moves(*_plan_inputs(spark, sf_dir))
    state = F.when(_mod("shard_key", 3) == 0, "Planned").when(_mod("shard_key", 3) == 1, "Copied").otherwise("Done")
    return M.pending(found, found.select("shard_key", state.alias("state")))


def _states(spark, sf_dir) -> DataFrame:
    names = F.array(*map(F.lit, M.STATES))
    return M.moves(*_plan_inputs(spark, sf_dir)).withColumn("state", F.element_at(names, (_mod("shard_key", 8) + 1).cast("int")))


@registered(f"""SELECT count(*) AS total, count(*) FILTER (WHERE shard_key % 8 BETWEEN 2 AND 6) AS copied, count(*) FILTER (WHERE shard_key % 8 BETWEEN 4 AND 6) AS verified,
  count(*) FILTER (WHERE shard_key % 8 = 6) AS swapped, count(*) FILTER (WHERE shard_key % 8 = 7) AS failed FROM ({_MOVES}) AS m""")
def migrate_progress(spark, sf_dir):
    return M.progress(_states(spark, sf_dir))


@registered(f"SELECT count(*) AS planned, count(*) FILTER (WHERE shard_key % 8 = 6) AS done, count(*) FILTER (WHERE shard_key % 8 = 7) AS failed FROM ({_MOVES}) AS m")
def migrate_summary(spark, sf_dir):
    return M.summary(_states(spark, sf_dir))


@registered(f"SELECT shard_key, source_shard, target_shard, CASE WHEN shard_key % 13 = 0 THEN 'Failed' ELSE 'Done' END AS state FROM ({_MOVES}) AS m")
def migrate_end_to_end(spark, sf_dir):
    source, target = (_t(spark, sf_dir, "customer").select("c_custkey", "c_name") for _ in range(2))
    found = M.moves(*_plan_inputs(spark, sf_dir)).withColumn("state", F.lit("Planned"))
    gone = source.where(_mod("c_custkey", 13) != 0)  # a key without a source row can't be verified
    done, _, _ = M.execute(found, gone, target.limit(0), _topology(spark, sf_dir, 3), "c_custkey")
    return done


def _execution(spark, sf_dir, numbered: bool = False, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    found = M.plan(*_plan_inputs(spark, sf_dir)) if numbered else M.moves(*_plan_inputs(spark, sf_dir)).withColumn("state", F.lit("Planned"))
    target = how.pop("target", rows.limit(0))
    return M.execute(found, rows, target, _topology(spark, sf_dir, 3), "c_custkey", **how)


@registered(f"SELECT c_custkey AS c_custkey, upper(c_name) AS label FROM customer WHERE c_custkey IN (SELECT shard_key FROM ({_MOVES}) AS m)")
def migrate_projected(spark, sf_dir):
    """Rows of a changed schema, copied and verified through one projection."""
    project = lambda df: df.select("c_custkey", F.upper("c_name").alias("label"))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    moved, target, _ = _execution(spark, sf_dir, target=project(rows).limit(0), project=project)
    return target.join(moved.where("state = 'Done'").select(F.col("shard_key").alias("c_custkey")), "c_custkey", "left_semi")


@registered(f"SELECT shard_key, 'Done' AS state FROM ({_MOVES}) AS m")
def migrate_other_column_order(spark, sf_dir):
    target = _t(spark, sf_dir, "customer").select("c_acctbal", "c_name", "c_custkey").limit(0)
    return _execution(spark, sf_dir, target=target)[0].select("shard_key", "state")


@registered(f"SELECT shard_key, 'Done' AS state, 4 AS pauses FROM ({_MOVES}) AS m")
def migrate_retry(spark, sf_dir):
    """Copy and swap fail twice each before they work."""
    tries, pauses = collections.Counter(), []

    def stage(df: DataFrame, name: str) -> DataFrame:
        tries[name] += 1
        if name in ("copy", "swap") and tries[name] <= 2:
            raise OSError("not yet")
        return staged(df, name)

    done = _execution(spark, sf_dir, stage=stage, sleep=pauses.append)[0]
    return done.select("shard_key", "state", F.lit(len(pauses)).alias("pauses"))


@registered(f"SELECT shard_key, 'Failed' AS state FROM ({_MOVES}) AS m")
def migrate_retries_exhausted(spark, sf_dir):
    """A swap that never works fails its moves, and the run goes on to its end."""
    def stage(df: DataFrame, name: str) -> DataFrame:
        if name == "swap":
            raise OSError("never")
        return staged(df, name)

    return _execution(spark, sf_dir, stage=stage, sleep=lambda s: None)[0].select("shard_key", "state")


_HALVES = f"SELECT count(*) AS n, (count(*) + 1) // 2 AS b FROM ({_MOVES}) AS m"


@registered(f"""SELECT stage, CAST(batch AS INTEGER) AS batch, n AS total, least(n, (batch + 1) * b) AS copied, least(n, (batch + CAST(stage <> 'copy' AS INTEGER)) * b) AS verified,
  least(n, (batch + CAST(stage = 'swap' AS INTEGER)) * b) AS swapped, CAST(0 AS BIGINT) AS failed FROM ({_HALVES}) AS h, (VALUES ('copy'), ('verify'), ('swap')) AS s(stage), range(2) AS r(batch)""")
def migrate_progress_events(spark, sf_dir):
    """The progress after every stage of two batches."""
    seen: list[M.Progress] = []
    size = (M.moves(*_plan_inputs(spark, sf_dir)).count() + 1) // 2
    _execution(spark, sf_dir, numbered=True, options=M.Options(batch_moves=size, progress_s=0), observer=seen.append)
    return spark.createDataFrame([(p.stage, p.batch, p.total, p.copied, p.verified, p.swapped, p.failed) for p in seen], "stage string, batch int, total long, copied long, verified long, swapped long, failed long")


@registered(f"SELECT shard_key, row_number() OVER (ORDER BY shard_key) <= 0 AS lost, 'Done' AS state FROM ({_MOVES}) AS m")
def migrate_checkpointed(spark, sf_dir):
    """The checkpoint that a run in two batches left, read back."""
    store = checkpoint.CheckpointStore(spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/checkpoints")
    versions = itertools.count()
    size = (M.moves(*_plan_inputs(spark, sf_dir)).count() + 1) // 2
    write = lambda found: store.persist(checkpoint.encoded(found, "p", next(versions), F.current_timestamp()))
    _execution(spark, sf_dir, numbered=True, options=M.Options(batch_moves=size, checkpoint_s=0), checkpoint=write)
    left = checkpoint.decoded(store.load("p"))
    return left.select(F.col("shard_key").cast("long").alias("shard_key"), F.lit(False).alias("lost"), "state")


@registered(f"SELECT source_shard, target_shard, count(*) AS planned, count(*) FILTER (WHERE shard_key % 8 = 6) AS done, count(*) FILTER (WHERE shard_key % 8 = 7) AS failed, count(*) FILTER (WHERE shard_key % 8 < 6) AS open, count(*) FILTER (WHERE shard_key % 8 = 7) / count(*) AS failed_share FROM ({_MOVES}) AS m GROUP BY ALL")
def migrate_metrics(spark, sf_dir):
    return metrics.migration_counts(_states(spark, sf_dir))


@registered(f"SELECT shard_key, shard_key % 11 <> 0 AS verified FROM ({_MOVES}) AS m")
def verify_present(spark, sf_dir):
    return _verified(spark, sf_dir, how=M.Verification.PRESENT)


_STATE = "['" + "', '".join(M.STATES) + "'][o_orderkey % 8 + 1]"


@registered(f"SELECT 'plan-1' AS plan_id, 1 AS version, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 8 <> 0) AS last_index, CAST(o_orderkey AS VARCHAR) AS shard_key, {_STATE} AS state FROM orders")
def checkpoint_json_roundtrip(spark, sf_dir):
    found = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("shard_key"), F.col("o_orderkey").alias("ord"), F.element_at(F.array(*map(F.lit, M.STATES)), (_mod("o_orderkey", 8) + 1).cast("int")).alias("state"))
    return checkpoint.decoded(checkpoint.encoded(found, "plan-1", 1, F.lit("2024-01-01").cast("timestamp")))


# --- health ---


def _probes(spark, sf_dir) -> DataFrame:
    ok = (F.col("event_type") != "error") & (F.col("event_type") != "signup")
    return _t(spark, sf_dir, "events").select(F.concat(F.lit("s"), _mod("user_id", 4)).alias("shard_id"), "ts", F.col("event_id").alias("seq"), ok.alias("ok"))


_FOLD = """SELECT shard_id, ts, seq, ok, coalesce(last_value(CASE WHEN NOT ok AND streak >= 3 THEN 'Unhealthy' WHEN ok AND streak >= 2 THEN 'Healthy' END IGNORE NULLS) OVER w,
    CASE WHEN max(CAST(ok AS INTEGER)) OVER w = 1 THEN 'Healthy' ELSE 'Unknown' END) AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY shard_id, run ORDER BY ts, seq) AS streak FROM (
    SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM ok THEN 0 ELSE 1 END) OVER (PARTITION BY shard_id ORDER BY ts, seq) AS run FROM (
      SELECT *, lag(ok) OVER (PARTITION BY shard_id ORDER BY ts, seq) AS prev FROM (
        SELECT 's' || CAST(user_id % 4 AS VARCHAR) AS shard_id, ts, event_id AS seq, event_type NOT IN ('error', 'signup') AS ok FROM events) AS e) AS p) AS r) AS s
  WINDOW w AS (PARTITION BY shard_id ORDER BY ts, seq)"""


@registered(_FOLD)
def health_state_fold(spark, sf_dir):
    return health.fold(_probes(spark, sf_dir))


@registered(f"SELECT shard_id, arg_max(status, struct_pack(a := ts, b := seq)) AS status, max(ts) AS ts FROM ({_FOLD}) AS f GROUP BY shard_id")
def health_latest(spark, sf_dir):
    return health.latest(health.fold(_probes(spark, sf_dir)))


def _reports(spark) -> DataFrame:
    return spark.createDataFrame([("0", "Healthy"), ("1", "Unhealthy"), ("3", "Degraded")], "shard_id string, status string")


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 2)")
def health_skip(spark, sf_dir):
    table = _customers(spark, sf_dir).where_shard("0", "1", "2")
    return health.gated(table, _reports(spark)).select("c_custkey").rows()


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 1, 2)")
def health_include(spark, sf_dir):
    table = _customers(spark, sf_dir).where_shard("0", "1", "2")
    return health.gated(table, _reports(spark), health.Behaviour.INCLUDE).select("c_custkey").rows()


@registered("SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 2)")
def health_gate_all(spark, sf_dir):
    return health.gated(_customers(spark, sf_dir), _reports(spark), gate_all=True, need=health.Availability(at_least=2)).select("c_custkey").rows()


@registered("SELECT * FROM (VALUES ('0'), ('2')) AS t(shard_id)")
def health_targets(spark, sf_dir):
    return health.healthy(spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "shard_id string"), _reports(spark))


@registered("SELECT CAST(4 AS BIGINT) AS total, CAST(2 AS BIGINT) AS healthy, CAST(0.5 AS DOUBLE) AS share")
def health_availability(spark, sf_dir):
    return health.availability(spark.createDataFrame([("0",), ("1",), ("2",), ("3",)], "shard_id string"), _reports(spark))


@registered("SELECT * FROM (VALUES (0, 'a', 'Healthy'), (0, 'b', 'Unknown'), (1, 'a', 'Healthy'), (1, 'b', 'Unknown'), (2, 'a', 'Healthy'), (2, 'b', 'Unhealthy'), (3, 'a', 'Healthy'), (3, 'b', 'Unhealthy'), (4, 'a', 'Healthy'), (4, 'b', 'Healthy')) AS t(round, shard_id, status)")
def health_policy_cooldown(spark, sf_dir):
    """Rounds of live probes of a shard that is down at first, 30 seconds apart; in its cooldown it is left alone."""
    now, down, asked = [0.0], [True], []

    def flaky(session: SparkSession) -> DataFrame:
        asked.append(now[0])
        if down[0]:
            raise OSError("down")
        return session.range(1)

    policy = health.HealthPolicy(spark, Registry().add("a", frame(spark.range(1))).add("b", flaky), timeout_s=0, clock=lambda: now[0])
    seen = []
    for n in range(5):
        down[0] = n < 3
        policy.probe()
        seen += [(n, s, status) for s, status in policy.status.items()]
        now[0] += 30.0
    return spark.createDataFrame(seen, "round int, shard_id string, status string")


# --- schedules ---


@registered("SELECT CAST(range AS INTEGER) AS attempt, CAST(least(10000, 100 * power(2, range - 1)) AS BIGINT) AS delay_ms FROM range(1, 11)")
def retry_backoff_schedule(spark, sf_dir):
    return spark.createDataFrame([(a, M.retry_delay_ms(a)) for a in range(1, 11)], "attempt int, delay_ms bigint")


@registered("""WITH RECURSIVE s(step, size) AS (SELECT 0, CAST(64 AS BIGINT) UNION ALL
  SELECT step + 1, CAST(greatest(64, least(8192, floor(CASE WHEN step % 4 < 3 THEN size * 1.5 ELSE size * 0.5 END))) AS BIGINT) FROM s WHERE step < 20) SELECT * FROM s""")
def adaptive_page_schedule(spark, sf_dir):
    sizes = [64]
    for step in range(20):
        sizes.append(next_page_size(sizes[-1], 10.0 if step % 4 < 3 else 200.0))
    return spark.createDataFrame(list(enumerate(sizes)), "step int, size bigint")


# --- beyond the sharding operators: ordinary queries on top of sharded tables ---


@registered("""SELECT c_mktsegment, CAST(o_custkey % 4 AS VARCHAR) AS shard_id, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def sharded_join_agg(spark, sf_dir):
    joined = _orders(spark, sf_dir).rows().join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("c_mktsegment", "shard_id").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@registered("""SELECT l_orderkey, l_linenumber, l_extendedprice, place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) AS t WHERE place <= 3""")
def sharded_window_rank(spark, sf_dir):
    table = ShardedTable.by_column(_t(spark, sf_dir, "lineitem"), _mod("l_orderkey", 8), 8)
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table.rows().withColumn("place", place).where("place <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice", "place")
