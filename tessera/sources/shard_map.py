"""The shard map: which shard owns a key. Assignments are a DataFrame (shard_key, shard_id).

Operations are set-based and pure: they take the stored rows and a batch and return the
new rows, which ``MapStore`` writes to a fresh folder before it sets a new pointer to it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StoreError

IDENTIFIER = re.compile(r"[A-Za-z0-9_.]+")


def checked_name(name: str) -> str:
    if not IDENTIFIER.fullmatch(name or ""):
        raise StoreError(f"not a table name: {name!r}", name=name)
    return name


def _winners(batch: DataFrame, order: Column | str | None, last: bool) -> DataFrame:
    """One row a key: in this order the first, or the last."""
    by = F.lit(0) if order is None else F.col(order) if isinstance(order, str) else order
    place = F.row_number().over(Window.partitionBy("shard_key").orderBy(by.desc() if last else by.asc(), "shard_id"))
    return batch.withColumn("_n", place).where("_n = 1").select("shard_key", "shard_id")


def lookup(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(shard_key) with their shard_id, null if unassigned."""
    return keys.join(stored.select("shard_key", "shard_id"), "shard_key", "left")


def try_assign(stored: DataFrame, batch: DataFrame, order: Column | str | None = None) -> DataFrame:
    """shard_key, shard_id (the effective one) and created, for each key of the batch: the first writer wins."""
    asked = _winners(batch, order, last=False).withColumnRenamed("shard_id", "_asked")
    both = asked.join(stored.select("shard_key", "shard_id"), "shard_key", "left")
    return both.select("shard_key", F.coalesce("shard_id", "_asked").alias("shard_id"), F.col("shard_id").isNull().alias("created"))


def get_or_add(stored: DataFrame, batch: DataFrame, order: Column | str | None = None) -> DataFrame:
    """shard_key and shard_id for each key of the batch, stored or as asked."""
    return try_assign(stored, batch, order).select("shard_key", "shard_id")


def upsert(stored: DataFrame, batch: DataFrame, order: Column | str | None = None) -> DataFrame:
    """The map after unconditional assignments: the last writer wins."""
    asked = _winners(batch, order, last=True)
    return stored.select("shard_key", "shard_id").join(asked, "shard_key", "left_anti").unionByName(asked)


def history(stored: DataFrame, batch: DataFrame, changed_at: Column, order: Column | str | None = None) -> DataFrame:
    """shard_key, old_shard_id, new_shard_id and changed_at of assignments that change something."""
    asked = _winners(batch, order, last=True).withColumnRenamed("shard_id", "new_shard_id")
    old = stored.select("shard_key", F.col("shard_id").alias("old_shard_id"))
    changed = asked.join(old, "shard_key", "left").where(~F.col("new_shard_id").eqNullSafe(F.col("old_shard_id")))
    return changed.select("shard_key", "old_shard_id", "new_shard_id", changed_at.alias("changed_at"))


def enumerate_map(stored: DataFrame) -> DataFrame:
    return stored.select("shard_key", "shard_id").orderBy("shard_key")


def exported(stored: DataFrame, prefix: str = "shardmap:") -> DataFrame:
    """key and value, as a key-value store holds them."""
    return stored.select(F.concat(F.lit(prefix), F.col("shard_key").cast("string")).alias("key"), F.col("shard_id").alias("value"))


class MapStore:
    """A shard map in a folder, copy-on-write.

    Every write makes a new version folder and then a new pointer file, numbered one higher,
    by a rename. So readers see one whole version or the other, whenever a writer stops, and of
    two writers at once the second is refused. The last ``KEPT`` versions stay for readers
    that are still at work. on_change is given the changes of every ``assign``.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", name: str = "shard_map", on_change: Callable[[DataFrame], None] | None = None):
        self.spark, self.path, self.name = spark, path.rstrip("/"), checked_name(name)
        self.schema = f"shard_key {key_type}, shard_id string"
        self.on_change = on_change

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._path(self.name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """Names of the pointer files, oldest first: numbers. Each holds the name of a version folder."""
        fs, where = self._fs(), self._path(f"{self.name}_pointers")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in names if re.fullmatch(r"\d{12}", n))

    def _version(self, pointer: str) -> str:
        return self.spark.read.text(f"{self.path}/{self.name}_pointers/{pointer}").head()[0]

    def rows(self) -> DataFrame:
        if found := self._pointers():
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.name}_versions/{self._version(found[-1])}")
        if self._fs().exists(self._path(f"{self.name}_versions")):
            raise StoreError("the map has versions but no pointer to one", path=self.path, name=self.name)
        return self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> None:
        before, version = self._pointers(), uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{self.name}_versions/{version}")
        fs, number = self._fs(), int(before[-1][:12]) + 1 if before else 0
        fs.mkdirs(self._path(f"{self.name}_pointers"))
        draft, pointer = self._path(f"{self.name}_pointers", f"_draft-{version}"), self._path(f"{self.name}_pointers", f"{number:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(version.encode()))
        out.close()
        if fs.exists(pointer) or not fs.rename(draft, pointer):
            raise StoreError("another writer changed the map", path=self.path, name=self.name)
        for old in before[: -self.KEPT + 1]:
            fs.delete(self._path(f"{self.name}_versions", self._version(old)), True)
            fs.delete(self._path(f"{self.name}_pointers", old), False)

    def assign(self, batch: DataFrame, order: Column | str | None = None) -> None:
        from ..staging import staged

        before = self.rows()
        changes = staged(history(before, batch, F.current_timestamp(), order), "changes")
        self._write(upsert(before, batch, order))
        changes.write.mode("append").parquet(f"{self.path}/{self.name}_history")
        if self.on_change:
            self.on_change(changes)

    def try_assign(self, batch: DataFrame, order: Column | str | None = None) -> DataFrame:
        """Who owns the batch's keys now, and which of them were created."""
        from ..staging import staged

        before = self.rows()
        decided = staged(try_assign(before, batch, order), "assigned")
        self._write(before.unionByName(decided.where("created").select("shard_key", "shard_id")))
        return decided

    def history(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.name}_history")
