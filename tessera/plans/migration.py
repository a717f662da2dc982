"""Migrations: plans of key moves, and their execution in set-based stages.

State is a table moves(ord, shard_key, source_shard, target_shard, state). Each stage is a
function from moves to moves: copy, verify, swap. ``execute`` runs them over batches of
moves, tries a failing stage again, and hands out a checkpoint and a progress event after
each; a resumed run takes up every move that isn't done.
"""

from __future__ import annotations

import enum
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MigrationError
from ..functions.hashing import fnv1a64
from ..metrics import described
from ..operators.merge import ranked
from ..sources import shard_map
from ..staging import staged

log = logging.getLogger(__name__)

#: States of a move, in order.
STATES = ("Planned", "Copying", "Copied", "Verifying", "Verified", "Swapping", "Done", "Failed")


class Verification(enum.Enum):
    """How rows are compared. PRESENT asks only whether both rows are there (a hash-only check without a hash)."""

    PRESENT = "present"
    FULL = "full"
    ROW_VERSION = "row_version"
    WEAK = "weak"
    CHECKSUM = "checksum"


@dataclass(frozen=True)
class Options:
    max_retries: int = 5
    base_delay_ms: int = 100
    max_delay_ms: int = 10_000
    force_swap: bool = False
    verification: Verification = Verification.CHECKSUM
    batch_moves: int | None = None
    checkpoint_s: float = 2.0
    progress_s: float = 1.0

    def __post_init__(self) -> None:
        if self.batch_moves is not None and self.batch_moves < 1 or min(self.checkpoint_s, self.progress_s) < 0:
            raise ValueError("a batch must hold a move, and intervals must not be negative")
        if self.max_retries < 0 or self.base_delay_ms <= 0 or self.max_delay_ms < self.base_delay_ms:
            raise ValueError("retries and delays must be positive and ordered")


@dataclass(frozen=True)
class Progress:
    """How far an execution has come, after a stage of a batch."""

    stage: str
    batch: int
    total: int
    copied: int
    verified: int
    swapped: int
    failed: int
    elapsed_s: float


def moves(source: DataFrame, target: DataFrame) -> DataFrame:
    """Keys whose shard differs; keys that either side lacks don't move."""
    to = target.select("shard_key", F.col("shard_id").alias("target_shard"))
    both = source.select("shard_key", F.col("shard_id").alias("source_shard")).join(to, "shard_key")
    return both.where("source_shard <> target_shard")


def plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """The moves in a stable order (shards, then the key's unsigned 64-bit hash), numbered from 0 and planned."""
    found = moves(source, target).withColumn("_h", fnv1a64(F.col("shard_key").cast("string")))
    order = [F.col("source_shard"), F.col("target_shard"), F.col("_h"), F.col("shard_key")]
    return ranked(found, order, "ord").withColumn("ord", F.col("ord") - 1).drop("_h").withColumn("state", F.lit("Planned"))


def dry_run(source: DataFrame, target: DataFrame) -> DataFrame:
    """How many keys were examined and how many would move."""
    to = target.select("shard_key", F.col("shard_id").alias("_to"))
    both = source.select("shard_key", "shard_id").join(to, "shard_key", "left")
    return both.agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.col("_to") != F.col("shard_id")).alias("moves"))


def pair_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("source_shard", "target_shard").agg(F.count(F.lit(1)).alias("moves"))


def pending(found: DataFrame, checkpoint: DataFrame, reached: str = "Copied") -> DataFrame:
    """The moves that a checkpoint(shard_key, state) hasn't brought this far."""
    done = STATES[STATES.index(reached) : -1]
    return found.join(checkpoint.where(F.col("state").isin(*done)).select("shard_key"), "shard_key", "left_anti")


def canonical(columns: list[str], key: str) -> Column:
    """A row as text: these columns in this order, nulls included."""
    return F.to_json(F.struct(*(c for c in columns if c != key)), {"ignoreNullFields": "false"})


def _check_columns(source: DataFrame, target: DataFrame) -> None:
    if set(source.columns) != set(target.columns):
        raise MigrationError("source and target differ and no projection brings them together", source=source.columns, target=target.columns)


def copy_rows(source: DataFrame, target: DataFrame, found: DataFrame, key: str, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The target after the moved keys' rows were inserted or overwritten. A key without a source row copies nothing."""
    taken = source.join(found.select(F.col("shard_key").alias(key)), key, "left_semi")
    taken = taken if project is None else taken.transform(project)
    _check_columns(taken, target)
    return target.join(taken.select(key), key, "left_anti").unionByName(taken)


def copied(found: DataFrame) -> DataFrame:
    return found.withColumn("state", F.when(F.col("state").isin("Planned", "Copying"), "Copied").otherwise(F.col("state")))


def verified(found: DataFrame, source: DataFrame, target: DataFrame, key: str, how: Verification = Verification.CHECKSUM, version: str = "row_version", force: bool = False, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """found with verified: whether the target's row matches the source's; a missing row does not.

    The source is projected first, as it was when it was copied, and columns are compared in
    its order. Row versions match if both are there and equal; weakly, also if one is missing.
    """
    source = source if project is None else source.transform(project)
    versions = how in (Verification.ROW_VERSION, Verification.WEAK)
    if not versions and how is not Verification.PRESENT:
        _check_columns(source, target)

    def side(df: DataFrame, name: str) -> DataFrame:
        row = canonical(source.columns, key)
        value = F.lit(0) if how is Verification.PRESENT else F.col(version) if versions else row if how is Verification.FULL else F.sha2(row, 256)
        return df.select(F.col(key).alias("shard_key"), value.alias(name), F.lit(True).alias(f"{name}_there"))

    both = found.join(side(source, "_s"), "shard_key", "left").join(side(target, "_t"), "shard_key", "left")
    there = F.coalesce(F.col("_s_there") & F.col("_t_there"), F.lit(False))
    same = F.coalesce(F.col("_s") == F.col("_t"), F.lit(how is Verification.WEAK))
    return both.withColumn("verified", (there & same) | F.lit(force)).drop("_s", "_t", "_s_there", "_t_there")


def judged(checked: DataFrame) -> DataFrame:
    """The state that a verification leads to."""
    state = F.when(F.col("state").isin("Copied", "Verifying"), F.when(F.col("verified"), "Verified").otherwise("Failed")).otherwise(F.col("state"))
    return checked.withColumn("state", state).drop("verified")


def swapped(stored: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shard map and the moves after verified keys changed hands."""
    ready = found.where(F.col("state").isin("Verified", "Swapping"))
    new = shard_map.upsert(stored, ready.select("shard_key", F.col("target_shard").alias("shard_id")))
    return new, found.withColumn("state", F.when(F.col("state").isin("Verified", "Swapping"), "Done").otherwise(F.col("state")))


def progress(found: DataFrame) -> DataFrame:
    """How many moves were copied, verified, swapped and failed so far."""
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    reached = lambda name: F.count_if((at >= STATES.index(name) + 1) & (F.col("state") != "Failed"))
    return found.agg(
        F.count(F.lit(1)).alias("total"), reached("Copied").alias("copied"), reached("Verified").alias("verified"),
        F.count_if(F.col("state") == "Done").alias("swapped"), F.count_if(F.col("state") == "Failed").alias("failed"),
    )


def summary(found: DataFrame, elapsed_s: float | None = None) -> DataFrame:
    out = found.agg(F.count(F.lit(1)).alias("planned"), F.count_if(F.col("state") == "Done").alias("done"), F.count_if(F.col("state") == "Failed").alias("failed"))
    return out if elapsed_s is None else out.withColumn("elapsed_s", F.lit(elapsed_s))


def retry_delay_ms(attempt: int, options: Options = Options()) -> int:
    """The pause before an attempt (from 1): doubling, up to the cap."""
    if attempt < 1:
        raise ValueError("attempts count from 1")
    return min(options.max_delay_ms, options.base_delay_ms * 2 ** (attempt - 1))


def execute(
    found: DataFrame, source: DataFrame, target: DataFrame, stored: DataFrame, key: str, options: Options = Options(), stage: Callable[[DataFrame, str], DataFrame] = staged,
    project: Callable[[DataFrame], DataFrame] | None = None, checkpoint: Callable[[DataFrame], None] | None = None, observer: Callable[[Progress], None] | None = None,
    clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves, target rows and shard map after all stages.

    stage writes a stage's rows down and reads them back, so that no later plan computes it
    again. A stage that fails is tried again with growing pauses; when its tries are used up,
    the batch's moves that it should have brought further are Failed and the run goes on.
    Batches of ``batch_moves`` moves (all at once if None) go one after the other. checkpoint
    gets all moves, and observer a ``Progress``, after a stage when their interval has passed,
    and always at the end; what they raise is logged and doesn't stop the run.
    """
    _check_columns(source if project is None else source.transform(project), target)
    began, last = clock(), {"checkpoint": float("-inf"), "progress": float("-inf")}
    todo = F.col("state").isin(*STATES[:-2])
    if options.batch_moves is None or "ord" not in found.columns:
        parts = [found.where(todo)]
    else:
        ends = found.where(todo).agg(F.min("ord"), F.max("ord")).head()
        first = range(0) if ends[0] is None else range(ends[0], ends[1] + 1, options.batch_moves)
        parts = [found.where(todo & F.col("ord").between(at, at + options.batch_moves - 1)) for at in first]
    parts = parts or [found.where(todo)]
    settled, rest = found.where(~todo), parts[1:]

    def all_moves(now: DataFrame) -> DataFrame:
        out = settled.unionByName(now)
        for part in rest:
            out = out.unionByName(part)
        return out

    def tell(name: str, batch: int, now: DataFrame, final: bool = False) -> None:
        at = clock()
        try:
            if checkpoint and (final or at - last["checkpoint"] >= options.checkpoint_s):
                last["checkpoint"] = at
                checkpoint(all_moves(now))
            if observer and (final or at - last["progress"] >= options.progress_s):
                last["progress"] = at
                observer(Progress(name, batch, *progress(all_moves(now)).head(), at - began))
        except Exception:
            log.exception("a checkpoint or observer failed after %s of batch %d", name, batch)

    def attempt(name: str, batch: int, run: Callable[[], DataFrame]) -> DataFrame | None:
        with described(found.sparkSession, f"migration: {name}, batch {batch}"):
            try:
                return retried(lambda: stage(run(), name), options, sleep)
            except MigrationError as e:
                log.error("%s of batch %d failed: %s", name, batch, e)
                return None

    def failed(now: DataFrame, *states: str) -> DataFrame:
        return now.withColumn("state", F.when(F.col("state").isin(*states), "Failed").otherwise(F.col("state")))

    for batch, now in enumerate(parts):
        rest = parts[batch + 1 :]
        open_ = now.where(F.col("state").isin("Planned", "Copying"))
        new = attempt("copy", batch, lambda open_=open_, target=target: copy_rows(source, target, open_, key, project))
        target, now = (target, failed(now, "Planned", "Copying")) if new is None else (new, copied(now))
        tell("copy", batch, now)
        checked = attempt("verify", batch, lambda now=now, target=target: judged(verified(now, source, target, key, options.verification, force=options.force_swap, project=project)))
        now = failed(now, "Copied", "Verifying") if checked is None else checked
        tell("verify", batch, now)
        new = attempt("swap", batch, lambda now=now, stored=stored: swapped(stored, now)[0])
        stored, now = (stored, failed(now, "Verified", "Swapping")) if new is None else (new, swapped(stored, now)[1])
        settled = stage(settled.unionByName(now), "moves")
        tell("swap", batch, settled.limit(0), final=batch + 1 == len(parts))
    return settled, target, stored


def retried(run: Callable[[], DataFrame], options: Options = Options(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The result of a stage that is tried again, with growing pauses, before it is given up."""
    for attempt in range(1, options.max_retries + 2):
        try:
            return run()
        except Exception as e:
            if attempt > options.max_retries:
                raise MigrationError(f"gave up after {attempt} attempts: {e}", attempts=attempt) from e
            log.warning("attempt %d failed: %s", attempt, e)
            sleep(retry_delay_ms(attempt, options) / 1000)
    raise AssertionError


class BudgetGovernor:
    """How many keys may move at a time: less when unhealthy, slowly more when healthy."""

    def __init__(self, most: int = 256, least: int = 32, per_shard: int = 16):
        if not 0 < least <= most or per_shard <= 0:
            raise ValueError("budgets must be positive and ordered")
        self.most, self.least, self.per_shard, self.budget = most, least, per_shard, most

    def report(self, p95_ms: float, mismatch: float) -> int:
        if p95_ms > 500 or mismatch > 0.5:
            self.budget = max(self.least, self.budget - max(8, self.budget // 4))
        else:
            self.budget = min(self.most, self.budget + max(4, self.budget // 10))
        return self.budget
