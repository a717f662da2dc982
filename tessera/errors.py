"""Errors with a context for diagnosis."""

from __future__ import annotations


class ShardError(Exception):
    """Base of all errors here; ``context`` names what it was about."""

    def __init__(self, message: str, **context: object):
        super().__init__(message)
        self.context = context


class QueryError(ShardError):
    """A query that can't be built or answered; context: phase, source, result, shard_id, targets."""


class RoutingError(ShardError):
    """A key that can't be routed."""


class StoreError(ShardError):
    """A shard map or checkpoint store that refuses."""


class TopologyError(ShardError):
    """A topology with duplicate keys, or too many."""


class MigrationError(ShardError):
    """A migration that can't go on."""


class OrderingNotSupported(QueryError):
    """Ordering asked of a strict, unordered query."""


class AllShardsFailed(QueryError):
    """Best effort with no shard left."""


class InsufficientHealthyShards(QueryError):
    """Fewer healthy shards than required."""

    def __init__(self, total: int, healthy: int, unhealthy: list[str]):
        super().__init__(f"{healthy} of {total} shards are healthy; unhealthy: {', '.join(unhealthy)}", total=total, healthy=healthy, unhealthy=unhealthy)
        self.total, self.healthy, self.unhealthy = total, healthy, unhealthy
