"""Deterministic key hashes as column expressions.

Unsigned results are longs: 32-bit hashes lie in [0, 2^32), 64-bit hashes are structs of
two such halves, whose order is the unsigned order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RoutingError

TWO32 = 1 << 32


def _reversed_hex(hexes: Column, bytes_: int) -> Column:
    return F.concat(*(F.substring(hexes, 2 * k + 1, 2) for k in reversed(range(bytes_))))


def sha256_le32(data: Column) -> Column:
    """The first four bytes of SHA-256, read little-endian."""
    return F.conv(_reversed_hex(F.sha2(data, 256), 4), 16, 10).cast("long")


def string_key_hash(key: Column) -> Column:
    return sha256_le32(key.cast("binary"))


def _integer_bytes(key: Column, bytes_: int) -> Column:
    return F.unhex(_reversed_hex(F.lpad(F.right(F.hex(key.cast("long")), F.lit(2 * bytes_)), 2 * bytes_, "0"), bytes_))


def int_key_hash(key: Column) -> Column:
    """Of a 32-bit integer, as four little-endian bytes."""
    return sha256_le32(_integer_bytes(key, 4))


def uint_key_hash(key: Column) -> Column:
    """Of an unsigned 32-bit integer held in a long, as four little-endian bytes."""
    return int_key_hash(key)


def long_key_hash(key: Column) -> Column:
    return sha256_le32(_integer_bytes(key, 8))


def guid_key_hash(key: Column) -> Column:
    """Of a GUID in text form. Its first three fields count little-endian."""
    digits = F.regexp_replace(F.lower(key), "[^0-9a-f]", "")
    order = (3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15)
    return sha256_le32(F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in order))))


def key_hash(key: Column, kind: T.DataType, own: Callable[[Column], Column] | None = None) -> Column:
    """The hash for a key column of this type, or the caller's own; other types are refused."""
    if own is not None:
        return own(key)
    if isinstance(kind, T.StringType):
        return string_key_hash(key)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return int_key_hash(key)
    if isinstance(kind, T.LongType):
        return long_key_hash(key)
    if isinstance(kind, T.BinaryType):
        return sha256_le32(key)
    raise RoutingError(f"no key hash for {kind.simpleString()}", type=kind.simpleString())


def _bytes(data: Column) -> Column:
    """The bytes of a binary column as an array of longs."""
    hexes = F.hex(data)
    places = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.substr(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))


def fnv1a32(text: Column) -> Column:
    return F.aggregate(_bytes(text.cast("binary")), F.lit(2166136261).cast("long"), lambda a, x: F.pmod(a.bitwiseXOR(x) * 16777619, F.lit(TWO32)))


def fnv1a64(text: Column) -> Column:
    """struct(h, l): the halves of FNV-1a 64. Its prime is 2^40 + 435, so each half stays in range."""

    def step(a: Column, x: Column) -> Column:
        low = a["l"].bitwiseXOR(x)
        product = low * 435
        high = a["h"] * 435 + F.floor(product / F.lit(float(TWO32))).cast("long") + F.pmod(low, F.lit(1 << 24)) * 256
        return F.struct(F.pmod(high, F.lit(TWO32)).alias("h"), F.pmod(product, F.lit(TWO32)).alias("l"))

    start = F.struct(F.lit(3421674724).cast("long").alias("h"), F.lit(2216829733).cast("long").alias("l"))
    return F.aggregate(_bytes(text.cast("binary")), start, step)


def mod64(halves: Column, n: int) -> Column:
    """An unsigned 64-bit hash mod n, from its halves."""
    return F.pmod(F.pmod(halves["h"], F.lit(n)) * (TWO32 % n) + F.pmod(halves["l"], F.lit(n)), F.lit(n))


#: Hashes by name, for configuration.
HASHES: dict[str, Callable[[Column], Column]] = {"sha256": string_key_hash, "fnv1a32": fnv1a32}
