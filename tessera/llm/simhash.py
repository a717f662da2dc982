"""SimHash near-duplicates with BK-trees.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its shingles are
``width`` consecutive words, repeats included (fewer words: the whole sequence). Bit k of
the 64-bit fingerprint is 1 if over half the shingles' XXH64 (seed 42) have it set. Null
and empty texts get fingerprint zero and link like any other.

Fingerprints within ``radius`` bits are linked. Cut into radius + 2 blocks, two such
fingerprints agree on at least two whole blocks. So each distinct fingerprint goes to one
*shard* for each pair of blocks, keyed by those blocks' bits, and a shard's BK-tree
(children keyed by Hamming distance to the parent) is searched along the edges within the
radius only. Shards of more than ``SHARD_ROWS`` fingerprints are cut again, in the same
exact way, by the bits that are not in the key; at most 2^16 fingerprints can share both
keys. Trees live in the executors; nothing is collected. A shard emits a spanning forest
of its links, never all pairs, and components come from alternating star contraction over
(smallest doc_id, fingerprint), so a component's root names it and no component is gathered.
What is joined on a key that many rows may share is a written table on both sides, so that
AQE can split the key or broadcast the smaller side after a check of its size.

Very long texts are read in pieces, whole. Repeated rows, and rows that share a doc_id, are
members like any other. A null doc_id is never a smallest one; a component of null doc_ids
only gets a null component_id. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

WIDTH = 3
RADIUS = 2
SHARD_ROWS = 4096
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _halves(text: str | None, width: int, longs: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit, for so many 64-bit hashes of a shingle; and the number of shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    counts = np.zeros((longs, 64), np.int64)
    n = max(1, len(words) - width + 1) if words else 0
    at = 0
    while at < n:  # in pieces, so that a very long text needs little memory
        part = words[at : at + (1 << 17) + width - 1]
        here = min(1 << 17, n - at)
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, here)
        _count_bits(counts, h)
        at += here
    return counts, n


def _count_bits(counts: np.ndarray, h: np.ndarray) -> None:
    """Adds how many of the hashes have each bit to a row of counts for each 64-bit hash of a shingle."""
    for k in range(len(counts)):
        lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]  # a byte for each bit, summed over 255 rows at a time
        counts[k] += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
        h = _next_hash(h)


def _next_hash(h: np.ndarray) -> np.ndarray:
    """Another hash of the same shingles, by scrambling."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    counts, n = _halves(text, width, 1)
    return int.from_bytes(np.packbits(counts[0] * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(v.as_py(), width) for v in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Children keyed by integer distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the stored values at most ``radius`` bits away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            open_ += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = new
                break
            at = below
        return new


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect exactly what links of at most ``radius`` bits connect."""
    tree, root, out = BkTree(), list(range(len(values))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for value in values:
        near = tree.within(value, radius)
        new = tree.add(value)
        for at in near:
            if (a := top(at)) != (b := top(new)):
                root[a] = b
                out.append((value, values[at]))
    return out


def _bits(parts: list[tuple[int, int]]) -> Column:
    """The (offset, width) bit fields of fp, one above the other."""
    key, shift = F.lit(0).cast("long"), 0
    for offset, width in parts:
        field = F.shiftrightunsigned(F.col("fp"), offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key, shift = key.bitwiseOR(F.shiftleft(field, shift)), shift + width
    return key


def _cut(fields: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """The fields' bits, dealt out to as many parts of about the same width."""
    bits = [o + k for o, w in fields for k in range(w)]
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        runs: list[tuple[int, int]] = []
        for bit in bits[a:b]:
            if runs and runs[-1][0] + runs[-1][1] == bit:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((bit, 1))
        out.append(runs)
    return out


def _shards(radius: int) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each pair of blocks: the key's bit fields and the other bit fields."""
    blocks = _cut([(0, 64)], radius + 2)
    out = []
    for chosen in combinations(range(radius + 2), 2):
        out.append((sum((blocks[i] for i in chosen), []), sum((blocks[i] for i in range(radius + 2) if i not in chosen), [])))
    return out


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            return forest(held, radius) if len(held) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns - 1)), strict=True))
            for k, fp in zip(keys, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64).tolist(), strict=True):
                if k != key:
                    out += links()
                    key, held = k, []
                held.append(fp)
            yield _pairs(out)
        yield _pairs(links())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(x.max(1) if len(x) else x[:, 0]), pa.array(x.min(1) if len(x) else x[:, 0])], ["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fp values that connect all fp values within the radius of each other."""
    distinct = fps.select("fp").distinct()
    shards = _shards(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), _bits(key).alias("k")) for t, (key, _) in enumerate(shards)))
    dealt = distinct.select("fp", F.explode(keys).alias("s")).select("s.t", "s.k", "fp")
    sizes = staged(dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    dealt = dealt.join(sizes, ["t", "k"])
    small = dealt.where(F.col("n") <= shard_rows).select("t", "k", F.lit(0).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp")
    again = F.lit(None)
    for t, (_, rest) in enumerate(shards):  # a large shard: the same cut over the bits outside its key
        parts = _cut(rest, radius + 2)
        sub = F.array(*(F.struct(F.lit(i).alias("t2"), _bits(parts[x] + parts[y]).alias("k2")) for i, (x, y) in enumerate(combinations(range(radius + 2), 2))))
        again = F.when(F.col("t") == t, sub) if t == 0 else again.when(F.col("t") == t, sub)
    large = dealt.where(F.col("n") > shard_rows).select("t", "k", F.explode(again).alias("s"), "fp").select("t", "k", "s.t2", "s.k2", "fp")
    shard = ["t", "k", "t2", "k2"]
    grouped = small.unionByName(large).repartition(*shard).sortWithinPartitions(*shard, "fp")
    return grouped.mapInArrow(_search(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of edges(a, b), a != b, of any type with an order: the smallest node of its component.

    Large-star and small-star rounds until the edges no longer change. In a large star a node
    hands its smallest neighbour to its larger ones, in a small star to its smaller ones; edges
    are kept as (larger, smaller), so a root never looks anything up. Every round, and the
    small table of smallest neighbours that it joins, is written to the shared folder, and
    removed when the next is written.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        low = staged(edges.groupBy("a").agg(F.min("b").alias("lo")), "low")
        large = edges.join(low.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("lo", "b").alias("b"))
        written, edges = edges, staged(large.distinct(), "edges")
        discard(written, low)
        low = staged(edges.groupBy("a").agg(F.min("b").alias("lo")), "low")
        rest = edges.join(low, "a").where("b <> lo").select(F.col("b").alias("a"), F.col("lo").alias("b"))
        written, edges = edges, staged(rest.unionByName(low.select("a", F.col("lo").alias("b"))).distinct(), "edges")
        discard(written, low)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == before or now[0] == 0:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        before = now


def classes(links: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """key and smallest of every row of firsts(key, first): the smallest first of all that links(a, b) of keys connect. Staged.

    first is a struct that is never null.
    """
    found = links
    for end in ("a", "b"):
        found = found.join(firsts.select(F.col(key).alias(end), F.col("first").alias(f"first_{end}")), end)
    roots = components(found.select(*(F.struct(F.col(f"first_{x}").alias("first"), F.col(x).alias("key")).alias(x) for x in ("a", "b"))))
    roots = roots.select(F.col("node.key").alias(key), F.col("root.first").alias("smallest"))
    return staged(firsts.join(roots, key, "left").select(key, F.coalesce("smallest", "first").alias("smallest")), "classes")


def _last_if_null(*columns: str) -> Column:
    """A struct of the columns that comes after all others where the first is null."""
    return F.struct(F.col(columns[0]).isNull().alias("none"), *columns)


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of docs(doc_id, text)."""
    fps = staged(fingerprints(docs, width), "fingerprints")
    firsts = staged(fps.groupBy("fp").agg(F.min(_last_if_null("doc_id")).alias("first")), "firsts")
    found = classes(links(firsts, radius, shard_rows), firsts, "fp")
    return fps.join(found, "fp").select("doc_id", "fp", F.col("smallest.doc_id").alias("component_id"))


# --- near copies by similarity: longer fingerprints, banded ---

SIMILARITY = 0.8
SIMILAR_WIDTH = 5
LONGS = 12  # 64-bit hashes of a shingle: 768 bits
BAND = 16
CHECK_LONGS = 4  # the first 256 bits travel along and are compared
SET_ROWS = 256  # shingle sets in a part of a group that is verified


def similar_radius(similarity: float, bits: int = 64 * CHECK_LONGS) -> int:
    """Bits that may differ: what texts of this Jaccard similarity differ by on average, and four deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    part = float(np.arccos(cosine) / np.pi)
    return int(bits * part + 4 * np.sqrt(bits * part * (1 - part)))


def shingle_set(text: str | None, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(words) - width + 1))


def set_name(found: np.ndarray) -> int:
    """A name for a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two ascending sets; 0 where their sizes alone keep it under ``least``."""
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (small + large - shared)


def long_fingerprints(docs: DataFrame, width: int = SIMILAR_WIDTH) -> DataFrame:
    """doc_id, text_hash, node (a name for the shingle set), sketch (the fingerprint's first bits) and bands of every row of docs(doc_id, text).

    Each distinct shingle counts once. The bands are the fingerprint's bits cut twice, as
    they stand and by columns; a band of one cut shares at most one bit with a band of the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, names = np.zeros((len(batch), 64 * LONGS), bool), np.zeros(len(batch), np.int64)
            for i, value in enumerate(batch.column(1)):
                found = shingle_set(value.as_py(), width)
                counts = np.zeros((LONGS, 64), np.int64)
                for at in range(0, len(found), 1 << 17):
                    _count_bits(counts, found[at : at + (1 << 17)])
                bits[i], names[i] = counts.ravel() * 2 > len(found), set_name(found)
            turned = bits.reshape(len(batch), -1, BAND).transpose(0, 2, 1).reshape(len(batch), -1)
            packed = np.packbits(bits, axis=1, bitorder="little")
            bands = np.concatenate([packed, np.packbits(turned, axis=1, bitorder="little")], axis=1).view(np.uint16).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), bands.ravel())
            sketch = pa.array([row[: 8 * CHECK_LONGS].tobytes() for row in packed], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(names), sketch, lists], ["doc_id", "text_hash", "node", "sketch", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, node long, sketch binary, bands array<int>")


def _search_similar(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, values = None, [], []

        def links() -> list[tuple[int, int]]:
            if len(nodes) < 2:
                return []
            name: dict[int, int] = {}
            same = [(node, first) for value, node in zip(values, nodes, strict=True) if (first := name.setdefault(value, node)) != node]
            return same + [(name[a], name[b]) for a, b in forest(list(name), radius)]

        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for k, node, sketch in zip(keys, batch.column(4).to_pylist(), batch.column(5), strict=True):
                if k != key:
                    out += links()
                    key, nodes, values = k, [], []
                nodes.append(node)
                values.append(int.from_bytes(sketch.as_py(), "little"))
            yield _signed_pairs(out)
        yield _signed_pairs(links())

    return run


def _signed_pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(x.max(1) if len(x) else x[:, 0]), pa.array(x.min(1) if len(x) else x[:, 0])], ["a", "b"])


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def links() -> list[tuple[int, int]]:
            root, out = list(range(len(nodes))), []

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for new in range(1, len(nodes)):
                for at in range(new):
                    if (a := top(at)) != (b := top(new)) and jaccard(sets[at], sets[new], similarity) >= similarity:
                        root[b] = a
                        out.append((nodes[new], nodes[at]))
            return out

        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for k, node, found in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if k != key:
                    out += links()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(found.values.to_numpy().view(np.uint64))
            yield _signed_pairs(out)
        yield _signed_pairs(links())

    return run


def verified(docs: DataFrame, candidates: DataFrame, firsts: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, set_rows: int = SET_ROWS) -> DataFrame:
    """Links (a, b) that connect what pairs of at least this Jaccard similarity connect, within the components of candidates(a, b).

    All pairs of a component are compared, candidates or not, save those that links connect
    already. A component of more than ``set_rows`` is dealt out in pairs of parts. Shingle sets
    are made once for each node, from the row that firsts(node, first) names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(value.as_py(), width) for value in batch.column(0)]
            yield pa.record_batch([batch.column(1), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    loose = staged(components(candidates), "loose")
    sizes = staged(loose.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / set_rows).cast("int").alias("parts")), "sizes")
    meant = staged(firsts.select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")).join(loose, "node").select("node", "id", "hash"), "meant")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(meant, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "node")
    sets = texts.groupBy("node").agg(F.first("text").alias("text")).select("text", "node").mapInArrow(run, "node long, shingles array<long>")
    sets = sets.join(loose, "node").join(sizes, "root")
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    shard = ["root", "p", "q"]
    dealt = dealt.select("root", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "shingles")
    return dealt.repartition(*shard).sortWithinPartitions(*shard, "node").mapInArrow(_verify(similarity), "a long, b long").distinct()


def similar_groups(docs: DataFrame, width: int = SIMILAR_WIDTH, similarity: float = SIMILARITY, shard_rows: int = SHARD_ROWS, set_rows: int = SET_ROWS) -> DataFrame:
    """doc_id, component_id, text_hash and first for near copies by the Jaccard similarity of their sets of word shingles.

    text_hash is xxhash64 of the text. first is the smallest (doc_id, text_hash) of the
    component, null ids aside; it tells rows apart that share a doc_id.

    Texts of that similarity differ in more bits than blocks of a 64-bit fingerprint
    forgive, so fingerprints have 768 bits. Each distinct one goes to a shard for every
    band of 16 bits; a shard's BK-tree links those whose first 256 bits are within
    ``similar_radius``. A shard of more than ``shard_rows`` is dealt out in pairs of parts,
    so every two of its rows still meet. What hangs together by these links is then
    compared by the shingle sets themselves, and only similar pairs are linked.
    """
    fps = staged(long_fingerprints(docs, width), "fingerprints")
    distinct = staged(fps.groupBy("node").agg(F.min(_last_if_null("doc_id", "text_hash")).alias("first"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "distinct")
    firsts = distinct.select("node", "first")
    dealt = distinct.select("node", "sketch", F.posexplode("bands").alias("t", "k"))
    sizes = distinct.select("node", F.posexplode("bands").alias("t", "k")).groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"))
    large = staged(sizes.where(F.col("n") > shard_rows).select("t", "k", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "large")
    dealt = dealt.join(large, ["t", "k"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = dealt.withColumn("own", own).withColumn("other", other)
    shard = ["t", "k", "p", "q"]
    dealt = dealt.select("t", "k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "sketch")
    grouped = dealt.repartition(*shard).sortWithinPartitions(*shard, "node")
    candidates = grouped.mapInArrow(_search_similar(similar_radius(similarity)), "a long, b long").distinct()
    found = classes(verified(docs, candidates, firsts, width, similarity, set_rows), firsts, "node")
    smallest = F.when(~F.col("smallest.none"), F.struct("smallest.doc_id", "smallest.text_hash"))
    return fps.select("doc_id", "text_hash", "node").join(found, "node").select("doc_id", F.col("smallest.doc_id").alias("component_id"), "text_hash", smallest.alias("first"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
