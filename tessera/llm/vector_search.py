"""Approximate nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Index. Vectors are scaled by the longest one's length and get one more component, so that all
have length one; then the nearest by distance is the largest inner product. A random
orthogonal matrix rotates them, and k-means centroids, fitted on a bounded sample, deal every
one of them to its nearest list.

Search. A query probes the lists nearest to it. Its k best within the sample are found at
once; the last of them is a bound that holds in every list, and that travels with it. Within a list, candidates are
scanned in column blocks of the rotated vectors, for many queries at once. After m of D
columns, the partial squared distance scaled by D / m estimates the whole; a hypothesis test
abandons a candidate once that exceeds (1 + epsilon / sqrt(m))^2 times the query's bound,
which tightens with every piece of the list. Survivors are scored by the inner product of the original vectors in double
precision.

Work is dealt out in units of at most ``UNIT_ROWS`` rows of a list times ``UNIT_QUERIES``
of its queries, so no list, however large, lands in one task. Only centroids, list sizes
(both bounded by ``lists``) and the sample (at most ``sample_rows`` vectors) reach the driver.

Vectors that are null, zero, of a length other than the most common one, or that hold null
or non-finite components take no part. Rows that share a vec_id are one candidate (its best
score) and never their own neighbour; a null vec_id takes no part. Ties go to the smaller
vec_id. Double input stays double. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import bounded_sample, staged

K = 20
UNIT_ROWS = 8192
UNIT_QUERIES = 1024
COLUMNS = 16
PIECE = 2048
TOGETHER = 128
EPSILON = 2.1


@dataclass
class Index:
    """Rotation, centroids, list sizes, and how many lists to probe."""

    dim: int
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    sizes: np.ndarray
    probes: int = 1
    sample_ids: np.ndarray | None = None
    sample: np.ndarray | None = None  # rotated
    plain: np.ndarray | None = None

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors, of length one by their extra component (queries: by scaling), rotated."""
        x = x.astype(np.float64)
        if query:
            x = x / np.abs(x).max(1, keepdims=True)
            x, extra = x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros(len(x))
        else:
            x = x / self.longest
            extra = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return (np.concatenate([x, extra[:, None]], 1) @ self.rotation).astype(np.float32)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids * self.centroids).sum(1)

    def nearest(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of rotated queries' k nearest in the sample, and squared distances that hold them; infinite if the sample is too small."""
        if self.sample is None or len(self.sample) <= k:
            return np.zeros((len(x), 0), np.int64), np.full(len(x), np.inf)
        found = np.zeros((len(x), k), np.int64)
        out = np.zeros(len(x))
        for at in range(0, len(x), 256):
            d = 2 - 2 * x[at : at + 256] @ self.sample.T
            d[ids[at : at + 256, None] == self.sample_ids] = np.inf
            found[at : at + 256] = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[at : at + 256] = np.take_along_axis(d, found[at : at + 256], 1).max(1)
        return found, out * (1 + 1e-5) + 1e-5  # rounding


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, before the check of their length."""
    kind = "double" if isinstance(vectors.schema["embedding"].dataType.elementType, DoubleType) else "float"
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def kmeans(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((centroids * centroids).sum(1) - 2 * part @ centroids.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        heads = np.searchsorted(near[order], np.arange(lists))
        counts = np.bincount(near, minlength=lists)
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), heads, axis=0)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
    return centroids


def build(rows: DataFrame, sample_rows: int = 20_000, max_lists: int = 4096, target: float = 0.95, seed: int = 5) -> tuple[DataFrame, Index] | None:
    """Every vector of rows(vec_id, embedding) with its list, staged; and the index. None without vectors.

    The centroids are fitted on at most ``sample_rows`` vectors; the number of lists is half
    the root of the number of vectors, at most ``max_lists``. How many lists a query probes
    is fitted on the sample too: enough for ``target`` of its true neighbours.
    """
    common = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").head()
    if common is None:
        return None
    dim, n = common["dim"], common["n"]
    rows = rows.where(F.size("embedding") == dim)
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    length = most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x.cast("double") / most) * (x.cast("double") / most)))
    longest = float(rows.agg(F.max(length)).head()[0])
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, dim + 1)))[0]
    index = Index(dim, longest, rotation, np.zeros((1, dim + 1), np.float32), np.zeros(1))
    sample = sorted(tuple(r) for r in bounded_sample(rows, "vec_id", sample_rows, seed).select("vec_id", "embedding").collect())
    plain = np.array([r[1] for r in sample], np.float64).reshape(-1, dim)
    index.sample_ids, index.sample, index.plain = np.array([r[0] for r in sample], np.int64), index.rotated(plain), plain
    index.centroids = kmeans(index.sample, int(min(max_lists, len(sample), max(1, round(np.sqrt(n) / 2)))))
    index.probes = fitted_probes(index.sample, plain, index, target)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                near = index.distances(index.rotated(_matrix(part.column(1), dim))).argmin(1)
                yield pa.record_batch([*part.columns, pa.array(near.astype(np.int32))], ["vec_id", "embedding", "list"])

    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = staged(rows.mapInArrow(deal, f"vec_id long, embedding {kind}, list int"), "vectors")
    index.sizes = np.zeros(len(index.centroids), np.int64)
    for r in dealt.groupBy("list").count().collect():
        index.sizes[r[0]] = r[1]
    return dealt, index


def fitted_probes(x: np.ndarray, plain: np.ndarray, index: Index, target: float, k: int = K, queries: int = 400) -> int:
    """The lists to probe so that this share of the true neighbours within the sample is in them."""
    if len(x) <= k:
        return len(index.centroids)
    asked = plain[:: max(1, len(plain) // queries)]
    near = index.distances(x).argmin(1)
    order = index.distances(index.rotated(asked, query=True)).argsort(1, kind="stable")
    place = np.argsort(order, 1)
    own = np.arange(0, len(plain), max(1, len(plain) // queries))
    score = asked.astype(np.float64) @ plain.T.astype(np.float64)
    score[np.arange(len(own)), own] = -np.inf
    best = np.argpartition(-score, k, axis=1)[:, :k]
    need = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1


def probed(x: np.ndarray, index: Index, probes: int, k: int) -> list[np.ndarray]:
    """The lists that each rotated query probes: the nearest ones, and more while they hold too few vectors."""
    order = index.distances(x).argsort(1, kind="stable")
    held = np.cumsum(index.sizes[order], 1)
    need = np.maximum(probes, (held < k + 1).sum(1) + 1)
    return [row[:n] for row, n in zip(order, need, strict=True)]


def scan(base: np.ndarray, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, bounds: np.ndarray, k: int = K, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a query, place of a candidate) that may be among the query's k nearest; own: the queries' ids.

    base: rotated vectors, one row for each column, so that a block of columns is contiguous.
    bounds: for each query, a squared distance within which there are at least k candidates
    somewhere. Ids that repeat are one candidate.
    """
    dim, bounds = base.shape[0], bounds.astype(np.float32)
    edges = [*range(0, dim, COLUMNS), dim]
    lengths = [(queries[:, a:b] ** 2).sum(1) for a, b in zip(edges, edges[1:], strict=False)]
    q, x, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    for start in range(0, base.shape[1], PIECE):
        piece = base[:, start : start + PIECE]
        alive = ids[start : start + PIECE][None] != own[:, None]
        partial, dense = np.zeros(alive.shape, np.float32), True
        for at, end, length in zip(edges, edges[1:], lengths, strict=False):
            block = piece[at:end]
            loose = np.float32((1 + epsilon / np.sqrt(end)) ** 2 * end / dim if end < dim else 1.0)
            if dense:
                partial += length[:, None] + (block**2).sum(0) - 2 * queries[:, at:end] @ block
                alive &= partial <= bounds[:, None] * loose
                if end == dim or alive.mean() < 0.2:  # few are left: one by one
                    dense = False
                    qs, xs = np.nonzero(alive)
                    ds = partial[qs, xs]
            elif len(qs):
                ds = ds + ((block[:, xs] - queries[qs, at:end].T) ** 2).sum(0)
                stay = ds <= bounds[qs] * loose
                qs, xs, ds = qs[stay], xs[stay], ds[stay]
        q, x, d = np.concatenate([q, qs]), np.concatenate([x, xs + start]), np.concatenate([d, ds])
        order = np.lexsort((d, ids[x], q))
        first = order[np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (ids[x[order]][1:] != ids[x[order]][:-1])])] if len(order) else order
        first = first[np.lexsort((d[first], q[first]))]
        heads = np.searchsorted(q[first], np.arange(len(bounds) + 1))
        full = np.flatnonzero(np.diff(heads) >= k)
        bounds[full] = np.minimum(bounds[full], d[first[heads[full] + k - 1]] * np.float32(1 + 1e-5) + np.float32(1e-5))
        stay = d <= bounds[q]
        q, x, d = q[stay], x[stay], d[stay]
    return q, x


def search(dealt: DataFrame, index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found to each of queries(vec_id, embedding)."""
    dim = index.dim
    kind = dealt.schema["embedding"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                turned = index.rotated(_matrix(part.column(1), dim), query=True)
                lists, bounds = probed(turned, index, index.probes, k), index.nearest(part.column(0).to_numpy(), turned, k)[1]
                rows = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in lists]))
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(np.concatenate(lists).astype(np.int32)), pa.array(bounds).take(rows)], ["vec_id", "embedding", "list", "bound"])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                keys, x = batch.column(0).slice(at, 1024).to_numpy(), _matrix(batch.column(1).slice(at, 1024), dim)
                found, _ = index.nearest(keys, index.rotated(x, query=True), k)
                score = np.einsum("qkd,qd->qk", index.plain[found], x.astype(np.float64))
                yield pa.record_batch([pa.array(np.repeat(keys, found.shape[1])), pa.array(index.sample_ids[found].ravel()), pa.array(score.ravel())], ["query_id", "vec_id", "score"])

    sent = staged(queries.mapInArrow(send, f"vec_id long, embedding {kind}, list int, bound double"), "queries")
    asked = sent.groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    held = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    parts = F.broadcast(held.join(asked, "list").select("list", F.ceil(F.col("rows") / UNIT_ROWS).alias("r"), F.ceil(F.col("queries") / UNIT_QUERIES).alias("q")))  # a row a list
    mine = F.pmod(F.xxhash64("vec_id"), F.col("r")).alias("rp")
    theirs = F.pmod(F.xxhash64("vec_id"), F.col("q")).alias("qp")
    base = dealt.join(parts, "list").select("list", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("qp"), F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(0.0).alias("bound"))
    sent = sent.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("rp"), theirs, F.lit(1).alias("kind"), "vec_id", "embedding", "bound")
    units = base.unionByName(sent).repartition("list", "rp", "qp").sortWithinPartitions("list", "rp", "qp", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, plain, turned = None, [], [], None

        def answer(keys: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            nonlocal ids, plain, turned
            if turned is None:
                ids, plain = np.concatenate(ids), np.concatenate(plain)
                turned = np.ascontiguousarray(index.rotated(plain).T)
                plain = plain.astype(np.float64)
            out = []
            for at in range(0, len(keys), TOGETHER):
                part = slice(at, at + TOGETHER)
                q, found = scan(turned, index.rotated(x[part], query=True), ids, keys[part], bounds[part], k)
                score = np.einsum("nd,nd->n", plain[found], x[part][q].astype(np.float64))
                order = np.lexsort((ids[found], -score, q))
                q, found, score = q[order], found[order], score[order]
                first = np.sort(np.unique(np.stack([q, ids[found]]), axis=1, return_index=True)[1])
                q, found, score = q[first], found[first], score[first]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                out.append((keys[part][q[best]], ids[found[best]], score[best]))
            return pa.record_batch([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                if (now := tuple(keys[a, :3].tolist())) != unit:
                    unit, ids, plain, turned = now, [], [], None
                key, x = batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a), dim)
                if keys[a, 3] == 0:
                    ids.append(key)
                    plain.append(x)
                elif len(ids):
                    yield answer(key, x, batch.column(6).slice(a, b - a).to_numpy())

    found = units.mapInArrow(run, "query_id long, vec_id long, score double").unionByName(queries.select("vec_id", "embedding").mapInArrow(start, "query_id long, vec_id long, score double"))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    built = build(rows)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dealt, index = built
    return search(dealt, index, dealt.where(F.pmod("vec_id", F.lit(20)) == 0).select("vec_id", "embedding"))
