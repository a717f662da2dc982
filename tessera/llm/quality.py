"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Random indexing: each unit owns a sparse random index vector, made from its hash, so no
vocabulary is kept and every word of every text has one. Units are a lower-cased word, its
shape (case and trailing marks), and two marks of a word that its document has had before
or that stands in a line that the document has had before. A unit's word vector is its own
index vector plus a context vector: the index vectors of its neighbours within two words,
summed over a bounded sample of training texts. Context vectors live in a hashed table of
``ROWS`` rows, whatever the corpus; units that share a row share a context, not an index
vector. A document is the mean of its units' vectors. A two-layer numpy network maps that to
a score; a temperature fitted on rows set aside calibrates it.

Fitting reads at most ``max_docs`` labelled documents, chosen by a hash of doc_id, one text
for each (of rows that share a doc_id, the one of the smallest hash). Every text is scored
whole. Null, empty and blank texts get the network's score for an empty document. Repeated
rows and rows that share a doc_id or have none are scored each on its own; an empty table
gives an empty result. With no label to learn from, or labels of one class only, the score
is that class' share (0.5 if there is none). Extra columns stay as they are; the score's
column is given a name that is free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, fold, held_out, spread, table

DIM = 96
ONES = 8
ROWS = 1 << 14
CUT = 0.3
BLOCK = 512
MARKS = "!?*$#%&|.,;:()[]{}<>=+~^\"'"
AGAIN, LINE_AGAIN = "\0again", "\0line"


def shape_of(word: str) -> tuple[str, str]:
    """A word's core, lower-cased, and its shape."""
    core = word.rstrip(MARKS)
    case = "-" if not core else "U" if len(core) > 1 and core.isupper() else "T" if core[:1].isupper() else "l" if core.islower() else "d" if core.isdigit() else "x"
    return core.lower(), f"\0{case}{word[len(core):]}"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit_hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode("utf-8", "replace"))


def index_vectors(hashes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Sparse and ternary, a row for each hash: half of the ``ONES`` places are +1, half -1; places that meet add up."""
    out = np.zeros((len(hashes), dim), np.float32)
    row = np.arange(len(hashes))
    for k in range(ONES):
        place = _mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(dim)
        out[row, place.astype(np.int64)] += 1 if k % 2 else -1
    return out


def rows_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The row of the context table that each unit shares."""
    return (_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(size)).astype(np.int64)


class Pooler:
    """Texts to feature rows, with a given context table."""

    def __init__(self, contexts: np.ndarray, bound: int = 150_000):
        self.contexts, self.bound = contexts, bound
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}  # the rows of its core and, 32 bits higher, of its shape
        self.rows: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, self.contexts.shape[1]), np.float32)
        self.learn([AGAIN, LINE_AGAIN])

    def learn(self, units: list[str]) -> None:
        """Adds the vectors of new units."""
        hashes = np.fromiter(map(unit_hash, units), np.uint64, len(units))
        vectors = index_vectors(hashes, self.contexts.shape[1]) / np.float32(np.sqrt(ONES)) + self.contexts[rows_of(hashes, len(self.contexts))]
        at = len(self.rows)
        while len(self.table) < at + len(units):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(units)] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.rows.update(zip(units, range(at, at + len(units)), strict=True))

    def places(self, words: Counter[str]) -> np.ndarray:
        """The rows of each of these words."""
        if len(self.words) > 4 * self.bound or len(self.rows) > self.bound:
            self.clear()
        known, rows = self.words, self.rows
        new = {w: shape_of(w) for w in words if w not in known}
        if units := [u for u in dict.fromkeys(u for pair in new.values() for u in pair) if u not in rows]:
            for at in range(0, len(units), 8192):
                self.learn(units[at : at + 8192])
        for word, (core, shape) in new.items():
            known[word] = rows[core] | rows[shape] << 32
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(self.contexts.shape[1], np.float32)
        counts = Counter(words)
        places = self.places(counts)
        times = np.fromiter(counts.values(), np.float32, len(counts))
        shapes, of = np.unique(places >> 32, return_inverse=True)
        total = times @ self.table[places & 0xFFFFFFFF] + np.bincount(of, times).astype(np.float32) @ self.table[shapes]
        total += (len(words) - len(counts)) * self.table[self.rows[AGAIN]]
        lines = [x for x in text.split("\n") if x]
        if len(lines) > 1 and len(first := set(lines)) < len(lines):
            total += (len(words) - sum(len(x.split()) for x in first)) * self.table[self.rows[LINE_AGAIN]]
        return (total / len(words)).astype(np.float32)


def context_vectors(texts: DataFrame, dim: int = DIM, size: int = ROWS) -> np.ndarray:
    """The hashed table of context vectors of texts(text), unit length; zero where no unit fell."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, dim), np.float32)
        for batch in batches:
            for value in batch.column(0):
                words = (value.as_py() or "").split()
                distinct = list(dict.fromkeys(words))
                place = dict(zip(distinct, range(len(distinct)), strict=True))
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                pairs = [shape_of(w) for w in distinct]
                for part in range(0, len(at), 1 << 16):  # in pieces, so that a very long text needs little memory
                    here = at[max(0, part - 2) : part + (1 << 16) + 2]
                    used, own = np.unique(here, return_inverse=True)
                    hashes = [np.array([unit_hash(pairs[i][k]) for i in used.tolist()], np.uint64) for k in (0, 1)]
                    vectors = index_vectors(hashes[0], dim) + index_vectors(hashes[1], dim)
                    near = np.zeros((len(here), dim), np.float32)
                    for by in (1, 2):
                        near[:-by] += vectors[own[by:]]
                        near[by:] += vectors[own[:-by]]
                    first = part - max(0, part - 2)
                    centre = slice(first, first + min(1 << 16, len(at) - part))
                    order = np.argsort(own[centre], kind="stable")
                    heads = np.flatnonzero(np.diff(own[centre][order], prepend=-1))
                    added, of = np.add.reduceat(near[centre][order], heads, axis=0), own[centre][order][heads]
                    for k in (0, 1):
                        np.add.at(total, rows_of(hashes[k][of], size), added)
        parts = range(0, size, BLOCK)
        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([total[at : at + BLOCK].tobytes() for at in parts], pa.binary())], ["at", "sum"])

    def add(rows: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(v.as_py(), np.float32) for v in rows.column("sum")], axis=0, dtype=np.float32)
        return pa.table({"at": rows.column("at").slice(0, 1), "sum": pa.array([whole.tobytes()], pa.binary())})

    # Blocks of the tasks' sums are added in the executors, so that the driver gets one table.
    total = np.zeros((size, dim), np.float32)
    for r in texts.mapInArrow(sums, "at int, sum binary").groupBy("at").applyInArrow(add, "at int, sum binary").collect():
        part = np.frombuffer(r[1], np.float32).reshape(-1, dim)
        total[r[0] : r[0] + len(part)] = part
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


class Network:
    """Two layers, standardised inputs, cross-entropy by Adam, then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 400, seed: int = 3):
        self.share = float(y.mean()) if len(y) else 0.5
        self.fitted = len(set(y.tolist())) == 2
        if not self.fitted:
            return
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
            aside = np.zeros(len(y), bool)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z, t = self._z(x[~aside]), y[~aside].astype(np.float32)
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
        w = [v.astype(np.float32) for v in w]
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, steps + 1):
            h = np.tanh(z @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - t) / len(t)
            back = np.outer(d, w[2]) * (1 - h * h)
            for i, g in enumerate((z.T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 0.02 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if aside.any():
            logit, t = self._logit(x[aside]), y[aside]
            loss = lambda k: np.mean(np.logaddexp(0, -np.where(t == 1, 1, -1) * logit / k))
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh(self._z(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, seed: int = 11) -> tuple[np.ndarray, Network]:
    """Context table and network from docs(doc_id, text) and labels(doc_id, quality)."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marked = bounded_sample(marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")), "doc_id", max_docs, seed)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    known = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))
    known = known.repartition(spread(docs.sparkSession)).persist()  # at most max_docs rows
    try:
        shared = docs.sparkSession.sparkContext.broadcast(context_vectors(known.select("text")))  # bounded by ROWS

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pooler = Pooler(shared.value)
            for batch in batches:
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array([pooler.features(v.as_py()).tobytes() for v in batch.column(1)], pa.binary())], ["doc_id", "quality", "x"])

        rows = sorted(tuple(r) for r in known.select("doc_id", "text", "quality").mapInArrow(pool, "doc_id long, quality int, x binary").collect())
        contexts = shared.value
        shared.destroy()
    finally:
        known.unpersist()
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float32).reshape(len(rows), DIM)
    return contexts, Network(x, np.array([r[1] for r in rows], np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], name: str = "score") -> DataFrame:
    """docs with a score column of this (new) name, every row and column kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ROWS
    kept = docs.columns
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, network = shared.value
        pooler = Pooler(contexts)
        for batch in batches:
            x = np.array([pooler.features(v.as_py()) for v in batch.column(at)], np.float32).reshape(len(batch), contexts.shape[1])
            yield pa.record_batch([*batch.columns, pa.array(network.score(x), pa.float64())], [*kept, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.select("doc_id", "quality").where(fold() != 0))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
