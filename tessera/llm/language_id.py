"""Language identification with hyperdimensional profiles.

Each letter owns a random +1/-1 vector derived from its code point. A trigram's vector
binds (multiplies) its letters' vectors, permuted (rolled) by their place. A document
bundles (adds) the vectors of its trigrams; a language prototype bundles the unit
vectors of its training documents. Documents get the language of the nearest prototype
by cosine.

Case is folded; every run position that isn't a letter counts as one blank symbol, and
trigrams need a letter in the middle. Null texts and texts without a letter are ``und``
with score 0, and so is every text when there was nothing to learn from. Ties go to the
smaller language name. Very long texts are bundled in pieces, whole. Repeated rows, and rows
that share a doc_id or have none, are identified each on its own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, held_out, spread

UNKNOWN = "und"
_PIECE = 1 << 20


class HyperEncoder:
    """Trigram bundles of texts. Memory is bounded by ``max_rows`` trigram vectors."""

    LETTERS = 96

    def __init__(self, dim: int = 1024, seed: int = 7, max_rows: int = 16_384):
        self.dim, self.seed, self.max_rows = dim, seed, max_rows
        self.letter = np.full(0x110000, -2, np.int16)  # -2: not met yet, -1: a letter beyond the table, 0: no letter
        self.code_points = [0]
        self.vectors: dict[int, np.ndarray] = {}
        self.row = np.full(self.LETTERS**3, -1, np.int32)
        self.used = 0
        self.table = np.empty((256, dim), np.float32)

    def vector(self, cp: int) -> np.ndarray:
        if cp not in self.vectors:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, cp])).integers(0, 2, self.dim, np.int8)
            self.vectors[cp] = (bits * 2 - 1).astype(np.int8)
        return self.vectors[cp]

    def trigram(self, a: int, b: int, c: int) -> np.ndarray:
        return np.roll(self.vector(a), 2) * np.roll(self.vector(b), 1) * self.vector(c)

    def _learn(self, cps: np.ndarray) -> None:
        for cp in np.unique(cps).tolist():
            if not chr(cp).isalpha():
                self.letter[cp] = 0
            elif len(self.code_points) < self.LETTERS:
                self.letter[cp] = len(self.code_points)
                self.code_points.append(cp)
            else:
                self.letter[cp] = -1

    def _rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the vector table for trigrams of table letters; -1 where the table is full."""
        rows = self.row[keys]
        new = keys[rows == -1]
        if len(new) and self.used < self.max_rows:
            n = self.LETTERS
            for key in np.unique(new).tolist()[: self.max_rows - self.used]:
                if self.used == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])[: self.max_rows]
                a, b, c = (self.code_points[i] for i in (key // (n * n), key // n % n, key % n))
                self.table[self.used] = self.trigram(a, b, c)
                self.row[key] = self.used
                self.used += 1
            rows = self.row[keys]
        return rows

    def add(self, text: str, counts: np.ndarray, extra: np.ndarray) -> bool:
        """Add the text's trigrams to counts (by row) and extra (a bundle); whether it has a letter."""
        found, tail = False, ""
        for at in range(0, len(text), _PIECE):
            piece = tail + text[at : at + _PIECE]
            tail = piece[-2:]
            cps = np.frombuffer((" " * (at == 0) + piece + " " * (at + _PIECE >= len(text))).lower().encode("utf-32-le", "replace"), np.uint32)
            ids = self.letter[cps]
            if (fresh := ids == -2).any():
                self._learn(cps[fresh])
                ids = self.letter[cps]
            keep = np.flatnonzero(ids[1:-1] != 0)
            if not len(keep):
                continue
            found = True
            ids = ids.astype(np.int32)
            a, b, c = ids[keep], ids[keep + 1], ids[keep + 2]
            plain = (a >= 0) & (b >= 0) & (c >= 0)
            keys = (a * self.LETTERS + b) * self.LETTERS + c
            rows = np.where(plain, self._rows_of(np.where(plain, keys, 0)), -1) if not plain.all() else self._rows_of(keys)
            hit = rows >= 0
            if hit.all():
                counts += np.bincount(rows, minlength=len(counts))[: len(counts)]
            else:
                counts += np.bincount(rows[hit], minlength=len(counts))[: len(counts)]
                cps = np.where(ids == 0, 0, cps)
                left = keep[~hit]
                for (x, y, z), n in zip(*np.unique(np.stack([cps[left], cps[left + 1], cps[left + 2]], 1), axis=0, return_counts=True), strict=True):
                    extra += np.float32(n) * self.trigram(int(x), int(y), int(z))
        return found

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """A bundle for each text, and whether it has a letter."""
        out, known = np.zeros((len(texts), self.dim), np.float32), np.zeros(len(texts), bool)
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            counts = np.zeros((len(part), self.max_rows), np.float32)
            for i, text in enumerate(part):
                if text:
                    known[at + i] = self.add(text, counts[i], out[at + i])
            out[at : at + len(part)] += counts[:, : self.used] @ self.table[: self.used]
        return out, known


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_profiles(docs: DataFrame, dim: int = 1024, seed: int = 7, max_docs: int = 10_000) -> tuple[list[str], np.ndarray]:
    """Language names and unit prototypes, from docs(doc_id, text, lang) with non-null lang.

    Fitted on at most ``max_docs`` documents, chosen by a hash of doc_id, one row for each.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = bounded_sample(known, "doc_id", max_docs, seed).select("text", "lang").repartition(spread(docs.sparkSession))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sums = HyperEncoder(dim, seed), {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 64):
                x, ok = enc.bundles(texts[at : at + 64])
                for lang, v, good in zip(langs[at : at + 64], _unit(x), ok, strict=True):
                    if good:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "sum"])

    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(partial, "lang string, sum binary").collect():
        sums[r[0]] = sums.get(r[0], 0) + np.frombuffer(r[1], np.float64)
    names = sorted(sums)
    return names, _unit(np.array([sums[n] for n in names]).reshape(len(names), dim)).astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, dim: int = 1024, seed: int = 7) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1) for every row of docs(doc_id, text)."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = HyperEncoder(dim, seed)
        for batch in batches:
            texts, langs, scores = batch.column(1).to_pylist(), [], []
            for at in range(0, len(texts), 256):
                x, ok = enc.bundles(texts[at : at + 256])
                if names:
                    cos = np.clip(_unit(x) @ prototypes.T, 0, 1)
                    best = cos.argmax(1)
                    langs += [names[b] if good else UNKNOWN for b, good in zip(best, ok, strict=True)]
                    scores += np.where(ok, cos[np.arange(len(best)), best], 0).astype(float).tolist()
                else:
                    langs += [UNKNOWN] * len(x)
                    scores += [0.0] * len(x)
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    names, prototypes = fit_profiles(docs.where(fold() != 0))
    return identify(docs, names, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
