"""Substring dedup by recompression.

A window is ``WINDOW`` consecutive words. A word goes if it is covered by a window whose
word sequence also starts earlier: in a smaller doc_id, or in the same document before it.

Recompression. Each round names token runs, then token pairs (a coin for each name puts it
left or right; a left name followed by a right one becomes a pair). A name is a hash of
what it stands for, so it is the same wherever the words are, on any executor. Every
symbol carries its *zone*: the words that decide that it is there. Symbols whose zone lies
inside a window are the window's consistent interior symbols: any equal window has them.

1. Each window takes the smallest name among its interior symbols' zones as its *mark* (a
   window without such a symbol, as inside a long run, takes its own hash). Equal windows
   have equal marks. Documents emit their distinct marks; marks met twice are shared.
2. Windows with a shared mark are verified by a 96-bit hash: all but the first place of
   a hash are repeats.
3. Documents drop the words that repeated windows cover.

Exact copies are settled first: each distinct text (by 128 bits of hash) is looked at once,
under its smallest doc_id and a number of its own, so rows that share a doc_id, or have none,
share no key. Hot passages are folded before every shuffle: a batch emits a mark or a window
once, with its other texts packed beside it or its repeats decided on the spot.

A null doc_id comes before all others. Rows that share a doc_id are documents of their
own; rows equal in doc_id and place are equally early, so neither is a repeat of the
other. Null and empty texts have no words. Very long texts are cut into words whole; a batch
holds one such text at least. An empty table gives an empty result. Extra columns are ignored
by ``report`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, staged

WINDOW = 20
ROUNDS = 2
BATCH_WORDS = 1 << 20
NULL_ID = -(1 << 63)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit names."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Names:
    """64-bit names of words, remembered up to a bound."""

    def __init__(self, bound: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.bound = bound

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > self.bound:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], np.uint64)


class Batch:
    """Documents laid end to end, each followed by a separator that equals nothing."""

    def __init__(self, texts: list[list[bytes]], names: Names):
        size = sum(map(len, texts)) + len(texts)
        self.x = np.empty(size, np.uint64)
        self.start = np.empty(len(texts), np.int64)
        at = 0
        valid = np.zeros(size, bool)
        for d, words in enumerate(texts):
            n = len(words)
            self.start[d] = at
            if n:
                self.x[at : at + n] = names(words)
            self.x[at + n] = mix(np.array([d + 1], np.uint64) * _M2)[0]
            valid[at : at + max(0, n - WINDOW + 1)] = True
            at += n + 1
        self.windows = np.flatnonzero(valid)  # starts of whole windows
        self.doc = np.searchsorted(self.start, self.windows, "right") - 1

    def sums(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of x times powers of an odd base, and the inverse powers."""
        n = len(self.x)
        inverse = pow(base, -1, 1 << 64)
        power = _powers(base, n)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.x * power, dtype=np.uint64)]), _powers(inverse, n)

    def hashes(self, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A hash of the words from left to right, right excluded."""
        sums, back = self.sums(base)
        return mix((sums[right] - sums[left]) * back[left] + (right - left).astype(np.uint64))

    def zones(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Left and right ends of the zones of the symbols after so many rounds."""
        name, lo, hi = self.x, np.arange(len(self.x)), np.arange(1, len(self.x) + 1)
        out = len(self.x) + WINDOW
        for r in range(rounds):
            # Runs: a symbol is a whole run only if its neighbours differ, so their zones count.
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            last = np.concatenate([first[1:], [len(name)]]) - 1
            length = (last - first + 1).astype(np.uint64)
            name = np.where(length > 1, mix(name[first] + length * _M1), name[first])
            lo, hi = np.concatenate([[-1], lo[last[:-1]]]), np.concatenate([hi[first[1:]], [out]])
            # Pairs: a left symbol before a right one. Alone, a symbol depends on the neighbour it could have joined.
            right = (mix(name + np.uint64((r + 1) * int(_M2) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
            pair = np.flatnonzero(~right[:-1] & right[1:])
            with_left, with_right = np.minimum(np.concatenate([[-1], lo[:-1]]), lo), np.maximum(np.concatenate([hi[1:], [out]]), hi)
            lo, hi = np.where(right, with_left, lo), np.where(right, hi, with_right)
            joined = mix(name[pair] * _M1 + mix(name[pair + 1]))
            name = name.copy()
            name[pair], lo[pair], hi[pair] = joined, np.minimum(lo[pair], with_left[pair + 1]), np.maximum(hi[pair], hi[pair + 1])
            keep = np.ones(len(name), bool)
            keep[pair + 1] = False
            name, lo, hi = name[keep], lo[keep], hi[keep]
        return lo, hi

    def marks(self, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """The mark of each window, and whether it may stand at two places of this batch."""
        if not len(self.windows):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        lo, hi = self.zones(rounds)
        fit = (lo >= 0) & (hi <= len(self.x)) & (hi - lo <= WINDOW)
        lo, hi = lo[fit], hi[fit]
        value = self.hashes(0x9E3779B97F4A7C15, lo, hi)
        best = np.full(len(self.x) + 1, _NONE)
        for back in range(WINDOW):
            use = (hi - lo <= WINDOW - back) & (lo >= back)
            if use.any():
                np.minimum.at(best, lo[use] - back, value[use])
        best = best[self.windows]
        alone = best == _NONE
        if alone.any():
            at = self.windows[alone]
            best[alone] = mix(self.hashes(0x9E3779B97F4A7C15, at, at + WINDOW) + np.uint64(1))
        places = np.sort(np.concatenate([value, best[alone]]))
        return best, np.isin(best, places[1:][places[1:] == places[:-1]])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[base][:n]


def _words(value: pa.Scalar) -> list[bytes]:
    return (value.as_py() or "").encode("utf-8", "replace").split()


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of about BATCH_WORDS words, with the words."""
    for batch in batches:
        words, size, at = [], 0, 0
        for i, value in enumerate(batch.column(text)):
            words.append(_words(value))
            size += len(words[-1])
            if size >= BATCH_WORDS:
                yield batch.slice(at, i + 1 - at), words
                words, size, at = [], 0, i + 1
        if words:
            yield batch.slice(at), words


def shared_marks(texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """t and marks: for each of texts(t, text) its marks that stand more than once in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, words in _batches(batches, 1):
            ids = batch.column(0).to_numpy()
            b = Batch(words, names)
            (marks, spot), doc = b.marks(rounds), b.doc
            new = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (doc[1:] != doc[:-1])])) if len(marks) else np.zeros(0, np.int64)
            marks, doc, spot = marks[new], doc[new], spot[new]
            order = np.lexsort((doc, marks))
            marks, doc, spot = marks[order], doc[order], spot[order]
            first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])) if len(marks) else order
            count = np.diff(np.append(first, len(marks)))
            more: list[bytes | None] = [None] * len(first)
            for i in np.flatnonzero((count > 1) | np.maximum.reduceat(spot, first) if len(first) else first).tolist():
                more[i] = np.unique(ids[doc[first[i] + 1 : first[i] + count[i]]]).astype("<i8").tobytes()
            yield pa.record_batch([pa.array(marks[first].view(np.int64)), pa.array(ids[doc[first]], pa.int64()), pa.array(more, pa.binary())], ["mark", "t", "more"])

    emitted = texts.mapInArrow(run, "mark long, t long, more binary")
    met = emitted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mark"))).where("n > 1 or more is not null")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            other = [np.frombuffer(v.as_py() or b"", "<i8") for v in batch.column(2)]
            size = np.array([len(o) for o in other], np.int64)
            for at in range(0, len(marks), 1024):
                part = slice(at, at + 1024)
                yield pa.record_batch([pa.array(np.concatenate([ids[part], *other[part]])), pa.array(np.concatenate([marks[part], np.repeat(marks[part], size[part])]))], ["t", "mark"])

    found = met.select("mark", "t", "more").mapInArrow(unpack, "t long, mark long")
    return found.groupBy("t").agg(F.collect_set("mark").alias("marks"))  # bounded by each text's own length


def repeats(texts: DataFrame, marks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """t and spans (starts and counts of repeated windows) of each of texts(t, first, text) that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch, words in _batches(batches, 2):
            number, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = Batch(words, names)
            (mark, _), at, doc = b.marks(rounds), b.windows, b.doc
            wanted, lists = np.zeros(len(mark), bool), batch.column(3)
            edges = np.searchsorted(doc, np.arange(len(ids) + 1))
            for d in range(len(ids)):
                own = slice(edges[d], edges[d + 1])
                wanted[own] = np.isin(mark[own], lists[d].values.to_numpy().view(np.uint64))
            at, doc = at[wanted], doc[wanted]
            w1, w2 = (b.hashes(base, at, at + WINDOW).view(np.int64) for base in (0xD1342543DE82EF95, 0xA0761D6478BD642F))
            w2 = w2.astype(np.int32)
            place, key, t = (at - b.start[doc]).astype(np.int32), ids[doc], number[doc]
            order = np.lexsort((place, key, w2, w1))
            w1, w2, place, key, t = w1[order], w2[order], place[order], key[order], t[order]
            same = np.concatenate([[False], (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]) if len(w1) else np.zeros(0, bool)
            leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(w1)))) if len(w1) else order
            later = same & ((key != key[leader]) | (place != place[leader]))  # repeats of this very batch
            judged = ~later
            order = np.lexsort((place, t))
            open_ = later[order]
            t2, key2, place2 = t[order][open_], key[order][open_], place[order][open_]
            step = np.concatenate([[True], (t2[1:] != t2[:-1]) | (place2[1:] != place2[:-1] + 1)]) if len(t2) else np.zeros(0, bool)
            head = np.flatnonzero(step)
            span = np.diff(np.append(head, len(t2))).astype(np.int32)
            spread = mix((t2[head] * 31 + place2[head]).view(np.uint64)).view(np.int64)
            yield pa.record_batch([
                pa.array(np.concatenate([w1[judged], spread])), pa.array(np.concatenate([w2[judged], np.zeros(len(head), np.int32)])),
                pa.array(np.concatenate([t[judged], t2[head]])), pa.array(np.concatenate([key[judged], key2[head]])), pa.array(np.concatenate([place[judged], place2[head]])),
                pa.array(np.concatenate([np.zeros(judged.sum(), np.int32), span])),
            ], ["w1", "w2", "t", "doc_id", "at", "span"])

    open_ = texts.join(marks, "t").select("t", "first", "text", "marks")
    found = open_.mapInArrow(run, "w1 long, w2 int, t long, doc_id long, at int, span int")
    here = F.struct("doc_id", "at")
    first = F.min(here).over(Window.partitionBy("w1", "w2", F.col("span") > 0))
    late = found.withColumn("first", first).where((F.col("span") > 0) | (here > F.col("first")))
    return late.groupBy("t").agg(F.collect_list(F.struct("at", F.greatest("span", F.lit(1)).alias("n"))).alias("spans"))  # bounded by each text's own length


def _key(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def _text_key(names: tuple[str, str]) -> list:
    """128 bits of hash of the text; null texts, which match nothing, are spread by their doc_id."""
    null = F.col("text").isNull()
    return [F.when(null, F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias(names[0]), F.when(null, F.lit(0)).otherwise(F.xxhash64(F.lit(1), "text")).alias(names[1])]


def repeated_windows(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """ta, tb (the text's key), first and spans of each distinct text that has copies or repeats, staged in the shared folder.

    All windows of an exact copy also start in its first copy, so copies are settled at
    once; marks and windows are looked for once in each distinct text.
    """
    rows = docs.select("text", _key().alias("key"), *_text_key(("ta", "tb"))).where("text is not null")
    texts = rows.groupBy("ta", "tb").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    texts = staged(texts.withColumn("t", F.monotonically_increasing_id()), "texts")  # numbered once it is written
    marks = staged(shared_marks(texts.select("t", "text"), rounds), "marks")
    found = staged(repeats(texts.select("t", "first", "text"), marks, rounds), "spans")
    own = texts.select("ta", "tb", "t", "first", "copies").join(found, "t", "left")
    return staged(own.where("copies > 1 or spans is not null").select("ta", "tb", "first", "spans"), "repeats")


def covered(n: int, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of n words are covered by windows: count[i] consecutive ones from at[i]."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(n, at + count - 1 + WINDOW), -1)
    return np.cumsum(change[:n]) > 0


def with_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs with two more columns, last: whether the row is a later copy (null: neither), and spans; every row and column kept."""
    found = repeated_windows(docs.select("doc_id", "text"), rounds)
    ta, tb, first, spans, later = (fresh(n, docs.columns) for n in ("ta", "tb", "first", "spans", "later"))
    found = found.select(F.col("ta").alias(ta), F.col("tb").alias(tb), F.col("first").alias(first), F.col("spans").alias(spans))
    joined = docs.select("*", *_text_key((ta, tb))).join(found, [ta, tb], "left")
    return joined.select(*docs.columns, (_key() > F.col(first)).alias(later), spans)


def _cover(later: pa.Scalar, spans: pa.Scalar, n: int) -> np.ndarray | None:
    """Which of a text's n words go; None if none."""
    if n < WINDOW or not (spans.is_valid or later.as_py()):
        return None
    if later.as_py():
        return np.ones(n, bool)
    return covered(n, spans.values.field("at").to_numpy().astype(np.int64), spans.values.field("n").to_numpy().astype(np.int64))


def report(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, digest = [], [], []
            for text, later, spans in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = _words(text)
                cover = _cover(later, spans, len(words))
                kept = words if cover is None else [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                size.append(len(words))
                gone.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rounds)
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs without the repeated words; what stands between kept words stays as it was.

    Every row and column stays; a document may end up empty. n_chars, if there, follows.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, later, spans in zip(batch.column(at), batch.column(len(names)), batch.column(len(names) + 1), strict=True):
                cover = _cover(later, spans, len(_words(text)))
                texts.append(text.as_py() if cover is None else without(text.as_py(), cover))
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    out = with_spans(docs, rounds).mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*names)
    return out


def without(text: str, cover: np.ndarray) -> str:
    """The text without its covered words and the white space that follows each."""
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    for match, gone in zip(_WORD.finditer(raw), cover.tolist(), strict=True):
        if gone:
            out.append(raw[at : match.start()])
            at = match.end()
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs WHERE len(words) >= 20
), late AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(words[i:i + 19], ' ')) ORDER BY doc_id, i) AS n FROM starts) AS w
  WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, (SELECT unnest(range(0, 20)) AS k) AS r
), words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM words AS w LEFT JOIN gone AS g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs AS d LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""
