"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. A merge list has a *sufficient lookahead* K: reading on cannot change a token
that ends K or more symbols before the end of what has been read (``sufficient_lookahead``).
So a piece of any length is encoded with a buffer of K symbols plus one block: merge the
buffer, emit the tokens that end before its last K symbols, keep the rest. Tokens never
cross an emitted boundary, so the rest can be merged on its own.

Decoding. ``Decoder`` is a state machine over ids. With byte-level decoding it holds at
most three bytes of an unfinished character; without a decoder the token strings are
joined by one blank, as the tokenizers library does.

Texts are cut at blanks and line ends, which no piece spans, so memory does not grow with
a very long text beyond the text itself. Null texts count as empty: no ids, empty
decoded text. Ids are little-endian unsigned 32-bit integers in the digest. Repeated rows, and
rows that share a doc_id or have none, are encoded each on its own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "word_bpe_49k.json"
SEGMENT = 1 << 16
_NONE = 1 << 62
BLOCK = 1024


def vocabulary_text(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 is itself, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after which a token's end is settled, from the merge list alone.

    A symbol that arrives can undo a merge, which frees or takes the token to its left,
    and so on. Each further step needs a merge of later rank whose right part starts with
    the freed left part. The longest such chain, in symbols, bounds how far left a change
    reaches; one token's length more covers the token at its end.
    """
    reach: dict[str, int] = {}
    most = longest = 1
    for left, right in merges:
        a, b = left.removesuffix("</w>"), right.removesuffix("</w>")
        longest = max(longest, len(a) + len(b))
        chain = len(a) + max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), chain)
        most = max(most, chain)
    return most + longest


class Bpe:
    """An encoder and decoder for a vocabulary file's text."""

    def __init__(self, vocabulary: str, cache: int = 600_000):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.pieces = {i: t for t, i in vocab.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.lookahead = sufficient_lookahead(merges)
        #: (left id, right id) in one int -> (rank, merged id) in one int, which orders by rank
        self.rank = {(vocab[a] << 32) | vocab[b]: (r << 32) | vocab[a + b] for r, (a, b) in reversed([*enumerate(merges)])}
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pre = spec["pre_tokenizer"]
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in pre["pretokenizers"] if p["type"] == "Split"))
        kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.decoder = spec["decoder"]
        self.known: dict[str, bytes] = {}
        self.cache = cache
        self.piece_bytes = [self.pieces.get(i, "").encode() for i in range(max(self.pieces) + 1)]

    def merge(self, ids: list[int]) -> list[int]:
        """The merges of one buffer: always the earliest-ranked pair, leftmost first."""
        get = self.rank.get
        if len(ids) <= 64:
            ranks = [get((a << 32) | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != _NONE:
                at = ranks.index(best)
                ids[at : at + 2] = [best & 0xFFFFFFFF]
                del ranks[at]
                if at:
                    ranks[at - 1] = get((ids[at - 1] << 32) | ids[at], _NONE)
                if at < len(ranks):
                    ranks[at] = get((ids[at] << 32) | ids[at + 1], _NONE)
            return ids
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r >> 32, i, r, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, r, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r & 0xFFFFFFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get((ids[x] << 32) | ids[y])):
                    heapq.heappush(heap, (r >> 32, x, r, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def symbols_in(self, token: int) -> int:
        text = self.pieces[token]
        return len(text) - (len(self.suffix) if self.suffix and text.endswith(self.suffix) else 0)

    def transduce(self, blocks: Iterable[list[int]]) -> Iterator[int]:
        """Tokens of one piece whose symbols arrive in blocks, each as soon as it is stable."""
        held: list[int] = []
        for block in blocks:
            held += block
            if len(held) < self.lookahead + BLOCK:
                continue
            end, emitted, stable = 0, 0, len(held) - self.lookahead
            for token in self.merge(held.copy()):
                end += self.symbols_in(token)
                if end > stable:
                    break
                emitted = end
                yield token
            del held[:emitted]
        yield from self.merge(held)

    def piece(self, text: str) -> list[int] | Iterator[int]:
        raw = text.encode("utf-8", "replace")
        if len(raw) <= 64:  # shorter than any lookahead: one buffer
            ids = [self.first[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            return self.merge(ids)
        head, end = raw[:-1], self.last[raw[-1]]
        return self.transduce([self.first[b] for b in head[i : i + BLOCK]] + [end] * (i + BLOCK >= len(head)) for i in range(0, len(head), BLOCK))

    def packed(self, chunk: str) -> bytes:
        """The ids of a stretch without blanks, as bytes, remembered unless it is long."""
        ids: list[int] = []
        for part in self.split_special.split(chunk) if self.split_special and "<|" in chunk else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for piece in self.pattern.findall(self.normal(part)):
                    ids += self.piece(piece)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[chunk] = found
        return found

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
            if self.lower:
                text = text.replace("Σ", "σ")  # letter by letter: no final sigma
        return text.lower() if self.lower else text

    def encode_packed(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, as bytes, segment by segment. No piece spans a blank or line end."""
        text, known, packed, at = text or "", self.known, self.packed, 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT:
                ends = [x for x in (text.find(" ", at + SEGMENT), text.find("\n", at + SEGMENT)) if x >= 0]
                end = min(ends, default=end)
            chunks = text[at:end].replace("\n", " ").split(" ")
            yield b"".join([known.get(c) or packed(c) for c in chunks if c])
            at = end

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode_packed(text)), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        state = Decoder(self)
        return (state.feed(ids) + state.finish()).decode("utf-8", "replace")


class Decoder:
    """Incremental ids to UTF-8. ``feed`` returns what is settled, ``finish`` the rest."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.started, self.open = bpe, False, b""
        self.bytewise = bool(bpe.decoder) and bpe.decoder.get("type") == "ByteLevel"
        if self.bytewise:
            self.back = {x: b for b, x in enumerate(byte_letters())}

    def feed(self, ids: Iterable[int]) -> bytes:
        pieces = self.bpe.piece_bytes
        if not self.bytewise:
            out = b" ".join([pieces[i] for i in ids])
            if out or not self.started:
                out, self.started = (b" " + out if self.started and out else out), self.started or bool(out)
            return out
        raw = self.open + b"".join(bytes(self.back[c] for c in self.bpe.pieces[i]) if i not in self.bpe.special.values() else pieces[i] for i in ids)
        cut = len(raw)
        for back in range(1, min(4, len(raw)) + 1):  # an unfinished character at the end waits
            lead = raw[-back]
            if lead >= 0xC0:
                if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    cut = len(raw) - back
                break
            if lead < 0x80:
                break
        self.open = raw[cut:]
        return raw[:cut].decode("utf-8", "replace").encode()

    def finish(self) -> bytes:
        return self.open.decode("utf-8", "replace").encode()


def round_trip(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text); ids too if kept.

    vocabulary: the text of a vocabulary file, which travels with the tasks.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for value in batch.column(1):
                ids, plain, n, state, kept = hashlib.sha256(), hashlib.sha256(), 0, Decoder(bpe), []
                for part in bpe.encode_packed(value.as_py()):
                    ids.update(part)
                    n += len(part) // 4
                    plain.update(state.feed(struct.unpack(f"<{len(part) // 4}I", part)))
                    if keep_ids:
                        kept.append(part)
                plain.update(state.finish())
                for column, x in zip(columns, (n, ids.hexdigest(), plain.hexdigest(), b"".join(kept)), strict=True):
                    column.append(x)
            yield pa.record_batch([batch.column(0), *map(pa.array, columns[: 3 + keep_ids])], schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_text())
