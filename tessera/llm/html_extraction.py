"""Main text of HTML pages, with a host suffix array.

A page is cut into blocks at block-level tags. Markup gives each block a place. *Furniture*
(menus, headers, footers, sidebars, adverts, notices, forms, reader comments) goes: it is known
by its tag, or by a class or id that says nothing else (``ad-box``, ``related-posts``). A class
that only holds such a word (``related-work``) is a hint and decides nothing by itself.
``article`` and ``main`` are never furniture by their class; one that stands inside
furniture, or whose class is a furniture class, counts only on a page without another.

Where a page marks its article, the article's blocks are candidates, else all blocks that
aren't furniture are. The host suffix array judges the candidates of every page; markup only
sets how much it takes. Two streams of a page are counted apart from each other: the *article*
stream, and the *open* one (pages that mark no article, and hinted blocks). The host's
distinct pages (equal ones count once) lay their streams end to end.

* Open: a substring of ``MIN_TOKENS`` tokens on ``MIN_PAGES`` pages of the host is boilerplate,
  and so is a whole block, of any length, on as many pages if they are also ``SHARE`` of the
  host's. Covered tokens go and the unique runs of a block stay.
* Article: such substrings are boilerplate on ``MIN_PAGES`` pages that are also
  ``ARTICLE_SHARE`` of the host's. A block that is covered whole goes (a notice that no markup
  tells from the article), others stay whole, and so do short ones that only recur (headings).
  Where no more than half of the article's tokens would be left, all stay: the article itself
  is what other pages copy.

A suffix array (prefix doubling) sorts the suffixes of each batch of pages, so equal substrings
stand together and are counted by page; the counts of all batches of a host are then added by
the substring's hash. How pages are dealt out over tasks has no influence. That is done twice:

1. for all pages, with a sparse array: of each ``MIN_TOKENS`` tokens only the suffix whose first
   ``MARK_TOKENS`` tokens have the smallest hash is sorted, by those. Equal substrings share
   it, so one that is on enough pages has a suffix that is (equal pages of two batches count
   twice here, which only lets more through);
2. with all suffixes that such a one stands for, by ``MIN_TOKENS`` tokens, over distinct pages.

Html isn't shuffled, and no text in the first round: pages are parsed where they are read, each
time they are needed. Blocks are joined with what the array found only if it found something.

Null and empty html give empty text. A null url has an empty host. Very long pages are parsed
and judged whole. Repeated rows, and rows that share a page_id or have none, are pages of
their own in the result. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

MIN_TOKENS = 16  # a power of two
MARK_TOKENS = 8  # a power of two
MIN_PAGES = 3
SHARE = 0.3
ARTICLE_SHARE = 0.5
BATCH_TOKENS = 1 << 18

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<(script|style|noscript|template|textarea|select|svg|iframe|object|canvas|title|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: HTML tags by how they are treated.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NESTING = frozenset("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
FURNITURE = frozenset("aside dialog footer form header menu nav".split())
#: Words of class, id and role that mark furniture, and words that say nothing beside them.
FURNITURE_WORDS = frozenset("ad ads adv advert advertisement advertorial banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget complementary contentinfo search".split())
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons card center col column columns container content desktop fixed form global group inline inner item items left link links list mobile module outer page panel post posts primary right row secondary section site slot sticky text title top unit wrap wrapper zone".split())
ARTICLE_WORDS = frozenset("article main".split())


def _names_in(attributes: str) -> list[list[str]]:
    """Each class, id and role, cut into its words."""
    names = (n for m in _NAMED.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").lower().split())
    return [[w for w in re.split(r"[^a-z0-9]+", n) if w] for n in names]


def _kind(names: list[list[str]]) -> str:
    """furniture, hint or nothing, by class, id and role."""
    found = ""
    for words in names:
        if not FURNITURE_WORDS.isdisjoint(words):
            if all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
                return "furniture"
            found = "hint"
    return found


def _place(stack: list[tuple[str, str]]) -> str:
    places = [p for _, p in stack]
    last = max((i for i, p in enumerate(places) if p in ("article", "weak")), default=None)
    if last is None:
        return "furniture" if "furniture" in places else "open"
    if "furniture" in places[last + 1 :]:
        return "furniture"
    if "furniture" in places or "weak" in places:
        return "weak"
    return "hinted" if "hint" in places[last + 1 :] else "article"


def blocks(html: str | None) -> list[tuple[str, str]]:
    """(text, place) of each block that belongs to the text or may; place: article, hinted or open."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    text, at = html or "", 0

    def close() -> None:
        words = entities.unescape("".join(parts)).split()
        parts.clear()
        if words:
            out.append((" ".join(words), _place(stack)))

    for m in _MARK.finditer(text):
        parts.append(text[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                parts.append(" ")
            continue
        tag, attributes = m[3].lower(), m[4]
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCK:
            continue
        close()
        if tag not in NESTING or attributes.endswith("/"):
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        else:
            names = _names_in(attributes) if "=" in attributes else []
            kind = _kind(names)
            if tag in ("article", "main"):
                place = "weak" if kind == "furniture" else "article"
            elif tag in FURNITURE and not (tag == "header" and any(p == "article" for _, p in stack)):
                place = "furniture"
            elif kind != "furniture" and tag in ("div", "section") and any(not ARTICLE_WORDS.isdisjoint(words) for words in names):
                place = "article"
            else:
                place = kind
            stack.append((tag, place))
    rest = text[at:]
    parts.append(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!?][^>]*\Z", rest) else rest)
    close()
    places = {place for _, place in out}
    if "article" in places or "hinted" in places:
        return [(t, p) for t, p in out if p in ("article", "hinted")]
    if "weak" in places:
        return [(t, "article") for t, p in out if p == "weak"]
    return [(t, p) for t, p in out if p == "open"]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` (a power of two) tokens; equal prefixes, equal ranks."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < depth:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-size] = rank[size:]
        key = rank * (len(rank) + 1) + ahead + 1
        order = np.argsort(key, kind="stable")  # the suffix array to twice the depth
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(new)
        rank[order] = new
        size *= 2
    return rank


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ARTICLE = "article\0"  # before the host it is the key of an article stream


def _name(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "replace"))


def judged(found: list[tuple[str, str]]) -> list[str]:
    return [text for text, place in found if place != "article"]


def streams(host: str, name: int, found: list[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """The open and the article stream of a page, as far as they have blocks: (key, name, blocks)."""
    both = ((host, judged(found)), (_ARTICLE + host, [text for text, place in found if place == "article"]))
    return [(key, name, texts) for key, texts in both if texts]


def page_name(host: str, found: list[tuple[str, str]]) -> int:
    """A name for what a page of this host holds, as a signed long."""
    return _signed(_name(host, *(x for block in found for x in block)))


def _signed(name: int) -> int:
    return name - (1 << 64) if name >> 63 else name


def window_hashes(host: str, tokens: list[str]) -> np.ndarray:
    """A hash of each ``MIN_TOKENS`` consecutive tokens on a host."""
    return _windows(_token_hashes(tokens), MIN_TOKENS) + np.uint64(_name("host", host))


def marks(host: str, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each ``MARK_TOKENS`` consecutive tokens on a host, and for each window the smallest inside it."""
    grams = _windows(_token_hashes(tokens), MARK_TOKENS) + np.uint64(_name("mark", host))
    span = MIN_TOKENS - MARK_TOKENS + 1
    if len(tokens) < MIN_TOKENS:
        return grams, np.zeros(0, np.uint64)
    return grams, np.lib.stride_tricks.sliding_window_view(grams, span).min(1)


def _token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) for t in tokens), np.uint64, len(tokens))


def _windows(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(x) - size + 1), np.uint64)
    for k in range(size):
        out = _mix(out + x[k : k + len(out)])
    return out


def block_hash(host: str, text: str) -> int:
    return _name("block", host, text)


def _counted(pages: list[tuple[str, int, list[str]]], tokens: list[list[str]], depth: int, at: list[np.ndarray], hashes: list[np.ndarray]) -> list[tuple[int, str, list[int]]]:
    """(hash, key, pages) of each distinct substring of ``depth`` tokens that starts at these places of the streams."""
    ids: dict[str, int] = {}
    keys: dict[str, int] = {}
    starts = np.cumsum([0] + [len(s) + 1 for s in tokens])
    stream, page = np.empty(int(starts[-1]), np.int64), np.empty(int(starts[-1]), np.int64)
    for k, own in enumerate(tokens):
        stream[starts[k] : starts[k + 1] - 1] = [ids.setdefault(t, len(ids)) for t in own]
        stream[starts[k + 1] - 1] = -1 - k  # a separator equals nothing
        page[starts[k] : starts[k + 1]] = k
    where = np.concatenate([starts[k] + x for k, x in enumerate(at)]) if at else np.zeros(0, np.int64)
    if not len(where):
        return []
    key = np.array([keys.setdefault(h, len(keys)) for h, _, _ in pages], np.int64)
    names, h = np.array([n for _, n, _ in pages], np.int64), np.concatenate(hashes)
    rank, own = suffix_ranks(stream, depth)[where], page[where]
    order = np.lexsort((own, key[own], rank))
    rank, own, h = rank[order], own[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (key[own[1:]] != key[own[:-1]])]))
    ends, name = np.append(first[1:], len(own)), names[own].tolist()
    key_of = [pages[k][0] for k in own[first].tolist()]
    return [(x, y, [name[a]] if b - a == 1 else sorted(set(name[a:b]))) for x, y, a, b in zip(h[first].tolist(), key_of, first.tolist(), ends.tolist(), strict=True)]


def _lines(pages: list[tuple[str, int, list[str]]], signs: list[frozenset[int]] | None) -> list[tuple[int, str, list[int]]]:
    """(hash, key, pages) of each distinct block of open streams."""
    found: dict[tuple[str, str], set[int]] = {}
    for key, name, texts in pages:
        for text in () if key.startswith(_ARTICLE) else texts:
            found.setdefault((key, text), set()).add(name)
    hashed = ((block_hash(key, text), key, sorted(names)) for (key, text), names in found.items())
    if signs is None:
        return list(hashed)
    met = frozenset().union(*signs)
    return [x for x in hashed if x[0] in met]


def samples(pages: list[tuple[str, int, list[str]]]) -> list[tuple[int, str, list[int]]]:
    """The first round: (hash, key, pages) of every sampled suffix and block of these streams (key, page, blocks)."""
    tokens, at, hashes = [[t for text in texts for t in text.split(" ")] for _, _, texts in pages], [], []
    for (key, _, _), own in zip(pages, tokens, strict=True):
        grams, least = marks(key, own)
        at.append(np.flatnonzero(np.isin(grams, least)))
        hashes.append(grams[at[-1]])
    return _counted(pages, tokens, MARK_TOKENS, at, hashes) + _lines(pages, None)


def substrings(pages: list[tuple[str, int, list[str]]], signs: list[frozenset[int]] | None = None) -> list[tuple[int, str, list[int]]]:
    """(hash, key, pages) of every substring and block of these streams (key, page, blocks).

    With ``signs``, for each stream hashes that the first round found: of those that they stand for.
    """
    tokens, at, hashes = [[t for text in texts for t in text.split(" ")] for _, _, texts in pages], [], []
    for k, own in enumerate(tokens):
        if signs is None:
            at.append(np.arange(max(0, len(own) - MIN_TOKENS + 1)))
        else:
            at.append(np.flatnonzero(np.isin(marks(pages[k][0], own)[1], np.fromiter(signs[k], np.uint64, len(signs[k])))))
        hashes.append(window_hashes(pages[k][0], own)[at[-1]])
    return _counted(pages, tokens, MIN_TOKENS, at, hashes) + _lines(pages, signs)


def _covered(key: str, tokens: list[str], repeated: set[int] | frozenset[int]) -> np.ndarray:
    """Which tokens of a stream lie in boilerplate substrings."""
    gone = np.zeros(len(tokens) + 1, np.int64)
    if repeated:
        at = np.flatnonzero(np.isin(window_hashes(key, tokens), np.fromiter(repeated, np.uint64, len(repeated))))
        np.add.at(gone, at, 1)
        np.add.at(gone, at + MIN_TOKENS, -1)
    return np.cumsum(gone)[: len(tokens)] > 0


def main_text(host: str, found: list[tuple[str, str]], repeated: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text of a page, given the hashes of what is boilerplate on its host."""
    kept: dict[str, list[str]] = {}
    for key, _, texts in streams(host, 0, found):
        words = [text.split(" ") for text in texts]
        gone, at, left = _covered(key, [w for own in words for w in own], repeated), 0, []
        for text, own in zip(texts, words, strict=True):
            mine, at = gone[at : at + len(own)], at + len(own)
            if mine.all() or key == host and block_hash(key, text) in repeated:
                left.append("")
            else:
                left.append(text if key != host else " ".join(w for w, g in zip(own, mine.tolist(), strict=True) if not g))
        if key != host and 2 * sum(len(own) for own, text in zip(words, left, strict=True) if text) <= len(gone):
            left = texts  # the article itself is what other pages copy
        kept["article" if key != host else ""] = left[::-1]
    texts = (kept["article" if place == "article" else ""].pop() for _, place in found)
    return "\n".join(text for text in texts if text)


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_SIGN = pa.schema([("h", pa.int64()), ("site", pa.int64()), ("share", pa.float64()), ("pages", pa.list_(pa.int64()))])
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("place", pa.string())]))


def _site(host: str) -> int:
    return _signed(_name("site", host))


def _signs(found: list[tuple[int, str, list[int]]], held: list[tuple[str, int, list[str]]]) -> pa.RecordBatch:
    """Rows (h, site, share, pages) of what these streams hold: the share of its site's pages that each needs."""
    lines = {block_hash(key, text) for key, _, texts in held if not key.startswith(_ARTICLE) for text in texts}
    columns: list[list] = [[], [], [], []]
    sites = {key: _site(key.removeprefix(_ARTICLE)) for key in {key for _, key, _ in found}}
    for h, key, pages in found:
        share = ARTICLE_SHARE if key.startswith(_ARTICLE) else SHARE if h in lines else 0.0
        for column, x in zip(columns, (_signed(h), sites[key], share, pages), strict=True):
            column.append(x)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SIGN.types, strict=True)], schema=_SIGN)


def _frequent(signs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The hashes that are on as many pages as they need."""
    counts = signs.groupBy("h", "site", "share").agg(F.sum(F.size("pages")).alias("n")).where(F.col("n") >= MIN_PAGES)
    return counts.join(sizes, "site").where(F.col("n") >= F.col("size") * F.col("share")).select("h")


def _by_page(signs: DataFrame, frequent: DataFrame, name: str) -> DataFrame:
    """page, and which of these hashes are on it; bounded by each page's own length."""
    hit = signs.select("h", "pages").join(frequent, "h").select("h", F.explode("pages").alias("page"))
    return hit.groupBy("page").agg(F.collect_set("h").alias(name))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row of pages(page_id, url, html)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            own_streams = [stream for _, own in held.values() for stream in own]
            yield _signs(samples(own_streams), own_streams)
            # and the pages themselves, to be counted: without a share
            yield pa.record_batch([pa.array(held, pa.int64()), pa.array([_site(h) for h, _ in held.values()], pa.int64()), pa.nulls(len(held), pa.float64()), pa.nulls(len(held), _SIGN.types[3])], schema=_SIGN)

        held: dict[int, tuple[str, list[tuple[str, int, list[str]]]]] = {}
        size = 0
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = blocks(html.as_py())
                name = page_name(host, found)
                if name not in held:
                    held[name] = host, streams(host, name, found)
                    size += sum(t.count(" ") + 1 for t, _ in found) + 1
                if size >= BATCH_TOKENS:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = [], []
            for host, html in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = blocks(html.as_py())
                names.append(page_name(host, found))
                lists.append([{"text": t, "place": p} for t, p in found])
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array(names, pa.int64()), pa.array(lists, _BLOCKS)], ["page_id", "url", "host", "page", "blocks"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return _signs(substrings(held, signs), held)

        held, signs, size = [], [], 0
        for batch in batches:
            for host, name, found, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = frozenset(h % (1 << 64) for h in own)
                for stream in streams(host, name, [(b["text"], b["place"]) for b in found]):
                    held.append(stream)
                    signs.append(own)
                size += sum(b["text"].count(" ") + 1 for b in found)
                if size >= BATCH_TOKENS:
                    yield out()
                    held, signs, size = [], [], 0
        yield out()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host, found, hashes in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(main_text(host, [(b["text"], b["place"]) for b in found], {h % (1 << 64) for h in hashes or []}))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    host = F.coalesce(F.lower(F.regexp_extract("url", _HOST, 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    parsed = rows.mapInArrow(parse, "page_id long, url string, host string, page long, blocks array<struct<text: string, place: string>>")
    sign = "h long, site long, share double, pages array<long>"
    sampled = staged(rows.select("host", "html").mapInArrow(sample, sign), "samples")
    sizes = staged(sampled.where("share is null").select("site", "h").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("size")), "sizes")
    sampled = sampled.where("share is not null")
    hits = staged(_by_page(sampled, staged(_frequent(sampled, sizes), "marks"), "signs"), "signs")
    if not hits.isEmpty():
        found = parsed.select("page", "host", "blocks").join(hits, "page").dropDuplicates(["page"])
        emitted = staged(found.select("host", "page", "blocks", "signs").mapInArrow(emit, sign), "substrings")
        hits = staged(_by_page(emitted, staged(_frequent(emitted, sizes), "common"), "hashes"), "hits")
        parsed = parsed.join(hits, "page", "left")
    else:
        parsed = parsed.withColumn("hashes", F.lit(None).cast("array<long>"))
    return parsed.select("page_id", "url", "host", "blocks", "hashes").mapInArrow(cover, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
