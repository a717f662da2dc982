"""Each training-data operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import bpe, chat_format, common, decontamination, html_extraction, language_id, license_scan, quality, simhash, substring_dedup, vector_search

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
AWKWARD = [(1, "The quick brown fox. " * 12, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "Der schnelle Fuchs", "de", "a", 1), (4, LONG, "en", "a", 1), (5, " \n\t ", None, "c", 3), (1, "The quick brown fox. " * 12, "en", "a", 9), (6, "x", "de", None, 1), (7, "a " * 300, "en", "a", 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    rows = spark.createDataFrame(AWKWARD, DOC)
    return rows.withColumns({c: F.lit("extra") for c in ("score", "key", "spans", "leak", "fp", "tag", "quality", "n", "h", "mark")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bounded_sample_is_bounded_where_keys_repeat(spark):
    rows = spark.createDataFrame([(i % 50, f"text {i}") for i in range(2000)] + [(None, "x")] * 100, "doc_id long, text string")
    got = common.bounded_sample(rows, "doc_id", 20, 1)
    assert got.columns == rows.columns and got.count() == 20 == got.select("doc_id").distinct().count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, common.bounded_sample(rows.repartition(7), "doc_id", 20, 1).collect()))


# --- language identification ---


def prose(words, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(words, n))


def test_language_id(spark, awkward, empty):
    words = {"en": "the of and to in that with for was".split(), "de": "der die und zu den mit für war ist".split(), "fr": "le la et de que dans pour était".split()}
    docs = spark.createDataFrame([(i, prose(w, i), k, None, 1) for i, (k, w) in enumerate(list(words.items()) * 40)], DOC)
    names, prototypes = language_id.fit_profiles(docs.where("doc_id % 5 <> 0"), dim=512)
    assert names == ["de", "en", "fr"]
    got = rows_of(language_id.identify(docs, names, prototypes, dim=512))
    assert all(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.collect())
    odd = language_id.identify(awkward, names, prototypes, dim=512).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    found = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert found[2] == found[3] == found[5] == "und" and found[4] != "und"
    assert language_id.identify(empty, names, prototypes, dim=512).count() == 0
    assert language_id.fit_profiles(empty)[0] == []
    nothing = language_id.identify(awkward, [], np.zeros((0, 512), np.float32), dim=512)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters():
    enc = language_id.HyperEncoder(dim=64, max_rows=3)  # a full table takes the slow path
    text = "Hello, wörld 漢字! hello"
    got, known = enc.bundles([text, None, "12 34"])
    padded = [ord(c) if c.isalpha() else 0 for c in f" {text} ".lower()]
    want = sum(enc.trigram(a, b, c).astype(np.float32) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False) if b)
    assert np.allclose(got[0], want) and known.tolist() == [True, False, False]
    again, _ = language_id.HyperEncoder(dim=64).bundles([text])
    assert np.allclose(again[0], want)


# --- tokens ---


@pytest.fixture(scope="module")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public.path(bpe.DEFAULT_VOCABULARY))
    return bpe.Bpe(bpe.vocabulary_text()), library


TEXTS = ["", "Hello, world!", "It's 2024 — don't  panic\n\t", "<|endoftext|>a<|startoftext|> b", "ΣΊΣΥΦΟΣ İstanbul ﬁne é é", "漢字 🙂👍🏽", "a" * 5000, "ab" * 4000, "!" * 3000, "é" * 3000, LONG]


@pytest.mark.parametrize("text", TEXTS)
def test_bpe_equals_the_library(tokenizers, text):
    own, library = tokenizers
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_streams_with_bounded_memory(tokenizers):
    own, library = tokenizers
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefghilnorstu"), 30_000))
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    merges = 0
    inner = own.merge

    def spy(ids):
        nonlocal merges
        merges = max(merges, len(ids))
        return inner(ids)

    own.merge = spy
    try:
        list(own.piece(text))
    finally:
        own.merge = inner
    assert merges <= own.lookahead + 2 * bpe.BLOCK + 64


def test_sufficient_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 2
    assert bpe.sufficient_lookahead([("a", "b")]) >= 2
    chain = [("a", "b"), ("c", "a"), ("d", "c")]
    assert bpe.sufficient_lookahead(chain) >= 4


def test_byte_level_decoder_waits_for_whole_characters():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    import json

    spec = json.loads(text)
    state = bpe.Decoder.__new__(bpe.Decoder)
    vocab = spec["model"]["vocab"]
    letters = bpe.byte_letters()

    class Stub:
        decoder, special, pieces = {"type": "ByteLevel"}, {}, {i: t for t, i in vocab.items()}
        piece_bytes = [b""] * (max(vocab.values()) + 1)

    state.__init__(Stub)
    raw = "né漢🙂".encode()
    out = [state.feed([vocab[letters[b]]]) for b in raw]
    assert b"".join(out).decode() == "né漢🙂" and all(o.decode() is not None for o in out)
    assert state.feed([vocab[letters[0xE6]]]) == b"" and state.finish().decode() == "�"


def test_bpe_rows(spark, awkward, empty, tokenizers):
    own, library = tokenizers
    found = bpe.round_trip(awkward, bpe.vocabulary_text(), keep_ids=True).collect()
    assert len(found) == len(AWKWARD)
    texts = collections.defaultdict(set)
    for r in AWKWARD:
        texts[r[0]].add(r[1] or "")
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in [library.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty, bpe.vocabulary_text()).count() == 0


# --- decontamination ---

ITEM = "we saw Marie drive Carl exactly 120 km in 3 hours and then walked home with Marie along the river bank slowly"
OTHER = "we saw Anna drive Bert exactly 95 miles in 4 days and then walked home with Anna along the river bank slowly today"
MIXED = "we saw Anna drive Bert exactly 95 miles in 4 days and then walked home with Dora along the river bank slowly today"


def test_decontamination(spark, awkward, empty):
    items = spark.createDataFrame([(0, ITEM), (1, None), (2, ""), (3, "too short"), (4, "every tiny question counts here")], "item_id long, text string")
    docs = spark.createDataFrame([
        (0, f"Before it. {ITEM} And after."), (1, OTHER), (2, MIXED), (3, "nothing to see here, move along the river bank"),
        (4, None), (5, f"{ITEM} {ITEM}"), (6, "every tiny question counts here"), (None, ITEM),
    ], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert {(0, 0), (1, 0), (5, 0), (None, 0)} <= set(found) and not {k for k in found if k[0] in (3, 4)}
    assert found[0, 0]["exact"] and not found[1, 0]["exact"]
    assert (2, 0) not in found  # Anna can't stand for Marie where Dora does too
    assert (6, 4) in found and found[5, 0]["n_windows"] == found[0, 0]["item_windows"]
    shuffled = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items, broadcast_rows=0).collect()}
    assert shuffled == set(found)
    left = decontamination.clean(docs, items)
    assert {r["doc_id"] for r in left.collect()} == {2, 3, 4}
    nulls = spark.createDataFrame([(None, ITEM), (None, "clean words only"), (None, None), (7, ITEM), (7, "clean words only")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in decontamination.clean(nulls, items).collect()) == [(0, ""), (0, "clean words only"), (7, "clean words only")]
    same = decontamination.clean(awkward, items)
    assert same.columns == awkward.columns and same.count() == len(AWKWARD)
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


PROSE = "On Monday the teacher asked, Why does Paul walk to the old mill? He said that water runs down the hill, and Nobody answered for a very long while until the bell rang at last"


def test_decontamination_reports_partial_quotes(spark):
    words = PROSE.split()
    items = spark.createDataFrame([(0, PROSE)], "item_id long, text string")
    docs = spark.createDataFrame([(0, "and then " + " ".join(words[:16]) + " it went on"), (1, "so " + " ".join(words[12:25]) + " there"), (2, "so " + " ".join(words[12:24]) + " there"), (3, " ".join(words[:9]) + " x " + " ".join(words[20:29]))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(found) == {0, 1} and all(r["share"] < decontamination.SHARE for r in found.values())  # 16 and 13 words; not 12, nor twice 9


def test_decontamination_ignores_punctuation_and_case(spark):
    plain, short = re.sub(r"[^\w\s]", "", PROSE), "Which river runs past Dover castle?"
    items = spark.createDataFrame([(0, PROSE), (1, short), (2, PROSE.title())], "item_id long, text string")
    docs = spark.createDataFrame([(0, plain), (1, PROSE.title()), (2, PROSE.upper()), (3, f"they ask, {short}"), (4, f"they ask {short.lower()}"), (5, "Nothing of the kind stands in this one, as Paul said on Monday")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(d, i): 1.0 for d in range(3) for i in (0, 2)} | {(3, 1): 1.0, (4, 1): 1.0}


def test_decontamination_of_short_items_and_items_of_slots(spark):
    items = spark.createDataFrame([(0, "Tell me your age"), (1, "we met Carl in 1990 at 9 km with Dora and Emil"), (2, "Yes indeed"), (3, "so Anna, Bert, Carl, Dora, Emil, Fritz, Gerd, Hans, Ida")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "He said: tell me your AGE now"), (1, "then we met Carl in 1990 at 9 km with Dora and Emil, alas"), (2, "yes, indeed"), (3, "yes indeed it is"), (4, "so anna bert carl dora emil fritz gerd hans ida"), (5, "so Max, Otto, Paul, Rosa, Sven, Tina, Udo, Vera, Willi")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(0, 0), (1, 1), (2, 2), (4, 3)}


def test_decontamination_compiles_its_windows(spark):
    """Each window is made, hashed and joined without a lambda: through interpreted code that took most of the CPU time."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs, items = spark.createDataFrame([(0, OTHER)], "doc_id long, text string"), spark.createDataFrame([(0, ITEM)], "item_id long, text string")
        plan = decontamination.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    made = [line for line in plan.splitlines() if "Generate explode" in line or "Generate posexplode" in line]
    assert made and all(re.search(r"\*\(\d+\) Generate", line) and "lambda" not in line for line in made)


def test_decontamination_removes_punctuation_only(spark):
    """Against Unicode's categories, for what the first class of the pattern lets through and what it settles."""
    odd = [chr(c) for c in range(0x180)] + list("\u0301\u0903\u2028\u2160\u3000\u6f22\ue000\ue001\ue003\U0001d400\U0001f600")
    kept = [c for c in odd if unicodedata.category(c)[0] in "LMN" or c in " \t\n\x0b\f\r\ue000\ue003"]
    rows = spark.createDataFrame([("".join(odd),), ("".join(reversed(odd)),), ("".join(f"a{c}z" for c in odd),)], "text string")
    got = [r[0] for r in rows.select(decontamination._plain(rows["text"])).collect()]
    assert got == ["".join(kept), "".join(reversed(kept)), "".join(f"a{c}z" if c in kept else "az" for c in odd)]


QUESTIONS = [
    "the farmer {a} sold {x} apples to {b} for {y} euros and then {a} walked back to the quiet village near the lake before sunset",
    "last spring {a} drove {x} km from the harbour to visit {b} who had waited {y} hours beside the old wooden bridge in the rain",
    "after the long concert {a} counted {x} coins while {b} carried {y} kg of heavy books up the narrow stairs to the reading room",
]


def test_reparameterised_questions_equal_brute_force(spark):
    """Against string templates: an item's words with its values replaced consistently, or not."""
    rng = np.random.default_rng(9)
    names = ["Anna", "Bert", "Carla Maria", "Dora", "Emil", "Fritz Otto Hans", "Gerda Lind"]
    fill = lambda q, a, b: q.format(a=a, b=b, x=int(rng.integers(2, 900)), y=int(rng.integers(2, 900)))
    items = [(i, fill(q, "Max", "Paul Klee")) for i, q in enumerate(QUESTIONS)]
    docs, want = [], set()
    for d in range(60):
        q, (a, b) = d % 3, rng.choice(names, 2, replace=False)
        text, kind = fill(QUESTIONS[q], a, b), d % 4
        if kind == 1:
            text = fill(QUESTIONS[q], a, a)  # one name for both
        elif kind == 2:
            text = text.replace("the", "one", 1).replace("and", "or").replace("near", "at").replace("beside", "by").replace("of", "with").replace("to ", "at ").replace("in the", "on a")
        docs.append((d, f"So it goes. In short, {text}. The end, as they say."))
        if kind in (0, 3) or kind == 1 and q:  # where no value stands twice, one name for both is a renaming too
            want.add((d, q))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want - found == set() and not {(d, q) for d, q in found if d % 4 == 2}


# --- licenses ---


def brute_licenses(text, sets, threshold):
    """Every window of every template, none looked up by its words."""
    words, met = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()), []
    for label, own, size in sets:
        for i in range(max(1, len(words) - size + 1)):
            have = own & set(words[i : i + size])
            if have and len(have) >= threshold * len(own) - 1e-9:
                met.append(((len(have) / len(own), len(own), label), i, i + size, have, own))
    return {m[0][2] for m in met if not any(o[0] > m[0] and o[1] < m[2] and m[1] < o[2] and m[3] <= o[4] for o in met)}


def test_license_scan(spark, awkward, empty):
    texts = ["Released under the MIT License.", "x\nUnder THE mit-license\napache license, version\n2.0", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "This work is licensed under the GNU General Public License, version 3.", "nothing", "lots of words " * 60 + "Released under the MIT License. " + "more words " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows_of(license_scan.scan(docs))
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["base_labels"], got[0]["labels"]) == (1, 1, "mit", "mit")
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "apache-2,mit")
    assert got[2]["base_labels"] == "cc-by-nc" and got[2]["labels"] == "cc-by-nc"
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 3)
    assert got[4]["base_labels"] == "" and got[4]["labels"] == "gpl-3" and got[4]["first_word"] is None
    assert (got[5]["labels"], got[5]["score"]) == ("", 0.0) and got[6]["labels"] == "mit"
    odd = license_scan.scan(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(r["labels"] == "" for r in odd)
    assert {r["n_words"] for r in odd if r["doc_id"] in (2, 3, 5)} == {0}
    assert license_scan.scan(empty).count() == 0


@pytest.mark.parametrize(("text", "labels"), [
    ("This work is licensed under the GNU General Public\nLicense, version 2.", {"gpl-2"}),
    ("Licensed under the Apache License, Version 2.0. Licensed under CC BY-SA 4.0.", {"apache-2", "cc-by-sa"}),
    ("This work is licensed under the GNU General Public License, version 3. Copyright. All rights reserved. No part may be reproduced without permission.", {"gpl-3", "all-rights-reserved"}),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", {"lgpl-3"}),
    ("Licensed under CC BY-SA 4.0.", {"cc-by-sa"}),
    ("it is under the terms of the GNU General Public\n * License as published by the\n * Free Software Foundation; either version 2 of the License, or (at your option) any later version", {"gpl-2"}),
    ("word " * 5000 + "This is free and unencumbered software released\n\ninto the public domain. " + "word " * 5000, {"unlicense"}),
])
def test_license_notices(text, labels):
    sets = license_scan.templates()
    assert set(license_scan.scan_text(text, license_scan.Index(sets, {}))[5].split(",")) == labels
    assert len(text) > 1000 or brute_licenses(text, sets, license_scan.THRESHOLD) == labels


def test_license_join_is_exact():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    sets = [(f"t{k}", frozenset(parts := rng.choice(words, rng.integers(3, 12)).tolist()), len(parts)) for k in range(20)]
    index = license_scan.Index(sets, {w: int(rng.integers(0, 50)) for w in words}, 0.7)
    seen = set()
    for n in [0, 1, 2, *rng.integers(3, 60, 150)]:
        text = " ".join(rng.choice(words, n))
        found = set(license_scan.scan_text(text, index)[5].split(",")) - {""}
        assert found == brute_licenses(text, sets, 0.7)
        seen |= found
    assert len(seen) > 10


# --- substring dedup ---


def brute_repeats(docs, window=20):
    """For each (doc_id, text) row: words that go."""
    first, rows = {}, [(substring_dedup.NULL_ID if d is None else d, (t or "").encode().split()) for d, t in docs]
    for d, words in rows:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, words in rows:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out.append((d, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def repeated_corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    voc = [f"w{i}" for i in range(60)]
    base = rng.choice(voc, 400).tolist()
    out = []
    for d in range(n):
        at, size = int(rng.integers(0, 340)), int(rng.integers(15, 60))
        middle = base[at : at + size]
        if d % 6 == 0:
            middle = ["x"] * int(rng.integers(15, 70))
        if d % 7 == 0:
            middle = ["x", "y"] * int(rng.integers(8, 40))
        if d % 11 == 0:
            middle = middle * 3
        out.append((d, " ".join(rng.choice(voc, int(rng.integers(0, 40))).tolist() + middle + rng.choice(voc, int(rng.integers(0, 40))).tolist())))
    return out + [(n + i, out[i][1]) for i in range(20)]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_equal_windows_have_equal_marks(rounds):
    batch = substring_dedup.Batch([t.encode().split() for _, t in repeated_corpus(3)], substring_dedup.Names())
    marks, _ = batch.marks(rounds)
    seen = {}
    for start, mark in zip(batch.windows.tolist(), marks.tolist(), strict=True):
        assert seen.setdefault(batch.x[start : start + substring_dedup.WINDOW].tobytes(), mark) == mark


def test_substring_dedup(spark, empty):
    docs = repeated_corpus(4)
    docs += [(None, docs[3][1]), (500, None), (501, ""), (3, docs[3][1]), (5, docs[9][1]), (502, LONG), (503, "tail " + LONG)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((substring_dedup.NULL_ID if r[0] is None else r[0], *r[1:]) for r in substring_dedup.report(df).collect())
    assert got == brute_repeats(docs)
    assert substring_dedup.report(empty).count() == 0


def test_substring_dedup_of_many_rows_without_an_id(spark):
    """Different texts under one (null) id: no key is shared, and no text is mistaken for another."""
    base = repeated_corpus(8, 40)
    docs = [(None, t) for _, t in base] + [(None, f"{i} {base[i % 40][1]} {i}") for i in range(4000)] + [(7, t) for _, t in base] + [(7, t) for _, t in base]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted((substring_dedup.NULL_ID if r[0] is None else r[0], *r[1:]) for r in substring_dedup.report(df).collect())
    assert got == brute_repeats(docs)


def test_substring_dedup_texts(spark, awkward):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, f"One\nline.  {passage}\nFin one.", 5), (2, f"Two\n{passage}\n\nEnd  two.", 5), (3, "Three", None)]
    got = rows_of(substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")))
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "Two\nEnd  two." and got[2]["n_chars"] == len("Two\nEnd  two.") and got[3]["n_chars"] is None
    same = substring_dedup.deduplicate(awkward)
    assert same.columns == awkward.columns and same.count() == len(AWKWARD)


# --- quality ---


def test_quality(spark, awkward, empty):
    good = "the river of that and in it was with for to".split()
    rng = np.random.default_rng(0)
    made = [(i, " ".join(rng.choice(good, 40)).capitalize() + ".", 1) if i % 3 else (i, " ".join(w.upper() + "!!" for w in rng.choice(good, 40)), 0) for i in range(300)]
    docs, labels = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, quality int")
    model = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = rows_of(quality.score(docs, model))
    held = [r for r in made if r[0] % 5 == 0]
    assert np.mean([(got[i]["score"] >= quality.CUT) == bool(y) for i, _, y in held]) > 0.95
    odd = quality.score(awkward, model, "own")
    assert odd.columns == [*awkward.columns, "own"] and odd.count() == len(AWKWARD)
    assert all(0 <= r["own"] <= 1 for r in odd.collect())
    assert quality.score(empty, model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs.limit(3), nothing).collect()} == {0.5}
    one_class = quality.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in quality.score(docs.limit(3), one_class).collect()} == {1.0}


def test_every_word_has_a_vector():
    contexts = np.zeros((64, quality.DIM), np.float32)
    pooler = quality.Pooler(contexts, bound=10)  # a small table is cleared again and again
    vector = lambda t: pooler.features(t)
    assert all(np.linalg.norm(vector(w)) > 0.5 for w in ("never-seen", "漢字", "Z9!!!!!!!!!!!!", "...", LONG))
    assert not np.allclose(vector("what!!!"), vector("what!!!!")) and not vector("").any() and not vector(None).any() and not vector(" \n").any()
    assert np.allclose(vector(LONG), quality.Pooler(contexts).features(LONG), atol=1e-4)
    assert not np.allclose(vector("a b a b"), vector("a b")) and not np.allclose(vector("a b\na b"), vector("a b\nb a"))
    found = quality.index_vectors(np.arange(500, dtype=np.uint64))
    assert np.abs(found).sum(1).max() <= quality.ONES and (found.sum(1) == 0).all()


def test_quality_learns_one_text_of_a_shared_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(200)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model[0].shape == (quality.ROWS, quality.DIM) and quality.score(docs, model).count() == 201


# --- pages ---

FURNITURE = "<nav><ul><li><a href='/a'>Home</a><li>News<li>About us<li>Contact</ul></nav>"


def text_of(page):
    return html_extraction.main_text("h", html_extraction.blocks(page))


def test_blocks():
    page = f"<!DOCTYPE html><title>T</title><script>var x='</p>';</script><body>{FURNITURE}<!-- <p>no</p> --><div class='ad-box'>Buy <b>now</b></div><article><h1>A &amp; B&nbsp;c</h1><p>One\n  two<br>three<p>Four &#233;<aside>Aside</aside><form>Name</form></article><footer>&copy; 2024</footer>"
    assert text_of(page) == "A & B c\nOne two three\nFour é"
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == ""


@pytest.mark.parametrize("page", [
    "<article class='post comments-open'><p>Body</p></article>",
    "<main id='search-results'><p>Body</p></main>",
    "<article><div class='related-work'><p>Body</p></div></article>",
    "<div class='sidebar-right'><main><p>Body</p></main></div>",
    "<form><nav>Menu</nav><article><p>Body</p></article></form>",
    "<article><p>Body</p><div class='related posts'>Else</div><section id='comments'><article class='comment'>First!</article></section></article>",
    "<article><p>Body</p></article><article class='comment'>First!</article><div class='comments'><article>Second!</article></div>",
    "<div class='main-content'><p>Body</p><div class='social share-buttons'>Tell all</div></div><div>Else</div>",
])
def test_class_words_take_furniture_and_leave_the_article(page):
    assert text_of(page) == "Body"


def brute_texts(rows):
    """By definition, over (url, html): substrings and blocks on distinct pages of a host, counted one by one."""
    n, pages, out = html_extraction.MIN_TOKENS, collections.defaultdict(dict), []
    for url, page in rows:
        found = html_extraction.blocks(page)
        pages[(url or "").split("/")[2] if url else ""][tuple(found)] = [t for t, p in found if p != "article"]
    common = {}
    for host, own in pages.items():
        seen = collections.defaultdict(set)
        for k, texts in enumerate(own.values()):
            words = " ".join(texts).split(" ")
            for i in range(len(words) - n + 1):
                seen[tuple(words[i : i + n])].add(k)
            for t in texts:
                seen[t].add(k)
        common[host] = {x for x, ks in seen.items() if len(ks) >= 3 and (isinstance(x, tuple) or len(ks) >= 0.3 * len(own))}
    for url, page in rows:
        bad, found = common[(url or "").split("/")[2] if url else ""], html_extraction.blocks(page)
        words = " ".join(t for t, p in found if p != "article").split(" ")
        gone = [any(tuple(words[j : j + n]) in bad for j in range(max(0, i - n + 1), min(i, len(words) - n) + 1)) for i in range(len(words))]
        kept, at = [], 0
        for text, place in found:
            if place == "article":
                kept.append(text)
                continue
            size = len(text.split(" "))
            left = [w for w, g in zip(words[at : at + size], gone[at : at + size], strict=True) if not g]
            at += size
            if left and text not in bad:
                kept.append(" ".join(left))
        out.append("\n".join(kept))
    return out


def unmarked_pages(n=90):
    rng, out = np.random.default_rng(5), []
    voc = [f"w{i}" for i in range(300)]
    prose = lambda k: " ".join(rng.choice(voc, k))
    notice, quote = prose(40), prose(25)
    for k in range(n):
        body = f"<div>Home</div><div>Log in</div><div class='post'>{prose(50)}</div><div>Page k{k} says that at the end of the day we all agree with number x{k}</div>"
        if k % 7 == 0:
            body += f"<div>{prose(6)} {notice} {prose(5)}</div>"
        if k % 40 == 1:
            body += f"<p>{quote}"  # on two pages only, or on three of a host of ninety
        if k % 3 == 0:
            body = f"<article><p>{quote}</p><div class='related-work'>{notice if k % 2 else prose(30)}</div></article>" + body
        out.append((k, f"http://{'big' if k % 10 else 'small'}.example/{k}", body))
    return out + [(n + i, out[i][1], out[i][2]) for i in range(0, 40, 3)] + [(None, None, "<p>lonely"), (500, "http://big.example/x", None), (501, "http://big.example/y", ""), (502, "http://huge.example/", "<p>" + LONG), (0, out[0][1], out[0][2])]


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_extract_equals_brute_force_however_pages_are_dealt(spark, parts):
    rows = unmarked_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("extra")).withColumn("host", F.lit("extra"))
    got = collections.Counter(tuple(r) for r in html_extraction.extract(pages.repartition(parts)).collect())
    want = brute_texts([r[1:] for r in rows])
    assert got == collections.Counter((*r[:2], t) for r, t in zip(rows, want, strict=True))
    assert "Home" not in want[1] and "Page k1 says that at the end of the day we all agree with number x1" in want[1]
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_substrings_are_counted_by_page():
    rng = np.random.default_rng(0)
    pages = [("a" if k % 2 else "b", k, [" ".join(rng.choice(["x", "y"], 30)), "one block"]) for k in range(12)]
    seen = collections.defaultdict(set)
    for h, k, texts in pages:
        words = " ".join(texts).split(" ")
        for w in html_extraction.window_hashes(h, words).tolist():
            seen[w].add(k)
        for t in texts:
            seen[html_extraction.block_hash(h, t)].add(k)
    assert {h: set(p) for h, _, p in html_extraction.substrings(pages)} == dict(seen)
    assert html_extraction.substrings([]) == []


def brute_articles(rows):
    """By definition, over (url, html) of pages that mark articles: blocks in substrings on half of the host's distinct pages, and three, go."""
    n, pages, out = html_extraction.MIN_TOKENS, collections.defaultdict(set), []
    rows = [(url.split("/")[2], tuple(t for t, _ in html_extraction.blocks(page))) for url, page in rows]
    for host, texts in rows:
        pages[host].add(texts)
    windows = lambda words: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = collections.Counter((host, x) for host, own in pages.items() for texts in own for x in set(windows(" ".join(texts).split(" "))))
    common = {x for x, k in counts.items() if k >= 3 and k >= 0.5 * len(pages[x[0]])}
    for host, texts in rows:
        words = " ".join(texts).split(" ")
        gone, at, left = {i + j for i, w in enumerate(windows(words)) if (host, w) in common for j in range(n)}, 0, []
        for t in texts:
            size = len(t.split(" "))
            if not gone.issuperset(range(at, at + size)):
                left.append(t)
            at += size
        out.append("\n".join(left if 2 * sum(len(t.split(" ")) for t in left) > len(words) else texts))
    return out


def marked_pages(n=60):
    rng, out = np.random.default_rng(6), []
    voc = [f"w{i}" for i in range(300)]
    prose = lambda k: " ".join(rng.choice(voc, k))
    notice, halves, quote, teaser, copied = prose(30), (prose(10), prose(10)), prose(25), prose(18), [prose(30) for _ in range(4)]
    for k in range(n):
        body = f"<h1>{prose(5)}</h1><p>{prose(40)}</p><h2>Method and sources</h2><p>{prose(50)}</p>"
        if k % 3:
            body += f"<p>{notice}</p><p>Share this page</p>"
        if k % 5:
            body += f"<p>{halves[0]}<p>{halves[1]}<p>{prose(8)} {notice} {prose(3)}</p>"
        if k % 4 == 0:
            body += f"<p>{quote}</p><p>The.</p>"
        out.append((k, f"http://{'big' if k % 10 else 'small'}.example/{k}", f"<nav>Menu</nav><article>{body}</article><article class='teaser'><p>Also read {teaser}</p></article><div>Else</div>"))
    for k in range(8):
        out.append((100 + k, f"http://copies.example/{k}", "<main>" + "".join(f"<p>{t}</p>" for t in [*copied, prose(20)]) + "</main>"))
    return out + [(200 + i, out[i][1], out[i][2]) for i in [5] * 40] + [(300, "http://two.example/1", f"<main><p>{notice}<p>One"), (301, "http://two.example/2", f"<main><p>{notice}<p>Two")]


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_the_suffix_array_judges_marked_articles_too(spark, parts):
    rows = marked_pages()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter(tuple(r) for r in html_extraction.extract(pages.repartition(parts)).collect())
    want = brute_articles([r[1:] for r in rows])
    assert got == collections.Counter((*r[:2], t) for r, t in zip(rows, want, strict=True))
    lines = [t.split("\n") for t in want]
    assert not any("Share this page" in x or "Also read" in " ".join(x) for x in lines) and len(lines[1]) == 5 and len(lines[5]) == 4
    assert all("Method and sources" in x for x in lines[:60])
    assert "The." in lines[4] and all(len(x) == 5 for x in lines[60:68]) and len(lines[-1]) == 2


def test_every_repeat_has_a_sampled_suffix():
    rng = np.random.default_rng(1)
    pages = [("h", k, [" ".join(rng.choice(["x", "y"], rng.integers(1, 60)))]) for k in range(40)]
    met = {h: set(p) for h, _, p in html_extraction.samples(pages)}
    for h, k, (text,) in pages:
        grams, least = html_extraction.marks(h, words := text.split(" "))
        assert len(least) == len(html_extraction.window_hashes(h, words)) and all(k in met[m] for m in least.tolist())
    for keep in ({m for m, p in met.items() if len(p) >= 3}, set()):
        want = collections.defaultdict(set)
        for h, k, (text,) in pages:
            words = text.split(" ")
            for w, m in zip(html_extraction.window_hashes(h, words).tolist(), html_extraction.marks(h, words)[1].tolist(), strict=True):
                want[w] |= {k} if m in keep else set()
            want[html_extraction.block_hash(h, text)] |= {k} if html_extraction.block_hash(h, text) in keep else set()
        assert {h: set(p) for h, _, p in html_extraction.substrings(pages, [frozenset(keep)] * 40)} == {w: p for w, p in want.items() if p}


# --- near duplicates ---


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(values, radius):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "one", "one two", "a b c", "The THE the é É x\x0by", LONG])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 1 << 12, 300)]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 2)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 2]


@pytest.mark.parametrize("shard_rows", [1, 4096])
def test_links_and_components(spark, shard_rows):
    rng = np.random.default_rng(3)
    seeds = [int(v) for v in rng.integers(0, 1 << 63, 25)]
    values = list(seeds)
    for v in seeds:  # chains and clusters around each
        for _ in range(8):
            v ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
            values.append(v)
    values = list(dict.fromkeys([*values, 0, 1, 3, (1 << 64) - 1]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, shard_rows)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    got = collections.defaultdict(set)
    for v in signed:
        got[roots.get(v, v)].add(v)
    want = collections.defaultdict(set)
    for v, c in zip(signed, brute_components(values, 2), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates(spark, awkward, empty):
    base = " ".join(f"w{i}" for i in range(400))
    docs = [(9, base), (3, base.upper()), (5, base + " w399 w398"), (7, "something else entirely " * 3), (11, None), (12, ""), (8, base)]
    got = rows_of(simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    values = [brute_fingerprint(t) for _, t in docs]
    parts = brute_components(values, 2)
    for (d, _), c in zip(docs, parts, strict=True):
        assert got[d]["component_id"] == min(e for (e, _), x in zip(docs, parts, strict=True) if x == c)
        assert got[d]["fp"] % (1 << 64) == values[[e for e, _ in docs].index(d)]
    odd = simhash.near_duplicates(awkward)
    assert odd.count() == len(AWKWARD) and {r["component_id"] for r in odd.where("doc_id in (2, 3, 5)").collect()} == {2}
    assert simhash.near_duplicates(empty).count() == 0


def near_copies(seed=8, n=24):
    """(doc_id, text) of texts, copies with a few words changed (similarity 0.8 or more), and unrelated ones."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 300)]
        out.append((10 * k, " ".join(words)))
        for copy in (1, 2):
            changed = words.copy()
            for at in rng.choice(60, 4, replace=False) * 5:
                changed[at] = f"new{int(rng.integers(0, 10**9))}"
            out.append((10 * k + copy, " ".join(changed)))
    return out


@pytest.mark.parametrize("shard_rows", [3, 4096])
def test_similar_groups(spark, awkward, empty, shard_rows):
    docs = near_copies()
    got = rows_of(simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), shard_rows=shard_rows))
    assert {d: r["component_id"] for d, r in got.items()} == {d: d // 10 * 10 for d, _ in docs}
    if shard_rows > 3:
        odd = simhash.similar_groups(awkward)
        assert odd.count() == len(AWKWARD) and {r["component_id"] for r in odd.where("doc_id in (2, 3, 5)").collect()} == {2}
        assert simhash.similar_groups(empty).count() == 0


def test_equal_sketches_are_linked():
    def found(rows):
        batch = pa.record_batch([*(pa.array([0] * len(rows), pa.int32()) for _ in range(4)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["t", "k", "p", "q", "node", "sketch"])
        return {(a, b) for out in simhash._search_similar(50)(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}

    near, far = bytes(32), bytes([255]) * 32
    assert found([(5, near), (7, near)]) == {(7, 5)}
    links = found([(5, near), (7, near), (9, near), (11, far)])  # all three hang together, the far one doesn't
    assert links == {(7, 5), (9, 5)}


@pytest.mark.parametrize("set_rows", [2, 256])
def test_similar_groups_are_exactly_the_similar_ones(spark, set_rows):
    rng, docs = np.random.default_rng(11), []
    for k in range(60):  # pairs just over and under 0.8, and as many words repeated without end
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 300)]
        changed = words.copy()
        for at in range(6 if k % 2 else 8):  # Jaccard 266 / 326 = 0.816 or 256 / 336 = 0.762
            changed[10 + 30 * at] = f"new{k}x{at}"
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(changed))]
    docs += [(1000, "the " * 500 + docs[0][1][:200]), (1001, "the " * 500 + docs[2][1][:200])]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in docs for w in [t.split()]}
    want = {d: d // 10 * 10 if len(sets[d] & sets[d // 10 * 10]) >= 0.8 * len(sets[d] | sets[d // 10 * 10]) else d for d, _ in docs}
    assert len(set(want.values())) == 92
    got = rows_of(simhash.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), set_rows=set_rows))
    assert {d: r["component_id"] for d, r in got.items()} == want


# --- vectors ---


def test_vector_search(spark, empty):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[40:60] = x[0]  # ties
    odd = [(5001, None), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [None] + [1.0] * 23), (5005, [float("inf")] * 24), (5006, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>").withColumn("list", F.lit("extra"))
    dealt, index = vector_search.build(vector_search.clean(df))
    got = collections.defaultdict(list)
    for r in vector_search.search(dealt, index, dealt.where("vec_id % 20 = 0").select("vec_id", "embedding")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    hits, exact = 0, x.astype(np.float64)
    for q, found in got.items():
        score = exact @ exact[q]
        assert len(found) == 20 and q not in [v for v, _ in found]
        assert all(abs(score[v] - s) < 1e-9 for v, s in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
        score[q] = -np.inf
        hits += len({v for v, _ in found} & set(np.lexsort((np.arange(3000), -score))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9
    few = vector_search.build(vector_search.clean(df.where("vec_id < 5 or vec_id > 5000")))
    assert vector_search.search(*few, few[0].where("vec_id = 0").select("vec_id", "embedding")).count() == 4
    assert vector_search.build(vector_search.clean(df.limit(0))) is None


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_scan_keeps_the_nearest(spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 50)) * spread
    base = (rng.normal(size=(64, 5000)) + centres[:, rng.integers(0, 50, 5000)]).astype(np.float32)
    asked = (rng.normal(size=(30, 64)) + centres[:, rng.integers(0, 50, 30)].T).astype(np.float32)
    far = ((base.T[None] - asked[:, None]) ** 2).sum(2)
    ids, own = np.arange(5000), np.array([int(np.argmin(row)) for row in far])
    far[np.arange(30), own] = np.inf
    near = np.argsort(far, axis=1)[:, :20]
    for bounds in (np.full(30, np.inf), np.take_along_axis(far, near, 1).max(1) + 1e-2):
        q, x = vector_search.scan(base, asked, ids, own, bounds)
        found = [set(x[q == i].tolist()) for i in range(30)]
        assert sum(len(f & set(n.tolist())) for f, n in zip(found, near, strict=True)) >= 0.97 * 600
        assert len(x) < 30 * 60 and not any(o in f for o, f in zip(own.tolist(), found, strict=True))


def test_repeated_ids_do_not_crowd_out_others(spark):
    rng = np.random.default_rng(6)
    rows = [(20, [9.0, 0.0, 0.0])] + [(1, [8.0, 0.1, 0.0])] * 300 + [(2 + i, [1.0 + i / 10, *rng.normal(size=2).tolist()]) for i in range(12)]
    dealt, index = vector_search.build(vector_search.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = vector_search.search(dealt, index, dealt.where("vec_id = 20").select("vec_id", "embedding"), k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 13, 12, 11, 10] and got[0]["score"] == 72.0


def test_double_vectors_stay_double(spark):
    tiny = [(i, [1.0 + i * 1e-12, 1e-30]) for i in range(30)] + [(100, [1e150, 1e150]), (101, [1e-200, 0.0])]
    dealt, index = vector_search.build(vector_search.clean(spark.createDataFrame(tiny, "vec_id long, embedding array<double>")))
    got = vector_search.search(dealt, index, dealt.where("vec_id in (0, 101)").select("vec_id", "embedding"), k=3)
    assert [(r["query_id"], r["vec_id"]) for r in got.orderBy("query_id", "rank").collect()] == [(0, 100), (0, 29), (0, 28), (101, 100), (101, 29), (101, 28)]


# --- conversations ---


def test_paths_of_a_tree(spark):
    links = [("r", None), ("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("a11", "a1"), ("a111", "a11"), ("a1111", "a111"), ("s", None)]
    nodes = spark.createDataFrame([(n, p, n[0] if n == "s" else "r", float(len(n)), "user", n) for n, p in links], "node string, parent string, tree string, score double, role string, text string")
    found = chat_format.paths(nodes)
    paths = collections.defaultdict(list)
    for r in found.orderBy(F.desc("height")).collect():
        paths[r["leaf"]].append(r["node"])
    assert dict(paths) == {"a1111": ["r", "a", "a1", "a11", "a111", "a1111"], "a2": ["r", "a", "a2"], "b": ["r", "b"], "s": ["s"]}
    chosen = chat_format.best(found, nodes, branches=2)
    assert {(r["leaf"], r["rank"]) for r in chosen.collect()} == {("a1111", 1), ("a2", 2), ("s", 1)}
    done = chat_format.read_back(chat_format.formatted(chosen, nodes)).collect()
    assert {tuple(t["text"] for t in r["turns"]) for r in done} == {("r", "a", "a1", "a11", "a111", "a1111"), ("r", "a", "a2"), ("s",)}


def test_formatting_round_trips(spark):
    said = ["</s>[INST] ok [/INST]", "<|im_end|><|im_start|>user<|im_sep|>", "\\", "\\<|im_end|>\\\\", "", None, "a\nb $1 \\1 <\\|im_end|>", "漢🙂<s><</s>>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(None, 0, None, "x"), (None, None, "<|im_sep|>", "y"), (2, 0, "user", "same"), (2, 0, "user", "same"), (3, 0, "user", LONG * 3), (3, 1, "assistant", "[INST]" * 50_000)]
    nodes = chat_format.conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("extra"))).cache()
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.formatted(chat_format.best(chat_format.paths(nodes), nodes), nodes)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:8]]
    assert got[1]["learnt"] == "".join(t or "" for t in said[1::2])
    assert [t["text"] for t in got[3]["turns"]] == [LONG * 3, "[INST]" * 50_000] and got[3]["learnt"] == "[INST]" * 50_000
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("<|im_sep|>", "y"), ("", "x")] and len(got[2]["turns"]) == 2
    marks = re.findall(r"<\|im_(?:start|sep|end)\|>|</?s>|\[/?INST\]", got[1]["formatted"])
    assert len(marks) == 3 * 8
    nothing = nodes.limit(0)
    assert chat_format.formatted(chat_format.best(chat_format.paths(nothing), nothing), nothing).count() == 0
