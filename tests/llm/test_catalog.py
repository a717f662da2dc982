"""The registered training-data queries: against their SQL, and against brute force where there is none."""

import collections
import hashlib
import html
import os
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import catalog

from .test_operators import brute_components, brute_fingerprint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, tables, name):
    got, want = catalog.QUERIES[name](spark, DATA), tables.sql(catalog.ORACLE_SQL[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_language_id(spark, tables):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op1_language_id"](spark, DATA).collect()}
    rows = tables.sql("select doc_id, lang from documents").fetchall()
    held = [got[d]["lang_pred"] == lang for d, lang in rows if got[d]["held_out"] and lang]
    assert len(got) == len(rows) and np.mean(held) > 0.9


def test_bpe(spark, tables):
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    own = library.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in catalog.QUERIES["op2_bpe"](spark, DATA).collect()}
    for d, text in tables.sql("select doc_id, text from documents").fetchall():
        ids = own.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got[d])[1:4] == want


def test_decontamination(spark, tables):
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op3_decontamination"](spark, DATA).collect()}
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [(i, f" {plain(t)} ") for i, t in tables.sql("select item_id, text from benchmark").fetchall()]
    want = {(d, i) for d, t in tables.sql("select doc_id, text from documents").fetchall() for i, item in items if item in f" {plain(t)} "}
    assert want <= got and len(got) <= len(want) + 2


def test_quality(spark, tables):
    got = {r["doc_id"]: r for r in catalog.QUERIES["op6_quality"](spark, DATA).collect()}
    held = [got[d]["predicted"] == q for d, q in tables.sql("select doc_id, quality from labels").fetchall() if got[d]["held_out"]]
    assert np.mean(held) > 0.8 and all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_html(spark, tables):
    got = {r["page_id"]: r for r in catalog.QUERIES["op7_html_extraction"](spark, DATA).collect()}
    for page, text in tables.sql("select page_id, html from pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", text, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[page]["text"], got[page]["n_chars"]) == (want, len(want))


def test_simhash(spark, tables):
    rows = tables.sql("select doc_id, text from documents order by doc_id").fetchall()
    values = [brute_fingerprint(t) for _, t in rows]
    want = {d: (f"{v:016x}", rows[c][0]) for (d, _), v, c in zip(rows, values, brute_components(values, 2), strict=True)}
    assert {r[0]: (r[1], r[2]) for r in catalog.QUERIES["op8_simhash"](spark, DATA).collect()} == want


def test_vector_search(spark, tables):
    rows = tables.sql("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = collections.defaultdict(list)
    for r in catalog.QUERIES["op9_vector_search"](spark, DATA).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        found = sorted(got[int(ids[q])])
        assert [r for r, _, _ in found] == list(range(1, 1 + min(20, len(ids) - 1)))
        hits, total = hits + len(best & {v for _, v, _ in found}), total + len(best)
    assert hits / total >= 0.9
