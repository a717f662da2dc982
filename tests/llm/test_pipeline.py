"""The corpus pipeline, stage by stage, against brute force and on awkward rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe

from .test_operators import brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A small corpus with junk, copies, repeated passages and leaked items."""
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "the ri ver of an in wi th for be".split() for b in "to st re en ou al".split()]
    prose = lambda n: " ".join(rng.choice(words, n).tolist())
    item, passage = prose(30), prose(60)
    docs, labels = [], []
    for k in range(150):
        text, good = prose(120), 1
        if k % 6 == 0:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif k % 10 == 1:
            text = docs[k - 2][1] if k > 2 else text
        elif k % 10 == 3:
            text = f"{prose(50)} {passage} {prose(40)}"
        elif k % 25 == 4:
            text = f"{prose(50)} {item} {prose(40)}"
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, good, 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, labels, item


def test_stages(spark, made):
    path, docs, labels, item = made
    texts = {d[0]: d[1] for d in docs}
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and len(corpus_pipeline.STAGES) == 5
    quality, dedup, passages, leaks, tokens = (f for _, f in corpus_pipeline.STAGES)
    df = spark.read.parquet(f"{path}/documents.parquet")

    kept = quality(spark, df, path).cache()
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, good, _ in labels if good}

    one = dedup(spark, kept, path).cache()
    first = {}
    for r in sorted(kept.collect()):
        first.setdefault(r["text"], r["doc_id"])
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} == set(first.values())

    clean = passages(spark, one, path).cache()
    want = {d: n - gone for d, n, gone, _ in brute_repeats([(r["doc_id"], r["text"]) for r in one.collect()])}
    assert clean.columns == df.columns and {r["doc_id"]: len(r["text"].split()) for r in clean.collect()} == want

    safe = leaks(spark, clean, path).cache()
    assert safe.columns == df.columns and {r["doc_id"] for r in clean.collect()} - {r["doc_id"] for r in safe.collect()} == {r["doc_id"] for r in clean.collect() if item in r["text"]}

    last = {r["doc_id"]: r["n_tokens"] for r in tokens(spark, safe, path).collect()}
    own = bpe.Bpe(bpe.vocabulary_text())
    assert last == {r["doc_id"]: len(own.encode(r["text"])) for r in safe.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, path).collect()} == last
    assert all(texts[d] for d in last)


def test_awkward_rows_pass(spark, made):
    path = made[0]
    rows = [(None, "null id", None, None, None), (900, None, None, None, None), (901, "", "en", "a", 0), (902, "x", "en", "a", 1), (902, "x", "en", "a", 1), (903, "long " * 50_000, "en", "a", 1), (903, None, None, None, None)]
    awkward = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("extra") for c in ("score", "key", "spans", "leak", "component_id", "node")})
    sizes = collections.Counter()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, path)
        sizes[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == awkward.columns
        assert stage(spark, awkward.limit(0), path).count() == 0
    assert sizes["SimHash near-dedup"] == 4  # the null id, an empty one, x, and the long one
    assert sizes["substring dedup"] == sizes["benchmark decontamination"] == sizes["BPE encoding and decoding"] == len(rows)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    far, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, far), (2, far), (2, other), (2, other), (3, None), (3, far), (None, far)]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == collections.Counter([(1, far), (2, other), (3, None), (None, far)])
