"""The corpus pipeline: documents to tokens, one operator after the other.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept, and returns the
columns of documents; the last returns each document's tokens. ``run`` writes every
stage's result as Parquet in the shared folder and reads it again.

In every stage a row is judged by its own text: rows that share a doc_id, or have none, are
rows of their own, null texts count as empty, very long texts are read whole, and extra
columns go through unchanged, whatever their names. Of an empty table an empty one is left.
Where labels or benchmark are empty, nothing is rejected for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, quality, simhash, substring_dedup
from tessera.llm.common import fold, fresh, staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled documents that came in.

    Rows with the same text get the same score, so ties and repeated rows go or stay together.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold() != 0)
    name = fresh("score", docs.columns)
    scored = quality.score(docs, quality.fit(docs, labels), name)
    return scored.where(F.col(name) >= quality.CUT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (0.8 by five-word shingles): the smallest doc_id.

    Rows without a doc_id all stay, as there is nothing to choose one by. Where rows share a
    doc_id, each goes by its own text; of rows equal in both, one stays. Empty and null texts
    are one group.
    """
    mark = fresh("text_hash", docs.columns)
    groups = simhash.similar_groups(docs)
    first = groups.where("first is not null").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias(mark)).distinct()
    kept = docs.where("doc_id is not null").withColumn(mark, F.xxhash64("text")).join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus. All rows stay, some with an empty text; null texts stay null."""
    return substring_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item. Rows of one doc_id are judged apart."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids themselves, of every row; null texts have no tokens."""
    return bpe.round_trip(docs, bpe.vocabulary_text(), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", tokenize),
]

#: A classifier, fingerprints by XXH64 and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
