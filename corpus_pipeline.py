"""A training corpus from ``documents``: quality, near-duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage handles nulls, empty texts, repeated rows and further columns as its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisleflow.llm import bpe, cotrain, mix, near_dup, pii
from aisleflow.llm.storage import documents, importable, materialize, word_count


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars following a changed text."""
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good."""
    importable(spark)
    return cotrain.classify(docs, documents(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8 on (op6 has its
    own contract of 0.85); rows without an id all stay."""
    importable(spark)
    kept = near_dup.near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced."""
    return _like(pii.replace_pii(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time they are taken."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    return _like(mix.repeat_taken(mix.mix_sources(sized, size="_size"), size="_size"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every row."""
    importable(spark)
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=100_000)  # beside what earlier stages left in memory
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("PII", surrogates),
    ("mixing sources", mixture),
    ("byte-level BPE", tokens),
]

#: Sketches, trained weights and merges have no SQL; the tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
