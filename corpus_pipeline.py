"""A training corpus from raw documents, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamscore.llm import bpe
from streamscore.llm.minhash import distinct_documents
from streamscore.llm.mixing import mixed_documents
from streamscore.llm.quality import passing_documents
from streamscore.llm.suffix_dedup import without_repeats
from streamscore.session import prepare
from streamscore.sources.storage import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers.

    Null and empty texts fail the rules; repeated rows are judged alike. Columns stay as they are,
    and an empty table gives an empty one, here and in all stages but the last.
    """
    prepare(spark)
    return passing_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words.

    Texts without words are nobody's copy. Rows are told apart by id and text, so a null or shared id
    does not drag other texts along.
    """
    prepare(spark)
    return distinct_documents(docs, words=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur more than once.

    A null text becomes empty, and a document that loses all of its text stays with an empty one.
    """
    prepare(spark)
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A document taken twice gives two rows; the one that crosses a source's target gives its first
    words. A null source is a source. Texts without words come as often as whole epochs of their
    source do, and not at all if it has none.
    """
    prepare(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each document, with digests of the ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows give a row each.
    """
    prepare(spark)
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded.drop("text"), path)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing", mixing),
    ("BPE encoding", tokens),
]

# Robust estimates, suffix arrays and merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{number}")
    return docs
