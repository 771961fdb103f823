"""From raw documents to packed sequences; each stage is one of the operators in ``seasonwin.llm``.

A stage takes the session, the documents that its predecessor left, and the
folder of the tables. All but the last return documents with the columns they
came with. No rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seasonwin.llm import line_dedup, mixing, near_dedup, packing, quality
from seasonwin.llm.common import table
from seasonwin.session import pin

TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't reject."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those that have nothing else go."""
    return line_dedup.without_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_dedup.without_near_duplicates(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents of each source, some taken up to three times, as its weight asks for."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most_passes=3, share=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=2048, end=0)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", new_lines),
    ("near_dedup", distinct_documents),
    ("mixing", mixed_sources),
    ("packing", packed),
]
#: SQL can't express a trained classifier, signatures or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
