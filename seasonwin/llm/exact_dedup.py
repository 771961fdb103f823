"""Exact duplicates against a persistent digest index (operator 6).

The index is a table bucketed and sorted by the SHA-256 digest of the
normalised text, one row per distinct text: who stays, and how many rows had
it. A batch is first reduced to its distinct digests, with partial sums before
the shuffle; a sort-merge anti-join, for which the index needs no shuffle,
leaves the new ones, and these are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonwin.llm.common import lower_ascii, with_groups


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``digest``, the SHA-256 of the text with A-Z lower-cased; null texts are empty ones."""
    normal = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    digest = F.unhex(F.sha2(normal.cast("binary"), 256))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"))


class DigestIndex:
    """A saved table ``digest binary, keep_id long, group_size long`` in buckets."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            empty = spark.createDataFrame([], "digest binary, keep_id long, group_size long")
            self._save(empty)

    @classmethod
    def new(cls, spark: SparkSession, buckets: int = 64) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex}", buckets)

    def _save(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Append the digests that the index lacks; returns what the batch holds of each text.

        Of equal texts within a batch the largest id stays, and null only if
        there is no other; what the index has already stays for good, so the
        rows returned name the index's document for it.
        """
        found = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        self._save(found.repartition(self.buckets, "digest").join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        self.spark.catalog.refreshTable(self.name)
        return self.table()

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def mark_copies(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add documents to an index; one row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``group_size`` counts the rows of the batch that brought the text. Rows that
    repeat an id and its text share their answer. A null id stays only if no
    row with an id has its text. No rows give none; other columns are not read.
    """
    rows = digests(docs, doc_id, text)
    groups = index.add(rows)
    return with_groups(rows, groups, ["digest"], "group_size").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
