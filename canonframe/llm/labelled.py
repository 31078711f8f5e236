"""Labelled documents to fit classifiers on: all labels, or bounded, deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm.common import held_out

#: Most labelled rows that a classifier is fitted on: those with the least hashes of doc_id. Documented bound.
MAX_LABELLED = 12_000


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: every label outside the held-out fold, once; rows with a null doc_id or label teach nothing."""
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out()).distinct()


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of at most `most` labelled documents outside the held-out fold; nothing else of them is kept.

    Rows with a null doc_id, text or label teach nothing; equal rows teach once. Both tables are narrowed to `most` rows by
    a hash of doc_id (and of the text, where an id has several): the bound holds after the join too, whatever repeats. The
    lists that are broadcast have at most `most` rows. Empty tables give no rows.
    """
    chosen = known(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())
    pairs = texts.select("doc_id", "h").join(F.broadcast(chosen), "doc_id").distinct()
    picked = pairs.orderBy(F.xxhash64("doc_id"), "doc_id", "h", "y").limit(most)
    return texts.join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text")).select("text", "y")
