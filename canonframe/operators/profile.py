"""Relational uses of the canonical form: duplicates, hash profiles, issue rows and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonframe.functions.documents import content_hash


def with_hash(df: DataFrame, data: str, name: str = "canon_sha256", **options) -> DataFrame:
    return df.withColumn(name, content_hash(data, **options))


def deduplicate(df: DataFrame, data: str, order: str, **options) -> DataFrame:
    """A row for each distinct canonical content: its hash, the least `order`, and how many rows have it."""
    return with_hash(df.select(order, data), data, **options).groupBy("canon_sha256").agg(F.min(order).alias(f"first_{order}"), F.count("*").alias("n"))


def issue_rows(df: DataFrame, issues: Column, *ids: str) -> DataFrame:
    """One row per issue, in report order: ids, seq, loc, category, message."""
    return df.select(*ids, F.posexplode(issues).alias("seq", "issue")).select(*ids, "seq", "issue.loc", "issue.category", "issue.message")


def issue_counts(df: DataFrame, issues: Column) -> DataFrame:
    return df.select(F.explode(issues).alias("issue")).groupBy(F.col("issue.category").alias("category")).agg(F.count("*").alias("n"))
