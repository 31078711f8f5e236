"""Files of documents as DataFrames, and canonical output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonframe.functions.documents import json_values, lint
from canonframe.functions.strings import decode_bytes
from canonframe.operators.profile import issue_rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, as bytes (any encoding, CBOR, MessagePack): path, data."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One document per line of UTF-8 files; blank lines are no documents: data."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("data"))


def read_json_seq(spark: SparkSession, path: str) -> DataFrame:
    """All values of files of value streams, in file order: path, value_index, canon."""
    docs = read_documents(spark, path).select("path", decode_bytes("data").alias("text"))
    return docs.select("path", F.posexplode(json_values("text")).alias("value_index", "canon"))


def write_text(df: DataFrame, canon: str, path: str, mode: str = "errorifexists") -> None:
    """One canonical document per line."""
    df.select(F.col(canon).alias("value")).write.mode(mode).text(path)


def write_with_report(df: DataFrame, canon: str, issues: Column, ids: list[str], path: str, mode: str = "errorifexists") -> None:
    """Documents and, always beside them, their issue rows: path/documents and path/issues (Parquet)."""
    df.select(*ids, canon).write.mode(mode).parquet(f"{path}/documents")
    issue_rows(df, issues, *ids).write.mode(mode).parquet(f"{path}/issues")


def lint_report(df: DataFrame, data: str, *ids: str) -> DataFrame:
    return issue_rows(df, lint(data), *ids)


def join_lines(df: DataFrame, group: str, index: str, canon: str) -> DataFrame:
    """One text per group again: its canonical records in order, joined by LF without one at the end."""
    return df.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, canon))), lambda s: s[canon]), "\n").alias("text"))
