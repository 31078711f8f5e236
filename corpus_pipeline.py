"""A training-data pipeline over `documents`: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. For all stages: documents without text (null, empty) have nothing that a stage could
reject, and stay until they are packed as an end id each; texts of any length are read whole; repeated rows are treated
alike, and stay, but where a stage says otherwise; ties go by doc_id, then by a hash of the row; an empty table gives no
rows; further columns of documents, whatever their names, pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonframe.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from canonframe.llm.common import free, removed, staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, learned from labels outside the held-out fold, scores at 0.5 or more go.

    Null and empty texts stay; repeated rows go or stay together. Without labels (or with labels of one kind) nothing goes.
    """
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates and copies of lines go, but for the first; a document of which nothing is left goes.

    n_chars, where there is such a column, is counted again for the documents that lose lines. A document that was empty or
    white before stays as it is.
    """
    names = docs.columns
    lines, dropped = free(docs, "__cf_lines"), free(docs, "__cf_dropped")
    out = line_dedup.whole(docs, (lines, dropped))
    emptied = (F.col(dropped) > 0) & F.col("text").rlike(r"\A\s*\z")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in names])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by Jaccard similarity of 0.75 or more stays: that of least doc_id.

    Of repeated rows one stays. Documents without words have no set and all stay.
    """
    return jaccard_join.one_of_each(docs).select(*[f"`{c}`" for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.75 or more of a benchmark item's shingles go; without benchmark items all stay."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences of 2048 tokens; repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned lexicon, the template tree or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted when the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), name)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
