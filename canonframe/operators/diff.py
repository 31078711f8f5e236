"""Structural difference of two tables of documents: they meet by id, and one kernel pass compares each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.functions.documents import change_rows


def diff_tables(left: DataFrame, right: DataFrame, data: str, doc_id: str) -> DataFrame:
    """doc_id, op (~ + -), path, old, new: the topmost differences of documents with the same id, values as canonical text.

    A changed kind, or a node on one side only, is reported once, with its whole value. A document on one side only (or
    null on the other) differs at the root. Documents of equal text never leave the JVM. Rows that repeat an id are
    compared with each row of that id on the other side; a null id meets none.
    """
    a = left.select(doc_id, F.col(data).alias("__cf_left"))
    b = right.select(doc_id, F.col(data).alias("__cf_right"))
    both = a.join(b, doc_id, "full_outer").where(~F.col("__cf_left").eqNullSafe(F.col("__cf_right")))
    return both.select(doc_id, F.explode(change_rows("__cf_left", "__cf_right")).alias("x")).select(doc_id, "x.op", "x.path", "x.old", "x.new")
