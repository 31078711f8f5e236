"""Gapless ranks inside groups of any size, without putting a group, or the copies of one row, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 50_000


def chunk_of(key: Column, n_rows: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> Column:
    """A chunk number from a hash of key; the number of chunks follows the rows, so a chunk stays small."""
    return F.pmod(F.xxhash64(key, F.lit(0x5EED)), F.lit(max(1, -(-n_rows // rows_per_chunk)))).cast("long")


def ranked(rows: DataFrame, group: str, n_rows: int, out: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """rows with `out`: ranks from 0 without gaps in each value of `group`, the same whatever the partitions.

    Equal rows are counted first, so a row that repeats any number of times is one row of its chunk; a chunk is a share of
    a group by a hash of all columns, so null or repeated ids do not meet in one task either.
    """
    names = rows.columns
    each = rows.groupBy(*names).agg(F.count("*").alias("__times")).withColumn("__chunk", chunk_of(F.struct(*names), n_rows, rows_per_chunk))
    counts = each.groupBy(group, "__chunk").agg(F.sum("__times").alias("__n"))
    before = Window.partitionBy(group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__chunk").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("__before", F.coalesce(F.sum("__times").over(inside), F.lit(0))).join(starts, [group, "__chunk"])
    first = F.col("__start") + F.col("__before")
    return placed.withColumn(out, F.explode(F.sequence(first.cast("long"), (first + F.col("__times") - 1).cast("long")))).select(*names, out)
