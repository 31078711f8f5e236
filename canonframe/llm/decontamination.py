"""Size-partitioned MinHash containment search of short test items inside long documents.

Items are partitioned by size (number of distinct shingles, powers of two). An item's sketch holds its k smallest shingle
hashes, with k set by its partition: an item of n shingles of which 75 in 100 lie in a document misses at most n / 4 of
them, so one more than that of any kind must hit. A plain signature of a whole document would drown an item in a long
text (their Jaccard similarity is near 0), so the document's side is not sketched: all its shingles probe the sketches.
The search thus has no false negatives; hits are then verified by exact containment of the shingles' texts.

Only DataFrame expressions; the items' side is broadcast when a count shows it to be small and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canonframe.llm.common import body, cut, flagged, free, row_key, table
from canonframe.llm.words import PERCENT, SHINGLE, shingle_hashes, shingles, words

#: Shingles of all items up to which their table is broadcast.
MAX_BROADCAST_SHINGLES = 400_000
#: Tasks that each shingle of a larger item table is dealt to: a shingle that all documents hold is no hot key.
SALTS = 16


def item_shingles(items: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item_id, shingle, hash, n: the distinct shingles of each item (items with null or empty text have none).

    Rows of one item_id with different texts are one item with the shingles of all.
    """
    w = words()
    parts = items.select("item_id", w.alias("w")).select("item_id", F.explode(shingles(F.col("w"), k)).alias("shingle")).distinct()
    hashed = F.transform(F.split("shingle", " "), lambda x: F.xxhash64(x))
    return parts.select("item_id", "shingle", shingle_hashes(hashed, k)[0].alias("hash"), F.count("*").over(Window.partitionBy("item_id")).alias("n"))


def sketches(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, hash: the k smallest hashes of each item, k by the upper size of its partition."""
    upper = F.pow(2, F.floor(F.log2(F.col("n"))) + 1).cast("long") - 1
    k = upper - F.ceil(upper * percent / 100) + 1
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("hash", "shingle"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "hash")


def contained(docs: DataFrame, items: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Pairs of documents and items of whose distinct shingles at least `percent` in 100 lie in the document.

    An item of fewer than k words has one shingle, all its words, as has a document of fewer than k: they meet only where
    the document is these words and no more. Inside a longer document such an item is not found.

    Returns __cf_key (row_key of the document), doc_id, item_id, n_shingles, n_found. Equal document rows give one pair;
    null and empty texts and items, and items without an id, give none; empty tables give no rows; other columns are not read.
    """
    parts = cut(item_shingles(items, k))
    small = parts.count() <= MAX_BROADCAST_SHINGLES
    probe = sketches(parts, percent)
    base = docs.select(row_key().alias("__cf_key"), F.transform(words(), lambda x: F.xxhash64(x)).alias("wh"))
    probes = base.select("__cf_key", F.explode(shingle_hashes(F.col("wh"), k)).alias("hash"))
    found = cut(_met(probes, probe, "hash", small).select("__cf_key", "item_id").distinct())
    keys = found.select("__cf_key").distinct()
    # texts that were not hit cross no shuffle, but for the few that a filter of hashes takes for others
    near = flagged(docs.select(row_key().alias("__cf_key"), "doc_id", body().alias("text")), "__cf_key", keys, found.count(), "__cf_may").where("__cf_may")
    texts = near.join(keys, "__cf_key", "left_semi")
    texts = texts.select("__cf_key", "doc_id", words().alias("w"))  # once a document, not once a shingle
    # one row for each distinct shingle of a document that was hit, matched with all shingles of the items it may hold
    runs = texts.select("__cf_key", "doc_id", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("shingle"))
    hits = _met(runs, parts, "shingle", small).groupBy("__cf_key", "doc_id", "item_id").agg(F.countDistinct("shingle").alias("n_found"), F.first("n").alias("n_shingles"))
    return (
        hits.join(found, ["__cf_key", "item_id"], "left_semi")
        .where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
        .select("__cf_key", "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"))
    )


def _met(rows: DataFrame, held: DataFrame, on: str, small: bool) -> DataFrame:
    """rows joined with the items' side: broadcast if it is small, else with each of its keys dealt to SALTS tasks."""
    if small:
        return rows.join(F.broadcast(held), on)
    dealt = held.withColumn("__cf_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__cf_salt", F.pmod("__cf_key", F.lit(SALTS)).cast("int")).join(dealt, [on, "__cf_salt"]).drop("__cf_salt")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item as contained() finds them, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows go or stay together; without items all rows stay; an empty table gives none;
    texts of any length are searched whole. Rows that surely stay cross no shuffle.
    """
    bad = cut(contained(docs, items).select("__cf_key").distinct())
    key, may = free(docs, "__cf_key"), free(docs, "__cf_may")
    bad = bad.withColumnRenamed("__cf_key", key)
    marked = flagged(docs.withColumn(key, row_key()), key, bad, bad.count(), may)
    again = marked.where(may).join(bad, key, "left_anti").select(*marked.columns)
    return marked.where(~F.col(may)).unionByName(again).drop(key, may)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found")


_SHINGLES = """
    SELECT DISTINCT {id}, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
    FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM (SELECT {id}, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
                'abcdefghijklmnopqrstuvwxyz' || '     '), ' '), lambda x: x <> '') AS w FROM {table})
          WHERE len(w) > 0)"""
SHINGLES_SQL = _SHINGLES
ORACLE_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 100 >= n_shingles * 75
"""
