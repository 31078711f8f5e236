"""The registered queries on the smallest tables: contract columns and types, and SQL where there is some."""

import os

import pytest

from canonframe.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, text string",
    "op2_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op6_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_decontamination": "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint",
}
PER_DOCUMENT = {k for k in COLUMNS if k not in ("op7_packing", "op10_decontamination")}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, DATA).cache()
    types = dict(df.dtypes)
    for c in COLUMNS[name].split(", "):
        column, kind = c.split(" ")
        assert types[column] == kind, column
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in PER_DOCUMENT:
        assert df.count() == n and df.select("doc_id").distinct().count() == n
    if name in queries.ORACLE:
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.sql(queries.ORACLE[name])
        cols = sorted(want.columns)
        assert sorted(df.columns) == cols
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.select(*[f'"{x}"' for x in cols]).fetchall())
