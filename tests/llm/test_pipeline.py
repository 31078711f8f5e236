"""The pipeline's stages on a small corpus: each keeps clean documents and their columns, and its decisions take effect."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm import helpers as H  # noqa: E402
from tests.llm.test_operators import brute_components, labelled  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark)
    docs = docs.unionByName(H.frame(spark, [(10_000 + i, t) for i, (_, t) in enumerate(H.corpus())]))
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows
    docs = docs.withColumn("__cf_key", F.col("doc_id")).withColumn("__cf_lines", F.lit("own"))
    docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    item = next(t for _, t in H.corpus() if t and len(t.split()) > 100)
    spark.createDataFrame([(0, item[:400])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns and 0 < after.count() <= before.count()
        if name == "toxicity":
            assert after.where("doc_id is null or text is null").count() == before.where("doc_id is null or text is null").count()
        if name == "line_dedup":
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert after.count() == len(brute_components(rows)[1])
        if name == "decontamination":
            assert after.count() < before.count()
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert packed.where("start = 0").count() == before.count()


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and os.path.exists(corpus_pipeline.__file__)
