import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    clash = docs.withColumn("n_hit", F.lit(1)).withColumn("kept", F.lit("x"))
    sizes = [n]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert n > sizes[1] > sizes[2] > 0 and sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4]
    shards = [r["n"] for r in docs.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(shards) - min(shards) <= 1
    assert corpus_pipeline.keep_good(spark, clash, SF).columns == clash.columns


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


@pytest.mark.parametrize("n", range(1, 14))
def test_each_operator_has_one_query(n):
    assert len([k for k in QUERIES if k.startswith(f"op{n}_")]) == 1


def test_folders_of_earlier_stages_are_removed(spark):
    import glob

    from tracewell.session import shared_dir

    made = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/pipeline-*"))
    old = made()
    out = corpus_pipeline.run(spark, SF)
    assert len(made() - old) == 1 and out.count() > 0


def test_stages_with_repeated_rows_and_missing_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id % 3 = 0")
    odd = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(5).withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        odd = spark.createDataFrame(out.toArrow())
        assert odd.count() > 0, name
    assert odd.agg(F.count("shard")).head()[0] == odd.count()
