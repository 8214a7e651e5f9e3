"""The pipeline's stages one by one, and its registration."""

from pyspark.sql import functions as F

from llm import queries
from llm_samples import DOCS, EMPTY, brute_groups

SMALL = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark, scratch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    clean = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "packing"]
    columns, kept = docs.columns, [{r.doc_id for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(f"{scratch}/{k}")
        docs = spark.read.parquet(f"{scratch}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "packing" or docs.columns == columns
        if name == "near_dedup":
            _, group = brute_groups([(r.doc_id, r.text) for r in before.collect()], 0.8, 5)
            assert kept[-1] == {i for i, g in group.items() if i == g}
    assert not (kept[0] - kept[1]) & clean and kept[0] - kept[1]
    assert kept[1] == kept[2] and kept[3] == kept[4]


def test_stages_with_odd_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(DOCS, EMPTY).withColumn("n_chars", F.length("text").cast("long")).withColumn("_score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(queries.ORACLE) <= set(names)
