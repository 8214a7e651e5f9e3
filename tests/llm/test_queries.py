"""The registered queries themselves: against their SQL, or from their files back to the texts."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle_check
from conftest import SF_SMALL
from llm import bfd_output, bpe, queries
from llm.oracle import ORACLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="needs the test tables")


@pytest.mark.parametrize("name", ["op1_ball_tree", "op4_warc", "op6_line_dedup", "op7_lsh_forest", "op8_flat_graph"])
def test_query_equals_its_sql(spark, name):
    got = oracle_check.compare(spark, oracle_check.duck(SF_SMALL), name, queries.QUERIES[name], ORACLE[name], SF_SMALL)
    assert got["ok"], got


def test_packed_files_read_back_to_the_encoded_documents(spark, scratch):
    docs, source = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), queries.tokenizer_source()
    bfd_output.write(bfd_output.pack(docs, source, 1), scratch)
    stored = bfd_output.read(spark, scratch)
    pieces = {}
    for r in bfd_output.segments(stored).orderBy("doc", "start").collect():
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length and r.start == len(pieces.setdefault(r.doc, []))
        pieces[r.doc] += ids
    want = {r.doc_id: [*r.token_ids, 1] for r in bpe.encode(docs, source).collect()}
    assert pieces == want
    rows = queries.QUERIES["op9_bfd_output"](spark, SF_SMALL).collect()
    assert sorted(r.ids_sha256 for r in rows) == sorted(hashlib.sha256(r.ids).hexdigest() for r in stored.select("ids").collect())
    assert sum(r.n_tokens for r in rows) == sum(map(len, want.values()))


def test_pipeline_packs_every_token_of_what_its_stages_keep(spark):
    docs = kept = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_SMALL)
        assert kept.columns == docs.columns
    want = {r.doc_id: len(r.token_ids) + 1 for r in bpe.encode(kept, queries.tokenizer_source()).collect()}
    got = corpus_pipeline.run(spark, SF_SMALL).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id: r.n for r in got} == {r.doc_id: r.m for r in got} == want
