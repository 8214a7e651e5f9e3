"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    ball_tree, bfd_output, bloom_cascade, bpe, flat_graph, line_dedup, lsh_forest, ngram_trie, nnls_pack, prefix_trie, threshold_kmeans, toxicity, warc)
from jobscope.session import scratch_path
from llm.common import read_table, remainder_of_crc
from llm.oracle import ORACLE  # noqa: F401
from llm.ship import shipped

#: The tokenizer of the token queries, and the id that ends a document in packed sequences.
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Host, path and verdict of the url rules.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def tokenizer_source(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public one's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return bpe.read_tokenizer(path)


def op1_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector id with all other vectors."""
    return ball_tree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a trigram model of the documents outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (remainder_of_crc("doc_id", 7) != 2).alias("train"))
    return ngram_trie.score(docs).withColumn("trained", ~F.col("trained")).withColumnRenamed("trained", "held_out")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labels outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where("label is not null")
    model = toxicity.fit(docs, labels.where(remainder_of_crc("doc_id", 5) != 0))
    scored = docs.select("doc_id", (remainder_of_crc("doc_id", 5) == 0).alias("held_out"), toxicity.score_column(docs, model).alias("score"))
    return scored.withColumn("predicted", F.expr("cast(if(score >= 0.5, 1, 0) as int)"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archived capture reads back: payload size and digest, record type and what it refers to."""
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.page_table(warc.records(spark, path, payloads=False))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return bpe.digest(read_table(spark, sf_dir, "documents"), tokenizer_source())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left and lines removed of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs, removed_col="n_removed")
    return out.selectExpr("doc_id", "n_removed", "sha2(cast(text as binary), 256) as text_sha256", "cast(length(text) as long) as n_chars")


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document: 3-word shingles, similarity 0.85 or more."""
    return lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=0.85, width=3)


def op8_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector: cosine 0.9 or more."""
    return flat_graph.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op9_bfd_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence as its files read back: its size, segments and a digest of its ids."""
    path = scratch_path(spark, "packed")
    bfd_output.write(bfd_output.pack(read_table(spark, sf_dir, "documents"), tokenizer_source(), END_ID), path)
    return bfd_output.read(spark, path).selectExpr(
        "sequence_id", "n_tokens", "size(docs) as n_segments", "sha2(ids, 256) as ids_sha256",
        "cu_seqlens", "position_resets", "docs as doc_ids", "starts")


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of at most 2048 tokens."""
    return nnls_pack.pack(read_table(spark, sf_dir, "documents"), tokenizer_source(), END_ID)


def url_rules(spark: SparkSession) -> DataFrame:
    """The rules of the url query: host, path, verdict."""
    return spark.createDataFrame(URL_RULES, "host string, path string, verdict string")


def op11_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides on every page's url, and its verdict; urls that no rule fits are allowed."""
    return bloom_cascade.judge(read_table(spark, sf_dir, "pages"), url_rules(spark))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_threshold_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after ten exact rounds from eight hash-chosen centroids."""
    return threshold_kmeans.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: shipped(f) for f in (
    op1_ball_tree, op2_ngram_trie, op3_toxicity, op4_warc, op5_bpe_trie, op6_line_dedup, op7_lsh_forest, op8_flat_graph, op9_bfd_output, op10_nnls_packing,
    op11_bloom_cascade, op12_prefix_trie, op13_threshold_kmeans)}
