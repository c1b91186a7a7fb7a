"""The queries of this subpackage: ``opN_<name>`` applies operator N with its
production parameters to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, decontamination, licenses, line_templates, minhash, mixing, ngram_filter, prefix_trie, quality, sharding, substrings, tokens
from .scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document after repeated windows of 35 words go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.attach(docs, substrings.clean_texts(docs, window=35, digest=True))
    empty = F.sha2(F.lit(""), 256)
    return out.select("doc_id", "n_words", "n_removed", F.coalesce("kept", empty).alias("kept_sha256"))


@query
def op7_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; equal texts share a shard."""
    out = sharding.minimax_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed at weights 3, 1, 2, ... to 150 % of their words."""
    return mixing.Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, cap=2.0).taken()


QUALITY_THRESHOLD = 0.7


def quality_network(spark: SparkSession, sf_dir: str):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.fit(docs, labels.where(~quality.held_out()))


@query
def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document; a quarter of the ids is never learned from."""
    scored = quality.score(table(spark, sf_dir, "documents"), quality_network(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(quality.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark items in all documents, up to 5 % edits."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_adaptive_dimension_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for each vec_id divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose template recurs in 8 or more."""
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op6_line_templates"] = line_templates.ORACLE


@query
def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after three batches: every document is
    inserted; those with white space to tidy are counted again; those labelled
    toxic are deleted. The first batch is sent twice."""
    scratch = Scratch(spark, "token-rollup")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ids = ["doc_id", "source", "lang"]
    counted = scratch.save(tokens.count_tokens(docs, keep=ids))
    untidy = docs.where(F.col("text").rlike("^\\s|\\s\\s|\\s$"))
    tidied = scratch.save(tokens.count_tokens(untidy.withColumn("text", F.btrim(F.regexp_replace("text", "\\s+", " "))), keep=ids))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    before = counted.join(tidied.select("doc_id").distinct(), "doc_id", "left_semi")
    now = counted.join(tidied.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(tidied)
    rollup = tokens.Rollup(spark, f"{scratch.root}/totals")
    rollup.apply("load", tokens.inserted(counted))
    rollup.apply("tidy", tokens.revised(before, tidied))
    rollup.apply("moderate", tokens.deleted(now.join(toxic, "doc_id", "left_semi")))
    rollup.apply("load", tokens.inserted(counted))
    return rollup.totals()


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents, with their differences in wording."""
    return licenses.license_notices(table(spark, sf_dir, "documents"))


@query
def op13_hadamard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after three rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


ORACLES["op13_hadamard_clustering"] = centroids.ORACLE


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared beginnings of all conversations, each rebuilt with its base's first turns."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("words", "name")


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE


@query
def op11_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ngram_filter.score(docs, ~ngram_filter.held_out()).withColumn("held_out", ngram_filter.held_out())
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
