"""From raw documents to sharded training text: each stage takes what its
predecessor kept, written as Parquet and read again.

1. quality: documents that the byte-level network scores below 0.7 go.
2. near_duplicates: one document of each group (similarity 0.8) stays.
3. decontamination: documents in which a benchmark item occurs go.
4. mixing: documents are taken at the sources' target weights; one row per pass.
5. sharding: 40 shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneframe.llm import decontamination, minhash, mixing, quality, queries, sharding
from tuneframe.llm.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts. It learns from the labelled
    documents outside the held-out quarter."""
    labels = queries.table(spark, sf_dir, "labels").where(~quality.held_out())
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.where(scored["score"] >= queries.QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates; of
    equal rows one. A doc_id's texts are classed each by itself: the first by hash
    goes by the doc_id, others come after every doc_id. Rows without a doc_id stay."""
    scratch = Scratch(spark, "pipeline")
    known = docs.where("doc_id IS NOT NULL").withColumn("_print", F.sha2(F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")), 256))
    prints = known.select("doc_id", "_print").distinct()
    several = prints.groupBy("doc_id").agg(F.min("_print").alias("_first"), F.max("_print").alias("_last")).where("_first < _last")
    top = docs.agg((F.max("doc_id") + 1).alias("_top"))
    more = prints.join(several, "doc_id").where("_print <> _first").crossJoin(F.broadcast(top))
    more = scratch.save(more.select("doc_id", "_print", (F.col("_top") + F.monotonically_increasing_id()).alias("_more")))
    keyed = known.join(more, ["doc_id", "_print"], "left").withColumn("_key", F.coalesce("_more", "doc_id")).drop("_print", "_more")
    kept = minhash.near_duplicates(keyed, id_column="_key", percent=80).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    kept = scratch.save(kept)
    lone = keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
    return lone.unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark item."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at weights 3, 1, 2, ...: a row holds the words that one pass over
    a document's blocks takes."""
    return mixing.Mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0).documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the mix."""
    return sharding.minimax_shards(docs, 40)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The network and the draws can't be said in SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
