"""Structured Streaming jobs (ST1-ST6).

The reference's "streaming" is lazy iteration plus state updated per batch;
here the same computations run as streaming queries:

* ST1 running moments and ST2 token counters are declarative streaming
  aggregates (partial aggregation per micro-batch, state per key);
* ST3 interval means use an event-time window with a watermark (rows later
  than the watermark are dropped);
* ST4 group advantages hold each generation group in typed keyed state until
  all ``G`` rewards arrived, or emit it flagged incomplete on an event-time
  timer (``stateful``, which also has intervals and groups with late rows,
  first rows of a prompt, and batch beside running moments);
* ST5 dataset preparation reuses the batch operators unchanged (all are
  stateless column expressions);
* ST6 keeps a bounded replay buffer: state is split over hash buckets, each
  holding at most ``capacity`` groups, and the global buffer is the best
  ``capacity`` over the union of bucket buffers (exact: the global top-N is
  contained in the union of per-bucket top-Ns).

Sinks are files on shared storage (the session's checkpoint folder), never
the driver: append-mode results go to a Parquet sink, complete-mode
aggregates are rewritten per micro-batch with ``foreachBatch``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import read_stream, scratch_path
from . import stateful

#: Keyed state with timers needs the store that keeps several columns a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---------------------------------------------------------------- runners
def _start(spark: SparkSession, writer, state_partitions: int | None):
    """Start a streaming query with its own state-partition count.

    A stream fixes its shuffle/state partition count at the first start (it is
    recorded in the checkpoint); the query clones the session at start, so the
    setting applies to this query only. Default: the cluster's parallelism."""
    n = state_partitions or spark.sparkContext.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(n), STATE_STORE[0]: STATE_STORE[1]}
    previous = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        return writer.start()
    finally:
        for key, value in previous.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def advance(stream: DataFrame, out: str, checkpoint: str, state_partitions: int | None = None):
    """Run ``stream`` over the input there is, appending to the Parquet table ``out``; a
    later call with the same checkpoint goes on. Returns the query (its progress)."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q = _start(stream.sparkSession, writer.outputMode("append").trigger(availableNow=True), state_partitions)
    q.awaitTermination()
    return q


def advance_batches(stream: DataFrame, write, checkpoint: str, state_partitions: int | None = None):
    """Like :func:`advance`, handing each micro-batch to ``write(batch, batch_id)``."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = _start(stream.sparkSession, writer, state_partitions)
    q.awaitTermination()
    return q


def run_append(stream: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """Run ``stream`` over all available input into a Parquet sink and return
    the written table as a batch DataFrame."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = _start(spark, (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append").trigger(availableNow=True)
    ), state_partitions)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, name: str, state_partitions: int | None = None) -> DataFrame:
    """Run a streaming aggregate in complete mode; every micro-batch rewrites
    the result table (idempotent per batch id), the last one is returned."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    q = _start(spark, (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
        .outputMode("complete").trigger(availableNow=True)
    ), state_partitions)
    q.awaitTermination()
    versions = spark.read.parquet(out)
    last = versions.agg(F.max("batch").alias("batch"))
    return versions.join(last, "batch").drop("batch")


def stage_files(df: DataFrame, name: str, partition_col: str) -> str:
    """Write a batch frame as several files (one folder per value of
    ``partition_col``) so a file stream replays it in micro-batches. Files are
    dealt by the value and a salt, so a hot value is written by several tasks."""
    path = scratch_path(df.sparkSession, name)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(4))
    df.repartition(n, F.col(partition_col), salt).write.partitionBy(partition_col).parquet(path)
    return path


# ---------------------------------------------------------------- ST1-ST3
def running_moments_stream(stream: DataFrame, value: str, key: str | None = None) -> DataFrame:
    """ST1: running count, mean, population variance and sample std per key."""
    g = stream.groupBy(key) if key else stream.groupBy()
    return g.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("var"),
        F.stddev_samp(value).alias("std"),
    )


def token_counter_stream(stream: DataFrame, tokens: str, key: str | None = None) -> DataFrame:
    """ST2: cumulative token count (optionally per key)."""
    g = stream.groupBy(key) if key else stream.groupBy()
    return g.agg(F.sum(F.col(tokens).cast("long")).alias("num_tokens"), F.count(F.lit(1)).alias("rows"))


def interval_means_stream(stream: DataFrame, ts: str, metric: str, value: str, interval: str, watermark: str) -> DataFrame:
    """ST3: mean of each metric per event-time interval; rows later than the
    watermark are dropped."""
    # event time must be a session-zone timestamp (NTZ columns are read as UTC wall clock)
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, interval).alias("w"), metric)
        .agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), metric, "mean", "n")
    )


# ---------------------------------------------------------------- ST4
def group_advantages_stream(stream: DataFrame, group_size: int | str, ts: str = "ts", watermark: str = "10 minutes",
                            timeout_ms: int = 600_000) -> DataFrame:
    """ST4: hold each generation group until ``group_size`` rewards arrived,
    then emit its group-relative advantages (``complete = true``); groups that
    stay incomplete past the event-time timeout are emitted with
    ``complete = false``. State per group is bounded by ``group_size``. Rows
    behind the watermark are left out; :func:`stateful.group_advantages`
    gives them as well."""
    size = group_size if isinstance(group_size, str) else F.lit(group_size)
    out = stateful.group_advantages(stream, size, ts, watermark, timeout_ms).where("kind <> 'late'")
    return out.withColumn("complete", F.col("kind") == "complete").drop("kind")


# ---------------------------------------------------------------- ST6
BUFFER_OUT = "bucket long, version long, group_id long, score double, arrival long"
BUFFER_STATE = "items string, version long"


def _buffer_fn(capacity: int):
    def fn(key, pdfs, state: GroupState):
        items = json.loads(state.get[0]) if state.exists else []
        version = (state.get[1] if state.exists else 0) + 1
        for pdf in pdfs:
            items.extend([[float(s), int(a), int(g)] for s, a, g in zip(pdf["score"], pdf["arrival"], pdf["group_id"], strict=True)])
            # keep the best: higher score first, then earlier arrival, then key
            items.sort(key=lambda x: (-x[0], x[1], x[2]))
            del items[capacity:]
        state.update((json.dumps(items), version))
        yield pd.DataFrame(
            {"bucket": int(key[0]), "version": version, "group_id": [i[2] for i in items],
             "score": [i[0] for i in items], "arrival": [i[1] for i in items]},
            columns=["bucket", "version", "group_id", "score", "arrival"],
        ).astype({"bucket": "int64", "version": "int64", "group_id": "int64", "score": "float64", "arrival": "int64"})

    return fn


def replay_buffer_stream(stream: DataFrame, capacity: int, buckets: int = 16) -> DataFrame:
    """ST6: per hash bucket, the ``capacity`` best groups seen so far (state
    bounded by ``capacity`` per bucket). Each trigger emits the new version of
    every bucket that received rows; :func:`current_buffer` folds the latest
    versions into the global buffer."""
    s = stream.select("group_id", "score", "arrival").withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    return s.groupBy("bucket").applyInPandasWithState(
        _buffer_fn(capacity), BUFFER_OUT, BUFFER_STATE, "append", GroupStateTimeout.NoTimeout
    )


def current_buffer(versions: DataFrame, capacity: int) -> DataFrame:
    """Latest version of every bucket, then the global top ``capacity``."""
    latest = versions.groupBy("bucket").agg(F.max("version").alias("version"))
    cur = versions.join(latest, ["bucket", "version"])
    return cur.orderBy(F.col("score").desc(), "arrival", "group_id").limit(capacity).select("group_id", "score", "arrival")


def stream_source(spark: SparkSession, path: str, schema, max_files: int = 4) -> DataFrame:
    """S3: the staged table as a file stream (declared schema, a few files per trigger)."""
    return read_stream(spark, path, schema, max_files_per_trigger=max_files)
