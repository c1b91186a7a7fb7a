"""Keyed streaming state with event-time timers (ST1, ST3, ST4, S9).

Each job is one ``transformWithStateInPandas`` operator with typed list and value state.
The event time reaches it as a plain column, so rows behind the watermark are not dropped
unseen: the operator compares them with the watermark of their micro-batch and gives them
out as rows of kind ``late``. What an interval or group gives out is decided by the
watermark alone, hence a restart changes nothing.

* intervals (ST3): running (n, mean) for each (metric, interval, salt), closed by a timer
  at the interval's end. The salt spreads a metric with a third of all rows over tasks;
  :func:`closed_intervals` merges the parts.
* groups (ST4): the samples of a group until all are there, or until ``timeout`` after the
  newest sample has passed.
* first rows (S9): the first row of each key; the key is forgotten ``horizon`` after its
  last occurrence.

Groups and prompts are many and small, so a call to the state for each of them would be
the whole run time. They go to a fixed number of hash buckets: a bucket's open entries are
one state value (a compressed Arrow table), read and written once a micro-batch, with one
timer for the earliest of their deadlines.

A row whose ``heartbeat`` column is true moves the watermark and nothing else: a source
that falls silent sends one to close what is open."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.readers import scratch_path

EPS_STD = 1e-4
#: Stands for a null number in a key: pandas would turn the numbers beside it into floats.
NO_TIME = -(1 << 62)
#: Hash buckets of groups or prompts; a task holds the open entries of one at a time. Fixed for a checkpoint's life.
BUCKETS = 256


def _with_time(stream: DataFrame, ts: str, watermark: str, heartbeat: str | None) -> DataFrame:
    """Adds ``event_ms`` (event time in ms, null without one) and ``is_beat`` behind a watermark.
    ``event_ms`` is computed, so Spark doesn't filter by it."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    beat = F.coalesce(F.col(heartbeat), F.lit(False)) if heartbeat else F.lit(False)
    return s.withColumn("event_ms", F.unix_millis("_ts") + F.lit(0)).withColumn("is_beat", beat).drop("_ts")


# ---------------------------------------------------------------- ST3
INTERVALS = "kind string, window_start timestamp, metric string, n long, n_values long, mean double, ts timestamp, value double"


class _Intervals(StatefulProcessor):
    def __init__(self, interval_ms: int):
        self.interval_ms = interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, n_values long, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        key = self._key(key)
        end = None if key[1] is None else key[1] + self.interval_ms
        late = end is None or end <= timerValues.getCurrentWatermarkInMs()
        had = self.total.exists()
        n, n_values, mean = self.total.get() if had else (0, 0, 0.0)
        touched = False
        for pdf in rows:
            pdf = pdf[~pdf["is_beat"].astype(bool)]
            if not len(pdf):
                continue
            values = pdf["value"].astype("float64")
            if late:
                yield self._rows("late", key, ts=pd.to_datetime(pdf["event_ms"], unit="ms", utc=True).dt.tz_localize(None), value=values)
                continue
            touched, n = True, n + len(pdf)
            there = values.dropna()
            if len(there):
                n_values += len(there)
                mean += (there.mean() - mean) * len(there) / n_values
        if touched:
            self.total.update((n, n_values, float(mean)))
            if not had:
                # fires once the watermark has reached the end
                self.handle.registerTimer(end - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, n_values, mean = self.total.get()
        self.total.clear()
        yield self._rows("mean", self._key(key), n=[n], n_values=[n_values], mean=[mean if n_values else None])

    @staticmethod
    def _key(key) -> tuple:
        """(metric, start), start null for rows without event time."""
        return key[0], None if key[1] == NO_TIME else int(key[1])

    @staticmethod
    def _rows(kind, key, n=None, n_values=None, mean=None, ts=None, value=None) -> pd.DataFrame:
        size = len(n) if ts is None else len(ts)
        at = pd.NaT if key[1] is None else pd.Timestamp(key[1], unit="ms")
        return pd.DataFrame({
            "kind": kind, "window_start": pd.Series([at] * size, dtype="datetime64[ns]"), "metric": pd.Series([key[0]] * size, dtype="object"),
            "n": pd.Series(n if n is not None else [1] * size, dtype="int64"), "n_values": pd.Series(n_values if n_values is not None else [0] * size, dtype="int64"),
            "mean": pd.Series(mean if mean is not None else [None] * size, dtype="float64"),
            "ts": pd.Series([pd.NaT] * size if ts is None else list(ts), dtype="datetime64[ns]"),
            "value": pd.Series([None] * size if value is None else list(value), dtype="float64")})

    def close(self) -> None:
        pass


def interval_means(stream: DataFrame, ts: str, metric: str, value: str, interval_ms: int, watermark: str, *,
                   salts: int = 16, heartbeat: str | None = None) -> DataFrame:
    """ST3: rows of kind ``mean`` (a closed interval's part: n, n_values, mean) and ``late``
    (ts, value of a row whose interval was closed, or that has no event time). Intervals
    start at multiples of ``interval_ms`` since the epoch."""
    s = _with_time(stream, ts, watermark, heartbeat)
    start = (F.floor(F.col("event_ms") / F.lit(interval_ms)) * F.lit(interval_ms)).cast("long")
    s = s.select(F.col(metric).cast("string").alias("metric"), F.coalesce(start, F.lit(NO_TIME)).alias("start"), F.pmod(F.xxhash64("event_ms", value), F.lit(salts)).alias("salt"),
                 F.col(value).cast("double").alias("value"), "event_ms", "is_beat")
    return s.groupBy("metric", "start", "salt").transformWithStateInPandas(_Intervals(interval_ms), INTERVALS, "append", "eventTime")


def closed_intervals(out: DataFrame) -> DataFrame:
    """(window_start, metric, n, mean) of the closed intervals in the output table."""
    parts = out.where("kind = 'mean'").groupBy("window_start", "metric")
    g = parts.agg(F.sum("n").alias("n"), F.sum("n_values").alias("_n"), F.sum(F.col("mean") * F.col("n_values")).alias("_s"))
    return g.select("window_start", "metric", "n", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("mean"))


def late_rows(out: DataFrame) -> DataFrame:
    """The side table: (window_start, metric, ts, value) of rows behind the watermark."""
    return out.where("kind = 'late'").select("window_start", "metric", "ts", "value")


# ---------------------------------------------------------------- buckets of keys
class _Bucket(StatefulProcessor):
    """The open entries of a bucket's keys as one table; a key's rows share a ``due`` time, and
    ``expire`` gets those whose time the watermark has reached."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entries binary, due long")

    def load(self) -> tuple[pd.DataFrame | None, int | None]:
        """(open entries, time of the timer)"""
        if not self.held.exists():
            return None, None
        entries, due = self.held.get()
        return pa.ipc.open_stream(bytes(entries)).read_all().to_pandas(), due

    def store(self, entries: pd.DataFrame, before: int | None) -> None:
        due = int(entries["due"].min()) if len(entries) else None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before - 1)
            if due is not None:
                # fires once the watermark has reached the time
                self.handle.registerTimer(due - 1)
        if due is None:
            self.held.clear()
            return
        table, sink = pa.Table.from_pandas(entries, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.held.update((sink.getvalue().to_pybytes(), due))

    def expire(self, entries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        entries, before = self.load()
        if entries is None:
            return
        due = entries["due"] <= timerValues.getCurrentWatermarkInMs()
        if due.any():
            self.store(entries[~due], before)
            yield from self.expire(entries[due])

    def close(self) -> None:
        pass


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


# ---------------------------------------------------------------- ST4
GROUPS = "group_id long, sample_no long, reward double, advantage double, kind string"


class _Groups(_Bucket):
    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        new = []
        for pdf in rows:
            pdf = pdf[~pdf["is_beat"].astype(bool)]
            late = pdf["event_ms"].isna() | (pdf["event_ms"] < now)
            if late.any():
                yield self._rows(pdf[late], "late")
            pdf = pdf[~late]
            if len(pdf):
                whole = {c: pdf[c].astype("int64") for c in ("group_id", "sample_no", "group_size")}
                new.append(pd.DataFrame({**whole, "reward": pdf["reward"].astype("float64"), "due": pdf["event_ms"].astype("int64") + self.timeout_ms}))
        if not new:
            return
        entries, before = self.load()
        entries = pd.concat(([] if entries is None else [entries]) + new, ignore_index=True)
        of = entries.groupby("group_id", sort=False)
        entries["due"], entries["group_size"] = of["due"].transform("max"), of["group_size"].transform("max")
        complete = of["group_id"].transform("size") >= entries["group_size"]
        # rows come before time-outs: a group with a new sample is not due
        due = ~complete & (entries["due"] <= now)
        self.store(entries[~complete & ~due], before)
        if complete.any():
            yield self._scored(entries[complete], "complete")
        if due.any():
            yield self._scored(entries[due], "timed_out")

    def expire(self, entries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield self._scored(entries, "timed_out")

    @classmethod
    def _scored(cls, entries: pd.DataFrame, kind: str) -> pd.DataFrame:
        entries = entries.sort_values("group_id", kind="stable")
        _, first, size = np.unique(entries["group_id"].to_numpy(), return_index=True, return_counts=True)
        reward = entries["reward"].to_numpy()
        gap = reward - np.repeat(np.add.reduceat(reward, first) / size, size)
        with np.errstate(invalid="ignore", divide="ignore"):  # a group of one has no deviation
            std = np.sqrt(np.add.reduceat(gap * gap, first) / (size - 1))
        return cls._rows(entries, kind, gap / (np.repeat(std, size) + EPS_STD))

    @staticmethod
    def _rows(entries: pd.DataFrame, kind: str, advantage=None) -> pd.DataFrame:
        out = pd.DataFrame({"group_id": entries["group_id"].astype("int64"), "sample_no": entries["sample_no"].astype("int64"), "reward": entries["reward"].astype("float64")})
        out["advantage"] = np.nan if advantage is None else advantage
        out["kind"] = kind
        return out


def group_advantages(stream: DataFrame, group_size: Column | str, ts: str, watermark: str, timeout_ms: int, *,
                     heartbeat: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """ST4: every sample once, with the advantage within its group: of kind ``complete``
    (all ``group_size`` samples arrived), ``timed_out`` (those there when ``timeout_ms``
    after the newest of them had passed) or ``late`` (behind the watermark, or without event
    time: no advantage). A group of one has no advantage."""
    size = F.col(group_size) if isinstance(group_size, str) else group_size
    s = _with_time(stream, ts, watermark, heartbeat)
    s = s.select(_bucket("group_id", buckets), F.col("group_id").cast("long").alias("group_id"), F.col("sample_no").cast("long").alias("sample_no"), F.col("reward").cast("double").alias("reward"),
                 size.cast("long").alias("group_size"), "event_ms", "is_beat").where("group_id IS NOT NULL")
    out = s.groupBy("bucket").transformWithStateInPandas(_Groups(timeout_ms), GROUPS, "append", "eventTime")
    return out.withColumn("advantage", F.nanvl("advantage", F.lit(None).cast("double")))


# ---------------------------------------------------------------- S9
class _First(_Bucket):
    def __init__(self, horizon_ms: int, columns: list[str], order: list[str]):
        self.horizon_ms, self.columns, self.order = horizon_ms, columns, order

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        entries, before = self.load()
        known = pd.Index([] if entries is None else entries["prompt_key"], dtype="object")
        first, seen = None, []
        for pdf in rows:
            pdf = pdf[~pdf["is_beat"].astype(bool) & (pdf["event_ms"].isna() | (pdf["event_ms"] >= now))]
            if not len(pdf):
                continue
            pdf = pdf.assign(prompt_key=pdf["prompt_key"].fillna(""))  # of a null prompt
            newest = pdf["event_ms"].astype("float64").fillna(now).groupby(pdf["prompt_key"]).max()
            seen.append(pd.DataFrame({"prompt_key": newest.index, "due": newest.to_numpy().astype("int64") + self.horizon_ms}))
            best = pdf[~pdf["prompt_key"].isin(known)]
            first = self._best(best if first is None else pd.concat([first, best]))
        if not seen:
            return
        entries = pd.concat(([] if entries is None else [entries]) + seen).groupby("prompt_key", as_index=False, sort=False)["due"].max()
        self.store(entries[entries["due"] > now], before)
        if len(first):
            yield first[self.columns]

    def _best(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(self.order, kind="stable").drop_duplicates("prompt_key")


def unique_prompts(stream: DataFrame, prompt: str, order: Sequence[str], ts: str, watermark: str, horizon_ms: int, *,
                   heartbeat: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """S9 on a stream: the first row of each prompt: of its first micro-batch the first in
    ``order``. Repetitions are dropped until ``horizon_ms`` after the prompt's last
    occurrence; rows behind the watermark are dropped (a forgotten prompt can't come back
    by them). Where rows arrive in ``order``, the result is that of the batch operator."""
    columns = stream.columns
    s = _with_time(stream, ts, watermark, heartbeat).withColumn("prompt_key", F.sha2(F.col(prompt), 256))
    schema = stream.schema
    return s.withColumn("bucket", _bucket("prompt_key", buckets)).groupBy("bucket").transformWithStateInPandas(_First(horizon_ms, columns, list(order)), schema, "append", "eventTime")


# ---------------------------------------------------------------- ST1
def add_batch_moments(state: DataFrame | None, batch: DataFrame, key: str, value: str) -> DataFrame:
    """(key, batch_n, batch_mean, batch_m2, n, mean, m2): the batch's moments beside those
    over the state and the batch. Sums of squares are taken around the mean of each part
    and merged, so large offsets cost no digits."""
    new = batch.groupBy(key).agg(F.count(value).alias("batch_n"), F.avg(value).alias("batch_mean"), (F.var_pop(value) * F.count(value)).alias("batch_m2"))
    if state is None:
        old = new.select(key, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    else:
        old = state.select(key, "n", "mean", "m2")
    both = new.join(old, key, "full")
    bn, bm, b2 = F.coalesce("batch_n", F.lit(0)), F.coalesce("batch_mean", F.lit(0.0)), F.coalesce("batch_m2", F.lit(0.0))
    n, mean, m2 = F.coalesce("n", F.lit(0)), F.coalesce("mean", F.lit(0.0)), F.coalesce("m2", F.lit(0.0))
    total, gap = bn + n, bm - mean
    safe = F.greatest(total, F.lit(1))
    return both.select(key, bn.cast("long").alias("batch_n"), "batch_mean", b2.alias("batch_m2"), total.cast("long").alias("n"),
                       (mean + gap * bn / safe).alias("mean"), (m2 + b2 + gap * gap * bn * n / safe).alias("m2"))


def moments_sink(path: str, key: str, value: str) -> Callable[[DataFrame, int], None]:
    """ST1: a ``foreachBatch`` function that writes, for each micro-batch, every key's
    batch moments and running moments to ``path/batch=<id>``. A batch that is sent again
    after a restart reads the state before it and writes its folder anew."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{path}/batch={batch_id - 1:012d}") if batch_id else None
        add_batch_moments(state, batch, key, value).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write


def moments_log(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(batch, key, batch_n, batch_mean, batch_std, count, mean, var, std) of all batches."""
    log = spark.read.parquet(path)
    std = lambda m2, n: F.sqrt(F.col(m2) / F.nullif(F.col(n) - 1, F.lit(0)))
    return log.select(F.col("batch").cast("long").alias("batch"), key, "batch_n", "batch_mean", std("batch_m2", "batch_n").alias("batch_std"), F.col("n").alias("count"),
                      F.when(F.col("n") > 0, F.col("mean")).alias("mean"), (F.col("m2") / F.nullif(F.col("n"), F.lit(0))).alias("var"), std("m2", "n").alias("std"))


# ---------------------------------------------------------------- replay
def replay(arrivals: Sequence[DataFrame], run: Callable[[DataFrame], object], name: str) -> list:
    """Write one arrival after the other to a source folder and call ``run`` on the file
    stream after each, so that an arrival is a micro-batch and every arrival is a restart
    from the checkpoint. An arrival is written by as many tasks as it has partitions.
    Returns what ``run`` returned."""
    spark = arrivals[0].sparkSession
    path = scratch_path(spark, f"{name}-source")
    out = []
    for arrival in arrivals:
        arrival.write.mode("append").parquet(path)
        out.append(run(spark.readStream.schema(arrival.schema).parquet(path)))
    return out
