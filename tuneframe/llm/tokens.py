"""Token totals kept up to date by signed changes (operator 5).

Totals by source, language and tokenizer version are sums, so a batch of
changes, each an insert (+), a delete (-) or a revised count (both), is stored as
its own small sums and the totals are the sum over committed batches. A batch is
first written under its own name (overwriting what an earlier attempt left) and
then committed by creating one marker file; a batch whose marker exists is
skipped, so repeats and retries change nothing. Counting runs in Arrow batches
with a public tokenizer; sums are pre-aggregated before any shuffle.

Defined cases: null and empty texts have no tokens but count as documents; null
sources and languages are groups of their own; rows that repeat an id are each
inserted, and deleted or revised together; empty batches commit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import chunks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ["source", "lang", "tokenizer_version"]
CHANGES = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def load_ranks(path: str) -> dict[bytes, int]:
    """A tokenizer's vocabulary (at most its some 10 ** 5 entries), read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _counter(shared, version: str, pattern: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        known = tiktoken.__dict__.setdefault("_corpus_encodings", {})  # one per worker process
        if (version, pattern) not in known:
            known[version, pattern] = tiktoken.Encoding(version, pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        encode = known[version, pattern].encode_ordinary
        for whole in batches:
            for batch in chunks(whole):
                n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n, pa.int64())], [*columns, "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, text_column: str = "text", keep: list[str], tokenizer: str = TOKENIZER, version: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_tokens and tokenizer_version (the
    tokenizer's file name by default)."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    version = version or tokenizer.rsplit("/", 1)[-1]
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(tokenizer))
    rows = docs.select(*keep, F.col(text_column).alias("text"))
    schema = rows.drop("text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_counter(shared, version, pattern, keep), schema).withColumn("tokenizer_version", F.lit(version))


def inserted(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens")


def deleted(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both counts of the revised documents; they may change group too."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """Totals in a shared folder: ``batches/<name>`` holds a batch's sums,
    ``commits/<name>`` marks it as counting. A batch is written by one job at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def committed(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits")))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if it was committed before.
        The marker is created only if it isn't there, and last, so an attempt
        that fails before, or comes second, leaves the totals as they were."""
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")
        return self._fs.createNewFile(self._path(f"{self.root}/commits/{batch}"))

    def totals(self) -> DataFrame:
        paths = [f"{self.root}/batches/{batch}" for batch in self.committed()]
        rows = self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")
