"""Sources and sinks.

Readers always declare or prune the schema so Parquet column pruning and
predicate pushdown reach the scan; writers partition by the column later
jobs filter on (``split``, ``step``).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import global_rank
from ..session import ensure_checkpoint_dir


def read(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    columns: Sequence[str] | None = None,
    schema: T.StructType | str | None = None,
    split: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Load a dataset (file, directory or list of files), optionally one
    ``split`` of a split-partitioned directory and a column subset (pruned at
    the scan)."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    df = r.load(path if isinstance(path, str) else list(path))
    if split is not None:
        df = df.filter(F.col("split") == split)
    if columns is not None:
        df = df.select(*columns)
    return df


def mixture(frames: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Concatenate datasets (optionally a column subset of each);
    an empty mixture is an error and schemas must agree by name."""
    if not frames:
        raise ValueError("a mixture needs at least one dataset")
    parts = [f.select(*columns) if columns else f for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                columns: Sequence[str] | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: the same dataset as a stream (schema always declared)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(path)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, files: Mapping[str, str], schema: T.StructType | str) -> DataFrame:
    """JSON-lines files per split -> one frame with a ``split`` column."""
    return mixture([spark.read.schema(schema).json(p).withColumn("split", F.lit(s)) for s, p in files.items()])


def slice_fraction(df: DataFrame, order: Sequence[str], fraction: float) -> DataFrame:
    """The first ``floor(fraction·n)`` rows in ``order`` (``train[:50%]``)."""
    ranked = global_rank(df, list(order), "_tf_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_tf_n"))
    j = ranked.join(F.broadcast(n), how="inner", on=F.lit(True))  # attach the 1-row count
    return j.filter(F.col("_tf_rank") <= F.floor(F.col("_tf_n") * fraction)).drop("_tf_rank", "_tf_n")


MESSAGE_LITERAL_SCHEMA = "array<struct<`from`:string,value:string>>"


# possessive, so that long strings need no recursion; a quote left over is malformed
_LITERAL_TOKEN = r"""(?s)"[^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+"|'[^'\\\n\r]*+(?:\\.[^'\\\n\r]*+)*+'|[^'"]++|['"]"""
_STRING_PIECE = r"(?s)\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\.|[^\\]++"


def _json_piece(p: Column) -> Column:
    """A plain run or one escape of a Python string, as JSON."""
    kind = F.substring(p, 2, 1)
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = F.conv(F.substring(p, 3, 8), 16, 10).cast("long")
    high = F.lit(0xD800) + F.floor((code - 0x10000) / 1024)
    return (
        F.when(~p.startswith("\\"), F.replace(p, F.lit('"'), F.lit('\\"')))
        .when(kind == "'", F.lit("'"))
        .when(kind == "\n", F.lit(""))
        .when(kind == "a", F.lit("\\u0007"))
        .when(kind == "v", F.lit("\\u000b"))
        .when((kind == "x") & (F.length(p) == 4), F.concat(F.lit("\\u00"), F.substring(p, 3, 2)))
        .when((kind == "U") & (F.length(p) == 10), F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(F.lit(0xDC00) + code % 1024))))
        .when(kind.rlike("[0-7]"), unit(F.conv(F.substring(p, 2, 3), 8, 10).cast("long")))
        .when(kind.rlike(r'["\\/bfnrtuxUN]'), p)  # JSON's own, or an error in Python too
        .otherwise(F.concat(F.lit("\\"), p))
    )


def literal_to_json(col: Column) -> Column:
    """A Python literal of lists, dicts, strings, numbers, None and booleans as
    JSON; JSON stays as it is, what neither knows stays malformed."""

    def token(t: Column) -> Column:
        pieces = F.regexp_extract_all(t.substr(F.lit(2), F.length(t) - 2), F.lit(_STRING_PIECE), F.lit(0))
        string = F.concat(F.lit('"'), F.array_join(F.transform(pieces, _json_piece), ""), F.lit('"'))
        other = t
        for old, new in ((r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r",(\s*[\]}])", "$1")):
            other = F.regexp_replace(other, old, new)
        return F.when(t.isin("'", '"'), F.lit("'")).when(t.rlike("^['\"]"), string).otherwise(other)

    return F.array_join(F.transform(F.regexp_extract_all(col, F.lit(_LITERAL_TOKEN), F.lit(0)), token), "")


def parse_message_literal(c: Column | str, schema: str = MESSAGE_LITERAL_SCHEMA) -> Column:
    """Message lists stored as a Python/JSON literal string (single or
    double quotes, Python's escapes, None). Malformed text gives NULL (route
    those rows to a reject table)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(literal_to_json(col), schema, {"allowSingleQuotes": "false", "allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write a frame with a ``split`` column as split-partitioned Parquet."""
    df.write.mode(mode).partitionBy("split").parquet(path)
    return path


def log_completions(df: DataFrame, path: str, step: str = "step") -> str:
    """Append completion records (step, prompt, completion, rewards,
    advantage) to a step-partitioned table."""
    df.write.mode("append").partitionBy(step).parquet(path)
    return path


def log_completions_stream(stream: DataFrame, path: str, checkpoint: str, step: str = "step"):
    """S8 (stream): the same table fed by a streaming query (exactly-once
    file sink with its own checkpoint)."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy(step).outputMode("append").start()
    )


def unique_prompts(df: DataFrame, prompt: str = "prompt", order: Sequence[str] = ("step", "example_id")) -> DataFrame:
    """One row per prompt - its first logged record in ``order``
    (``min_by`` per prompt: a partial aggregate, safe for hot prompts)."""
    others = [c for c in df.columns if c != prompt]
    ordkey = F.struct(*[F.col(o) for o in order])
    g = df.groupBy(prompt).agg(F.min_by(F.struct(*others), ordkey).alias("_tf_first"))
    return g.select(prompt, *[F.col("_tf_first")[c].alias(c) for c in others])
