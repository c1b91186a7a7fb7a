"""Registry of named queries, each with its DuckDB oracle (when SQL can say it).

A query is ``fn(spark, sf_dir) -> DataFrame`` over the full test tables (or
views Spark derives from them). ``oracle`` is ANSI SQL for DuckDB over the
same tables; floats are rounded to 6 digits on both sides and nested results
are emitted as strings so both engines produce identical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


SCALE = 1e6


def finish(df: DataFrame) -> DataFrame:
    """Round every float column to 6 decimals as ``round(x * 1e6) / 1e6``.

    Both engines compute ``x * 1e6`` as the same IEEE double and round it to
    an integer half away from zero, so values on a decimal half-way point
    agree too (rounding straight to 6 digits does not: one engine rounds the
    decimal text, the other the binary value)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            # "+ 0.0" turns a negative zero into zero on both sides
            cols.append((F.round(x * F.lit(SCALE)) / F.lit(SCALE) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def round_sql(sql: str, describe) -> str:
    """Wrap an oracle query so its DOUBLE/FLOAT columns get the same rounding
    as :func:`finish`. ``describe(sql)`` returns ``[(name, type), ...]``."""
    cols = describe(sql)
    parts = []
    for name, typ in cols:
        q = '"' + name.replace('"', '""') + '"'
        if typ.upper() in ("DOUBLE", "FLOAT", "REAL") or typ.upper().startswith("DECIMAL"):
            parts.append(f"round(CAST({q} AS DOUBLE) * 1e6) / 1e6 + CAST(0.0 AS DOUBLE) AS {q}")
        else:
            parts.append(q)
    return f"SELECT {', '.join(parts)} FROM (\n{sql}\n) AS _oracle"


def ints_text(c) -> F.Column:
    """``array<int>`` -> ``'1 2 3'`` (DuckDB: ``array_to_string(x, ' ')``)."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def bools_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.when(x, F.lit("1")).otherwise(F.lit("0"))), "")


# SQL helpers shared by oracle texts -------------------------------------
def sql_lcp(a: str, b: str) -> str:
    """Longest common prefix length of two strings in DuckDB."""
    n = f"least(length({a}), length({b}))"
    return (
        f"coalesce(list_position(list_transform(range(1, {n} + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)), false) - 1, {n})"
    )


def sql_chatml(msgs: str) -> str:
    return (
        f"array_to_string(list_transform({msgs}, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '')"
    )


def sql_chatml_prompt(msgs: str) -> str:
    """Rendered prompt: generation prompt after a user turn, open final message after an assistant turn."""
    body = sql_chatml(msgs)
    last = f"({msgs})[-1].role"
    return (
        f"CASE WHEN {last} = 'user' THEN {body} || '<|im_start|>assistant' || chr(10) "
        f"WHEN {last} = 'assistant' THEN left({body}, length({body}) - 11) ELSE NULL END"
    )
