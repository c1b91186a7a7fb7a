"""Message lists stored as text, read the way Python or JSON reads them.

``readers.parse_message_literal`` turns the usual literals into JSON on the JVM. This
reader takes every literal that Python knows (tuples, neighbouring and prefixed strings,
``\\N{...}``, comments) and says what is wrong with a text, and where. It runs in Arrow
batches; a row's text is read once by Python's own literal reader, which evaluates no
code."""

from __future__ import annotations

import ast
import json
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MESSAGE = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
READ = T.StructType([
    T.StructField("messages", T.ArrayType(_MESSAGE)), T.StructField("reject_reason", T.StringType()),
    T.StructField("reject_line", T.IntegerType()), T.StructField("reject_column", T.IntegerType()),
])


def _value(text: str):
    """(value, None) or (None, (reason, line, column)); lines and columns count from 1."""
    try:
        return json.loads(text), None
    except ValueError:
        pass
    try:
        with warnings.catch_warnings():  # an unknown escape stands for itself
            warnings.simplefilter("ignore")
            return ast.literal_eval(text.strip(" \t")), None
    except SyntaxError as e:
        return None, ("not a literal: " + str(e.msg), e.lineno, e.offset)
    except (ValueError, TypeError) as e:
        return None, ("not a literal: " + str(e).split(" on line ")[0].split(": <")[0], None, None)
    except (RecursionError, MemoryError):
        return None, ("nested too deeply", None, None)


def read_messages(text: str | None):
    """(messages, reason, line, column) of one text."""
    if text is None:
        return None, "no text", None, None
    value, wrong = _value(text)
    if wrong:
        return None, *wrong
    if not isinstance(value, (list, tuple)):
        return None, "not a list of messages", None, None
    out = []
    for i, m in enumerate(value):
        if not isinstance(m, dict):
            return None, f"message {i} is not a mapping", None, None
        pair = (m.get("from"), m.get("value"))
        if not all(x is None or isinstance(x, str) for x in pair):
            return None, f"message {i} holds something that is not text", None, None
        # half of a surrogate pair alone is no text
        if any(x is not None and any("\ud800" <= c <= "\udfff" for c in x) for x in pair):
            return None, f"message {i} holds half a character", None, None
        out.append({"from": pair[0], "value": pair[1]})
    return out, None, None, None


@F.pandas_udf(READ)
def _read(texts: pd.Series) -> pd.DataFrame:
    rows = [read_messages(t) for t in texts]
    return pd.DataFrame({
        "messages": [r[0] for r in rows], "reject_reason": [r[1] for r in rows],
        "reject_line": pd.array([r[2] for r in rows], dtype="Int32"), "reject_column": pd.array([r[3] for r in rows], dtype="Int32"),
    })


def read_message_literals(df: DataFrame, column: Column | str, out: str = "messages") -> DataFrame:
    """``df`` with ``out`` (array of from, value) and reject_reason, reject_line,
    reject_column, which are null for texts that are lists of messages. Every row stays."""
    col = F.col(column) if isinstance(column, str) else column
    read = df.withColumn("_tf_read", _read(col.cast("string")))
    named = [F.col(f"_tf_read.{c}").alias(out if c == "messages" else c) for c in READ.fieldNames()]
    return read.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, *READ.fieldNames()[1:])], *named)
