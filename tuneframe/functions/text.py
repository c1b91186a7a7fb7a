"""String and message-list column builders (all JVM-side expressions).

Every builder takes and returns ``Column`` objects so it composes into one
projection. Lengths and prefixes count Unicode characters (Spark's
``substring`` and ``length`` work on code points), matching Python strings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ChatML special tokens and the simple chat template pieces.
CHATML_BOS = "<|im_start|>"
CHATML_EOS = "<|im_end|>"
SIMPLE_GENERATION_PROMPT = "Assistant:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def capitalize(c: Column | str) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower (not per word)."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, F.greatest(F.length(c), F.lit(1)))))


def drop_suffix_chars(s: Column, n: int) -> Column:
    return F.left(s, F.greatest(F.length(s) - F.lit(n), F.lit(0)))


def render_chatml(messages, add_generation_prompt=False, continue_final_message=False) -> Column:
    """Render ``array<struct<role,content>>`` with the ChatML template.

    ``add_generation_prompt`` appends ``<|im_start|>assistant\\n``;
    ``continue_final_message`` leaves the last message open (its end token and
    newline are not emitted).
    """
    m = col(messages)
    body = F.array_join(
        F.transform(
            m, lambda x: F.concat(F.lit(CHATML_BOS), x["role"], F.lit("\n"), x["content"], F.lit(CHATML_EOS + "\n"))
        ),
        "",
    )
    cont = lit_or_col(continue_final_message)
    body = F.when(cont & (F.size(m) > 0), drop_suffix_chars(body, len(CHATML_EOS) + 1)).otherwise(body)
    return F.when(lit_or_col(add_generation_prompt), F.concat(body, F.lit(CHATML_BOS + "assistant\n"))).otherwise(body)


def render_simple(messages, add_generation_prompt=False) -> Column:
    """``Role: content\\n\\n`` per message (+ ``Assistant:``), the judge-side template."""
    m = col(messages)
    body = F.array_join(
        F.transform(m, lambda x: F.concat(capitalize(x["role"]), F.lit(": "), x["content"], F.lit("\n\n"))), ""
    )
    return F.when(lit_or_col(add_generation_prompt), F.concat(body, F.lit(SIMPLE_GENERATION_PROMPT))).otherwise(body)


def _bsearch_prefix(a: Column, b: Column, length_fn, equal_prefix) -> Column:
    """Length of the longest common prefix by binary search over the prefix
    length: O(log n) prefix comparisons, no per-character arrays."""
    n = F.least(length_fn(a), length_fn(b))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))
    init = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = ((lo + hi + 1) / 2).cast("int")
        ok = equal_prefix(a, b, mid)
        return F.when(
            lo < hi,
            F.struct(F.when(ok, mid).otherwise(lo).alias("lo"), F.when(ok, hi).otherwise(mid - 1).alias("hi")),
        ).otherwise(acc)

    return F.when(n.isNull(), None).otherwise(F.aggregate(steps, init, step)["lo"])


def common_prefix_len(a, b) -> Column:
    """Number of leading characters two strings share (X1, strings)."""
    return _bsearch_prefix(col(a), col(b), F.length, lambda x, y, k: F.left(x, k) == F.left(y, k))


def common_prefix_len_array(a, b) -> Column:
    """Number of leading elements two arrays share (X1, arrays; element equality)."""

    def eq(x, y, k):
        return F.when(k == 0, F.lit(True)).otherwise(F.slice(x, 1, F.greatest(k, F.lit(1))) == F.slice(y, 1, F.greatest(k, F.lit(1))))

    return _bsearch_prefix(col(a), col(b), F.size, eq)


def ensure_suffix(c, suffix: str) -> Column:
    """Append ``suffix`` unless the value already ends with it."""
    c = col(c)
    return F.when(c.endswith(suffix), c).otherwise(F.concat(c, F.lit(suffix)))


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(col(c), r"\A\s+|\s+\z", "")


def strip_tag(c, tag: str) -> Column:
    """Remove every occurrence of ``tag`` and strip surrounding whitespace."""
    return py_strip(F.replace(col(c), F.lit(tag), F.lit("")))
