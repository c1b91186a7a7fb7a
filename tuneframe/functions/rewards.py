"""Row-level reward and score expressions (F1-F8, G3/G4 helpers).

All are ``Column`` builders; NULL means "not applicable" (the reference's
``None``/NaN), never a silent zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, py_strip

# The reasoning-block pattern (starts with the open tag, no
# second open tag, a closing tag follows), answer extraction patterns.
THINK_PATTERN = r"(?s)^<think>(?!.*<think>).*?</think>"
BOXED_PATTERN = r"\\boxed\{([^{}]*)\}"
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"


def think_format(c: Column | str) -> Column:
    """F1: 1.0 when the text opens with ``<think>``, has no second ``<think>``
    and closes the block; else 0.0."""
    return F.when(col(c).rlike(THINK_PATTERN), F.lit(1.0)).otherwise(F.lit(0.0))


def soft_overlong_penalty(length: Column | str, max_len: int, cache: int) -> Column:
    """0 up to ``max_len - cache``, then linear down to -1 at ``max_len``,
    -1 beyond. ``cache = 0`` never divides."""
    n = col(length)
    lo = max_len - cache
    ramp = F.lit(0.0) if cache == 0 else (F.lit(float(lo)) - n) / F.lit(float(cache))
    return F.when(n <= lo, F.lit(0.0)).when(n <= max_len, ramp).otherwise(F.lit(-1.0))


def _answer(c: Column) -> Column:
    boxed = F.regexp_extract(c, BOXED_PATTERN, 1)
    nums = F.regexp_extract_all(c, F.lit(NUMBER_PATTERN), 0)
    last = F.try_element_at(nums, F.lit(-1))
    cand = F.when(boxed != "", boxed).otherwise(last)
    return cand.try_cast("double")


def accuracy(completion: Column | str, solution: Column | str) -> Column:
    """F3 (re-aimed): when the solution has a numeric answer (``\\boxed{}``
    content, else its last number), reward 1.0 iff the completion's answer
    equals it numerically (0.0 when the completion has none); otherwise fall
    back to case-insensitive equality of the stripped texts."""
    comp, sol = col(completion), col(solution)
    gold = _answer(sol)
    pred = _answer(comp)
    numeric = F.when(pred.isNotNull() & (F.abs(pred - gold) <= F.lit(1e-9)), F.lit(1.0)).otherwise(F.lit(0.0))
    text_eq = F.when(F.lower(py_strip(comp)) == F.lower(py_strip(sol)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(gold.isNotNull(), numeric).otherwise(text_eq)


def is_truncated(ids: Column | str, eos_id: int, pad_id: int) -> Column:
    """the last token is neither EOS nor pad (no end reached)."""
    last = F.try_element_at(col(ids), F.lit(-1))
    return ~(last.isin(eos_id, pad_id)) | last.isNull()


def contains_eos(ids: Column | str, eos_id: int) -> Column:
    """EOS appears anywhere in the completion."""
    return F.array_contains(col(ids), eos_id)


def mask_truncated(mask: Column | str, truncated: Column | str) -> Column:
    """zero the completion mask of truncated completions (they carry no
    loss), keep it otherwise."""
    m = col(mask)
    return F.when(col(truncated), F.transform(m, lambda _x: F.lit(0))).otherwise(m)


def missing_eos_penalty(score: Column | str, has_eos: Column | str, penalty: float) -> Column:
    """subtract ``penalty`` from scores of completions without EOS."""
    return F.when(col(has_eos), col(score)).otherwise(col(score) - F.lit(penalty))


def log_sigmoid(x: Column) -> Column:
    """F8: numerically stable ``log(sigmoid(x)) = min(x,0) - log1p(exp(-|x|))``."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` in the stable form."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
