"""Dataset-type conversions (C1-C19) and prompt extraction / unpairing.

Types: LM (``text``/``messages``), PO (``prompt``), PC (``prompt, completion``),
PI (``chosen, rejected``), PE (``prompt, chosen, rejected``), UP
(``prompt, completion, label``), SS (``prompt, completions[], labels[]``).
Each conversion is a narrow projection/filter; ``concat`` works on strings and
on message arrays alike, so both standard and conversational forms go through
the same code. Every other column (keys) is carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .formats import is_conversational

# ---------------------------------------------------------------- X1/X2
def _is_array(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.ArrayType)


def extract_prompt(df: DataFrame) -> DataFrame:
    """Split the shared start of ``chosen``/``rejected`` into ``prompt``.

    The split index is the first mismatch within the shorter side; when there
    is none it is one element before the end of the shorter side (as the
    reference's loop leaves it). For strings, a space just before the split
    moves into the completions. Deviation: a split that would go negative or
    an empty side gives index 0 (the reference fails or wraps around).
    """
    arr = _is_array(df, "chosen")
    c, r = F.col("chosen"), F.col("rejected")
    if arr:
        lcp = tx.common_prefix_len_array(c, r)
        n = F.least(F.size(c), F.size(r))
    else:
        lcp = tx.common_prefix_len(c, r)
        n = F.least(F.length(c), F.length(r))
    idx = F.when(lcp < n, lcp).otherwise(n - 1)
    if not arr:
        idx = F.when((lcp < n) & (lcp >= 1) & (F.substring(c, lcp, 1) == " "), lcp - 1).otherwise(idx)
    idx = F.greatest(idx, F.lit(0))
    out = df.withColumn("_tf_idx", idx)
    i = F.col("_tf_idx")
    if arr:
        big = F.lit(1 << 30)
        prompt = F.slice(c, 1, i)
        chosen = F.slice(c, i + 1, big)
        rejected = F.slice(r, i + 1, big)
    else:
        prompt = F.left(c, i)
        chosen = F.substring(c, i + 1, F.greatest(F.length(c), F.lit(1)))
        rejected = F.substring(r, i + 1, F.greatest(F.length(r), F.lit(1)))
    rest = [x for x in df.columns if x not in ("prompt", "chosen", "rejected")]
    return out.select(*rest, prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


def maybe_extract_prompt(df: DataFrame) -> DataFrame:
    """Extract only when no usable ``prompt`` exists. A ``prompt`` column is
    kept when prompt and answers are both conversational or both not."""
    if "chosen" not in df.columns or "rejected" not in df.columns:
        return df
    if "prompt" in df.columns:
        p_conv = _is_array(df, "prompt")
        a_conv = _is_array(df, "chosen")
        if p_conv == a_conv:
            return df
    return extract_prompt(df.drop("prompt") if "prompt" in df.columns else df)


def unpair(df: DataFrame) -> DataFrame:
    """PE/PI -> UP in one narrow pass: each pair explodes into a
    ``label=true`` row (chosen) and a ``label=false`` row (rejected). The
    reference emits all chosen rows of a batch before all rejected rows;
    ``pair_side`` (0 chosen, 1 rejected) keeps that order available."""
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    exploded = df.select(
        *rest,
        F.inline(
            F.array(
                F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label"), F.lit(0).alias("pair_side")),
                F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label"), F.lit(1).alias("pair_side")),
            )
        ),
    )
    return exploded


def maybe_unpair(df: DataFrame) -> DataFrame:
    """Unpair only when both ``chosen`` and ``rejected`` are present."""
    return unpair(df) if {"chosen", "rejected"} <= set(df.columns) else df


def split_last_message(df: DataFrame, column: str = "messages") -> DataFrame:
    """Conversation -> ``prompt`` (all but the last message) + ``completion``
    (the last one). Conversations with fewer than two messages get
    ``reject_reason``."""
    m = F.col(column)
    ok = F.size(m) >= 2
    return df.select(
        *[c for c in df.columns if c != column],
        F.when(ok, F.slice(m, 1, F.size(m) - 1)).alias("prompt"),
        F.when(ok, F.slice(m, -1, 1)).alias("completion"),
        F.when(~ok, F.lit("conversation needs at least two messages")).alias("reject_reason"),
    )


# ---------------------------------------------------------------- C1-C19
def _lm_col(df: DataFrame, c: str) -> str:
    return "messages" if _is_array(df, c) else "text"


def _rest(df: DataFrame, *drop: str) -> list[str]:
    return [c for c in df.columns if c not in drop]


def pc_to_lm(df):  # C1
    return df.select(*_rest(df, "prompt", "completion"), F.concat("prompt", "completion").alias(_lm_col(df, "prompt")))


def pc_to_po(df):  # C2
    return df.drop("completion")


def pi_to_lm(df):  # C3
    return df.drop("rejected").withColumnRenamed("chosen", _lm_col(df, "chosen"))


def pi_to_pc(df):  # C4
    return extract_prompt(df).drop("rejected").withColumnRenamed("chosen", "completion")


def pi_to_po(df):  # C5
    e = extract_prompt(df)
    return e.drop("chosen", "rejected")


def pi_to_pe(df):  # C6
    return extract_prompt(df)


def pi_to_up(df):  # C7
    return unpair(extract_prompt(df))


def pe_to_lm(df):  # C8
    return df.select(*_rest(df, "prompt", "chosen", "rejected"), F.concat("prompt", "chosen").alias(_lm_col(df, "prompt")))


def pe_to_pc(df):  # C9
    return df.drop("rejected").withColumnRenamed("chosen", "completion")


def pe_to_po(df):  # C10
    return df.drop("chosen", "rejected")


def pe_to_pi(df):  # C11
    return df.select(
        *_rest(df, "prompt", "chosen", "rejected"),
        F.concat("prompt", "chosen").alias("chosen"),
        F.concat("prompt", "rejected").alias("rejected"),
    )


def pe_to_up(df):  # C12
    return unpair(df)


def up_to_lm(df):  # C13
    good = df.filter(F.col("label"))
    return good.select(*_rest(df, "prompt", "completion", "label"), F.concat("prompt", "completion").alias(_lm_col(df, "prompt")))


def up_to_pc(df):  # C14
    return df.filter(F.col("label")).drop("label")


def up_to_po(df):  # C15
    return df.drop("completion", "label")


def _all_true(c: str):
    return F.forall(c, lambda x: x)


def ss_to_lm(df):  # C16
    good = df.filter(_all_true("labels"))
    return good.select(
        *_rest(df, "prompt", "completions", "labels"),
        F.concat(F.col("prompt"), F.array_join("completions", "")).alias("text"),
    )


def ss_to_pc(df):  # C17
    good = df.filter(_all_true("labels"))
    return good.select(*_rest(df, "completions", "labels"), F.array_join("completions", "").alias("completion"))


def ss_to_po(df):  # C18
    return df.drop("completions", "labels")


def ss_to_up(df):  # C19
    return df.select(
        *_rest(df, "completions", "labels"),
        F.array_join("completions", "").alias("completion"),
        _all_true("labels").alias("label"),
    )


CONVERSIONS = {
    ("PC", "LM"): pc_to_lm, ("PC", "PO"): pc_to_po,
    ("PI", "LM"): pi_to_lm, ("PI", "PC"): pi_to_pc, ("PI", "PO"): pi_to_po, ("PI", "PE"): pi_to_pe, ("PI", "UP"): pi_to_up,
    ("PE", "LM"): pe_to_lm, ("PE", "PC"): pe_to_pc, ("PE", "PO"): pe_to_po, ("PE", "PI"): pe_to_pi, ("PE", "UP"): pe_to_up,
    ("UP", "LM"): up_to_lm, ("UP", "PC"): up_to_pc, ("UP", "PO"): up_to_po,
    ("SS", "LM"): ss_to_lm, ("SS", "PC"): ss_to_pc, ("SS", "PO"): ss_to_po, ("SS", "UP"): ss_to_up,
}


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """Dispatch over the conversion matrix; unsupported pairs raise."""
    try:
        return CONVERSIONS[(source, target)](df)
    except KeyError:
        raise ValueError(f"no conversion from {source} to {target}") from None


__all__ = ["convert", "extract_prompt", "maybe_extract_prompt", "unpair", "maybe_unpair", "split_last_message", "is_conversational"]
