"""Supervised fine-tuning data preparation as one lazy plan.

conversations -> message lists -> prompt/completion split (X6) -> ChatML
rendering (P8) -> vocabulary + encoding (T1) -> completion mask (T2) ->
best-fit-decreasing packing (D2) -> position ids (D4) and labels (D5).
The only shuffles are the ones the work needs: gathering turns into
conversations, the vocabulary count/rank, token regrouping, and the packing
shuffle on the shard key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as tk
from ..operators.conversions import split_last_message
from ..operators.formats import maybe_apply_chat_template
from ..operators.packing import pack
from ..sources import views


def rendered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt/completion ChatML strings per conversation (valid rows only)."""
    m = views.msgs(spark, sf_dir)
    split = split_last_message(m).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rendered = maybe_apply_chat_template(split.select("example_id", "prompt", "completion"))
    return rendered.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, prompt_ids, input_ids``: the prompt and prompt+completion
    encoded separately with one corpus vocabulary (T1)."""
    pc = rendered_pairs(spark, sf_dir).withColumn("full", F.concat("prompt", "completion"))
    pc = pc.select("example_id", tk.split_tokens("prompt").alias("prompt"), tk.split_tokens("full").alias("full")).checkpoint()
    vocab = tk.build_vocab(pc, ["full"])
    enc = tk.encode(pc, "example_id", {"prompt_ids": F.col("prompt"), "input_ids": F.col("full")}, vocab)
    return enc.select("example_id", "prompt_ids", "input_ids")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``example_id, input_ids, completion_mask, prompt_is_prefix`` (T1+T2).

    Only prompt+completion is encoded: the prompt's token count and the
    prefix check come from the token *strings* (no ids needed), which halves
    the exploded token volume of the vocabulary join."""
    pc = rendered_pairs(spark, sf_dir).select("example_id", tk.split_tokens("prompt").alias("pt"), tk.split_tokens(F.concat("prompt", "completion")).alias("full"))
    n_p = F.size("pt")
    ok = (n_p <= F.size("full")) & F.when(n_p == 0, F.lit(True)).otherwise(F.slice("full", 1, F.greatest(n_p, F.lit(1))) == F.col("pt"))
    # the texts are rendered and split once, for the vocabulary and for the ids
    pc = pc.select("example_id", "full", n_p.alias("n_prompt"), ok.alias("prompt_is_prefix")).checkpoint()
    vocab = tk.build_vocab(pc, ["full"])
    enc = tk.encode(pc, "example_id", {"input_ids": F.col("full")}, vocab, carry=["n_prompt", "prompt_is_prefix"])
    mask = F.concat(
        F.array_repeat(F.lit(0), F.col("n_prompt")),
        F.array_repeat(F.lit(1), F.greatest(F.size("input_ids") - F.col("n_prompt"), F.lit(0))),
    )
    return enc.select("example_id", "input_ids", mask.alias("completion_mask"), "prompt_is_prefix")


def packed(spark: SparkSession, sf_dir: str, seq_length: int = 1024) -> DataFrame:
    """Packed training rows with ``position_ids`` and ``labels``."""
    tok = tokenized(spark, sf_dir).select("example_id", "input_ids", "completion_mask")
    p = pack(tok, seq_length, strategy="bfd")
    p = p.withColumn("position_ids", tk.position_ids("seq_lengths"))
    return p.withColumn("labels", tk.lm_labels("input_ids", "completion_mask", "position_ids"))
