"""Token-sequence queries: pair / unpaired / stepwise encodings, truncation
rules, collation and assistant masks (T3-T9, D7), on the SFT encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tokens as tk
from ..sources import views as vw
from ..sources.views import with_views
from . import sft
from .catalog import ints_text, register
from .prep_queries import TOKEN_RE, tok_sql

_TB = ("tb", "SELECT example_id, prompt_ids AS p, list_slice(input_ids, len(prompt_ids) + 1, len(input_ids)) AS c, input_ids AS f FROM ids")


def _tb(spark, d):
    e = sft.encoded(spark, d)
    return e.select(
        "example_id", F.col("prompt_ids").alias("p"),
        F.slice("input_ids", F.size("prompt_ids") + 1, F.greatest(F.size("input_ids"), F.lit(1))).alias("c"),
        F.col("input_ids").alias("f"),
    )


def _keep_end_sql(x: str, n) -> str:
    return f"list_slice({x}, greatest(len({x}) - ({n}) + 1, 1), len({x}))"


def _keep_start_sql(x: str, n) -> str:
    return f"list_slice({x}, 1, greatest({n}, 0))"


def _txt(x: str) -> str:
    return f"array_to_string({x}, ' ')"


# T4 ------------------------------------------------------------------------
_T4 = ("t4", f"""SELECT example_id, {_keep_end_sql('list_concat([1], p, [2])', 64)} AS pp,
        {_keep_start_sql('list_concat(c, [2])', 32)} AS cc, {_keep_start_sql('list_concat(list_reverse(c), [2])', 32)} AS rr FROM tb""")


def _t4(spark, d):
    t = _tb(spark, d)
    return t.select("example_id", *tk.preference_encode("p", "c", F.reverse("c"), eos=2, bos=1, add_special_tokens=True,
                                                         max_prompt_length=64, max_completion_length=32))


@register("preference_encode", tok_sql(f"SELECT example_id, {_txt('pp')} AS prompt_ids, {_txt('cc')} AS chosen_ids, {_txt('rr')} AS rejected_ids FROM t4",
                                       [_TB, _T4]))
def preference_encode(spark, d):
    """T4: preference encoding (EOS on completions, BOS/EOS around the prompt,
    prompt keeps its end at 64, completions keep their start at 32)."""
    t = _t4(spark, d)
    return t.select("example_id", ints_text("prompt_input_ids").alias("prompt_ids"), ints_text("chosen_input_ids").alias("chosen_ids"),
                    ints_text("rejected_input_ids").alias("rejected_ids"))


@register("preference_collate", tok_sql(
    f"""SELECT example_id, CAST(example_id // 8 AS BIGINT) AS batch,
        {_txt("list_concat(list_transform(range(mp - len(pp)), lambda x: 0), pp)")} AS prompt_ids,
        {_txt("list_concat(list_transform(range(mp - len(pp)), lambda x: 0), list_transform(pp, lambda x: 1))")} AS prompt_mask,
        {_txt("list_concat(cc, list_transform(range(mc - len(cc)), lambda x: 0))")} AS chosen_ids,
        {_txt("list_concat(rr, list_transform(range(mr - len(rr)), lambda x: 0))")} AS rejected_ids
    FROM t4 JOIN (SELECT example_id // 8 AS b, max(len(pp)) AS mp, max(len(cc)) AS mc, max(len(rr)) AS mr FROM t4 GROUP BY 1) m
         ON m.b = t4.example_id // 8""", [_TB, _T4]))
def preference_collate(spark, d):
    """Preference batches of 8 padded with pad id 0 - prompts (and their
    masks) on the left, chosen/rejected on the right."""
    t = _t4(spark, d).withColumn("batch", F.floor(F.col("example_id") / 8).cast("long"))
    c = tk.preference_collate(t, "batch", 0)
    return c.select("example_id", "batch", ints_text("prompt_input_ids").alias("prompt_ids"), ints_text("prompt_attention_mask").alias("prompt_mask"),
                    ints_text("chosen_input_ids").alias("chosen_ids"), ints_text("rejected_input_ids").alias("rejected_ids"))


# T5 / T6 -------------------------------------------------------------------
@register("unpaired_split", tok_sql(
    """SELECT example_id, array_to_string(list_slice(f, 1, st), ' ') AS prompt_ids, array_to_string(list_slice(f, st + 1, len(f)), ' ') AS answer_ids
       FROM (SELECT example_id, f, CASE WHEN len(p) = 0 OR list_slice(f, 1, len(p)) = p THEN len(p) ELSE len(p) - 1 END AS st FROM tb)""",
    [_TB]))
def unpaired_split(spark, d):
    """T5: prompt/answer split of the joint encoding with boundary repair."""
    t = _tb(spark, d)
    cols = tk.unpaired_split("p", "f")
    return t.select("example_id", ints_text(cols[0]).alias("prompt_ids"), ints_text(cols[1]).alias("answer_ids"))


_T6 = [
    _TB,
    ("u1", "SELECT example_id, p, c, 128 - CASE WHEN len(p) > 0 AND p[1] <> 1 THEN 1 ELSE 0 END "
           "- CASE WHEN len(c) > 0 AND c[-1] <> 2 THEN 1 ELSE 0 END AS budget FROM tb"),
    ("u2", f"SELECT *, CASE WHEN len(p) + len(c) > budget THEN {_keep_end_sql('p', 48)} ELSE p END AS p2 FROM u1"),
    ("u3", f"SELECT *, CASE WHEN len(p2) + len(c) > budget THEN {_keep_start_sql('c', 'budget - 48')} ELSE c END AS a2, "
           "CASE WHEN len(p2) = 0 OR p2[1] <> 1 THEN list_concat([1], p2) ELSE p2 END AS p3 FROM u2"),
    ("u4", "SELECT example_id, p3, list_concat(p3, a2, CASE WHEN len(a2) = 0 OR a2[-1] <> 2 THEN [2] ELSE [] END) AS full_ids FROM u3"),
]


@register("unpaired_truncate", tok_sql(
    "SELECT example_id, array_to_string(p3, ' ') AS prompt_ids, array_to_string(full_ids, ' ') AS completion_ids, "
    "array_to_string(list_transform(full_ids, lambda x, i: CASE WHEN i <= len(p3) THEN -100 ELSE x END), ' ') AS labels FROM u4", _T6))
def unpaired_truncate(spark, d):
    """Unpaired truncation (budget 128, prompt keeps its last 48 ids) with
    BOS/EOS repair and prompt labels ignored."""
    t = _tb(spark, d)
    cols = tk.unpaired_truncate("p", "c", bos=1, eos=2, max_length=128, max_prompt_length=48, truncation_mode="keep_end")
    return t.select("example_id", ints_text(cols[0]).alias("prompt_ids"), ints_text(cols[1]).alias("completion_ids"), ints_text(cols[2]).alias("labels"))


_PAIR = [_TB, ("q1", "SELECT example_id, p, c, list_slice(c, 1, len(c) // 2) AS r FROM tb"),
         ("q2", f"SELECT *, CASE WHEN len(p) + len(c) > 96 THEN {_keep_end_sql('p', 32)} ELSE p END AS pp FROM q1"),
         ("q3", "SELECT *, CASE WHEN len(pp) + len(c) > 96 THEN list_slice(c, 1, 64) ELSE c END AS cc, CASE WHEN len(pp) + len(c) > 96 THEN list_slice(r, 1, 64) ELSE r END AS rr FROM q2")]


@register("pair_truncate", tok_sql(
    f"""SELECT example_id, {_txt('pp')} AS prompt_ids, {_txt('list_concat(pp, cc)')} AS chosen_ids, {_txt('list_concat(pp, rr)')} AS rejected_ids,
        {_txt('list_concat(list_transform(pp, lambda x: -100), cc)')} AS chosen_labels, {_txt('list_concat(list_transform(pp, lambda x: -100), rr)')} AS rejected_labels FROM q3""", _PAIR))
def pair_truncate(spark, d):
    """T6 for pairs: both sides cut against the longer response (96 ids, the prompt keeps
    its last 32); the rejected response is the first half of the chosen one."""
    t = _tb(spark, d).withColumn("r", F.slice("c", F.lit(1), F.floor(F.size("c") / 2).cast("int")))
    cols = tk.pair_truncate("p", "c", "r", 96, 32)
    names = ("prompt_ids", "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")
    return t.select("example_id", *[ints_text(c).alias(n) for c, n in zip(cols, names, strict=True)])


# T7 ------------------------------------------------------------------------
_T7 = [
    _TB,
    ("s1", "SELECT example_id, p, list_transform(range(CAST(ceil(len(c) / 16.0) AS BIGINT)), lambda k: list_concat(list_slice(c, k * 16 + 1, k * 16 + 16), [3])) AS st, "
           "list_transform(range(CAST(ceil(len(c) / 16.0) AS BIGINT)), lambda k: CASE WHEN k % 3 <> 2 THEN 1 ELSE 0 END) AS lb FROM tb"),
    ("s2", f"SELECT example_id, {_keep_end_sql('list_concat([1], p)', 64)} AS pp, "
           f"{_keep_start_sql('flatten(st)', 96)} AS cc, "
           f"{_keep_start_sql('flatten(list_transform(list_zip(st, lb), lambda z: list_concat(list_transform(range(len(z[1]) - 1), lambda x: -100), [z[2]])))', 96)} AS cl FROM s1"),
]


@register("stepwise_encode", tok_sql(
    f"SELECT example_id, {_txt(_keep_start_sql('list_concat(pp, cc)', 128))} AS input_ids, "
    f"{_txt(_keep_start_sql('list_concat(list_transform(pp, lambda x: -100), cl)', 128))} AS labels FROM s2", _T7))
def stepwise_encode(spark, d):
    """Stepwise encoding - completion split into 16-token steps, separator
    id 3 after each, the step label on its last token, BOS prompt keeping its
    last 64 ids, completion 96 and row 128 keeping their start."""
    t = _tb(spark, d)
    n = F.ceil(F.size("c") / 16.0).cast("int")
    ks = F.sequence(F.lit(0), n - 1)
    steps = F.when(n > 0, F.transform(ks, lambda k: F.slice("c", k * 16 + 1, 16))).otherwise(F.array().cast("array<array<int>>"))
    labels = F.when(n > 0, F.transform(ks, lambda k: k % 3 != 2)).otherwise(F.array().cast("array<boolean>"))
    cols = tk.stepwise_encode("p", steps, labels, [3], bos=1, max_prompt_length=64, max_completion_length=96, max_length=128)
    return t.select("example_id", ints_text(cols[0]).alias("input_ids"), ints_text(cols[1]).alias("labels"))


# T8 / T9 -------------------------------------------------------------------
@register("reward_pair_encode", tok_sql(
    "SELECT example_id, CAST(len(p) + len(c) AS INTEGER) AS chosen_len FROM tb WHERE len(p) + len(c) <= 1024", [_TB]))
def reward_pair_encode(spark, d):
    """T8 + P16: reward pairs with the prompt prepended to both sides; pairs
    with either side over 1024 ids are dropped."""
    t = _tb(spark, d).select("example_id", F.concat("p", "c").alias("chosen_ids"), F.concat("p", F.reverse("c")).alias("rejected_ids"))
    from ..operators.formats import filter_token_lengths

    kept = filter_token_lengths(t, 1024, ["chosen_ids", "rejected_ids"])
    return kept.select("example_id", F.size("chosen_ids").alias("chosen_len"))


_T9 = [
    _TB,
    ("k1", f"""SELECT example_id, p, c, CASE WHEN len(p) + len(c) > 128 AND len(c) >= 128 THEN {_keep_end_sql('c', 128)} ELSE c END AS c2 FROM tb"""),
    ("k2", f"""SELECT example_id, c2, CASE WHEN len(p) + len(c) > 128 AND len(c) >= 128 THEN []
                 WHEN len(p) + len(c) > 128 THEN CASE WHEN 128 - len(c2) > 0 THEN {_keep_end_sql('p', '128 - len(c2)')} ELSE [] END ELSE p END AS p2 FROM k1"""),
]


@register("chat_collate", tok_sql(
    "SELECT example_id, array_to_string(list_concat(p2, c2), ' ') AS input_ids, "
    "array_to_string(list_transform(list_concat(p2, c2), lambda x, i: CASE WHEN i <= len(p2) THEN -100 ELSE x END), ' ') AS labels, "
    "CAST(len(p2) AS INTEGER) AS prompt_len FROM k2", _T9))
def chat_collate(spark, d):
    """Chat collation at 128 ids - the completion keeps its end, the prompt
    keeps what still fits; prompt labels ignored."""
    t = _tb(spark, d)
    cols = tk.chat_collate_truncate("p", "c", 128)
    return t.select("example_id", ints_text(cols[0]).alias("input_ids"), ints_text(cols[1]).alias("labels"), cols[2])


# T3 ------------------------------------------------------------------------
_CHUNK = "'<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)"


@register("assistant_mask", with_views(
    f"""SELECT example_id, mask, CAST(length(replace(mask, '0', '')) AS INTEGER) AS n_assistant FROM (
          SELECT example_id, array_to_string(list_transform(messages, lambda m: repeat(CASE WHEN m.role = 'assistant' THEN '1' ELSE '0' END,
                 len(regexp_extract_all({_CHUNK}, '{TOKEN_RE}')))), '') AS mask FROM msgs)
        WHERE strpos(mask, '1') > 0""", "msgs"))
def assistant_mask(spark, d):
    """One flag per token of the rendered conversation, 1 on assistant
    tokens; conversations without any assistant token are rejected."""
    m = vw.msgs(spark, d)
    chunk = F.transform("messages", lambda x: F.size(tk.split_tokens(F.concat(F.lit(tx.CHATML_BOS), x["role"], F.lit("\n"), x["content"], F.lit(tx.CHATML_EOS + "\n")))))
    out = m.select("example_id", tk.assistant_mask("messages", chunk).alias("m"))
    out = out.filter(F.exists("m", lambda x: x == 1))
    return out.select("example_id", F.array_join(F.transform("m", lambda x: x.cast("string")), "").alias("mask"),
                      F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("n_assistant"))
