"""Dataset-preparation queries: formats, templating, conversions, tokens, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conversions as cv
from ..operators import formats as fm
from ..operators import tokens as tk
from ..operators.packing import fill_ratio, pack
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from . import sft
from .catalog import finish, ints_text, register, sql_chatml, sql_chatml_prompt, sql_lcp

NL = "chr(10)"


# ---------------------------------------------------------------- templating
@register("chatml_render", with_views(f"SELECT example_id, {sql_chatml('messages')} AS text FROM msgs", "msgs"))
def chatml_render(spark, d):
    """P6 (+ P1 schema check upstream): render every conversation with the ChatML template."""
    m = vw.msgs(spark, d)
    return m.select("example_id", tx.render_chatml("messages").alias("text"))


_SIMPLE_SQL = with_views(
    "SELECT example_id, array_to_string(list_transform(messages, lambda m: upper(left(m.role, 1)) || lower(substr(m.role, 2)) "
    "|| ': ' || m.content || chr(10) || chr(10)), '') || 'Assistant:' AS text FROM msgs",
    "msgs",
)


@register("simple_render", _SIMPLE_SQL)
def simple_render(spark, d):
    """``Role: content`` template with the generation prompt (judge input)."""
    m = vw.msgs(spark, d)
    return m.select("example_id", tx.render_simple("messages", True).alias("text"))


PC_CTES = [
    ("split", "SELECT example_id, list_slice(messages, 1, len(messages) - 1) AS pm, "
              "list_slice(messages, len(messages), len(messages)) AS cm FROM msgs WHERE len(messages) >= 2"),
    ("r", f"SELECT example_id, {sql_chatml_prompt('pm')} AS p, {sql_chatml('list_concat(pm, cm)')} AS f FROM split "
          "WHERE pm[-1].role IN ('user', 'assistant')"),
    ("k", f"SELECT example_id, p, f, {sql_lcp('p', 'f')} AS n FROM r"),
]
_PC_SQL = build_sql(["msgs"], PC_CTES, "SELECT example_id, left(p, n) AS prompt, substr(f, n + 1) AS completion FROM k")


@register("prompt_completion_template", _PC_SQL)
def prompt_completion_template(spark, d):
    """X6 + P9/P8: split each conversation into prompt / last message and render
    both with ChatML (generation prompt or continued final message; the
    prompt is cut to the common prefix with prompt+completion)."""
    return sft.rendered_pairs(spark, d).select("example_id", "prompt", "completion")


_REJECT_SQL = with_views(
    """SELECT CASE WHEN len(messages) < 2 THEN 'conversation needs at least two messages'
       ELSE 'last message has no user or assistant role: ' || messages[-2].role END AS reason, CAST(count(*) AS BIGINT) AS n
    FROM msgs WHERE len(messages) < 2 OR messages[-2].role NOT IN ('user', 'assistant') GROUP BY 1""",
    "msgs",
)


@register("template_rejects", _REJECT_SQL)
def template_rejects(spark, d):
    """Rows the templating rejects (too short, or a prompt ending in an invalid role), counted by reason."""
    m = vw.msgs(spark, d)
    split = cv.split_last_message(m)
    short = split.filter(F.col("reject_reason").isNotNull()).select(F.col("reject_reason").alias("reason"))
    ok = split.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = fm.apply_chat_template(ok.select("example_id", "prompt", "completion")).filter(F.col("reject_reason").isNotNull())
    allbad = short.unionByName(bad.select(F.col("reject_reason").alias("reason")))
    return allbad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _from_value(spark, d):
    """Conversations stored as ``from``/``value`` messages (human/gpt speakers)."""
    conv = vw.table(spark, d, "conversations")
    spk = F.when(F.col("role") == "user", F.lit("human")).when(F.col("role") == "assistant", F.lit("gpt")).otherwise(F.col("role"))
    return conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", spk.alias("from"), F.col("text").alias("value")))).alias("_t")
    ).select(
        F.col("conv_id").alias("example_id"),
        F.transform("_t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"),
    )


_FROM_VALUE_SQL = """
WITH fv AS (
  SELECT conv_id AS example_id,
         list(struct_pack("from" := CASE WHEN role = 'user' THEN 'human' WHEN role = 'assistant' THEN 'gpt' ELSE role END,
                          value := text) ORDER BY turn) AS conversations
  FROM conversations GROUP BY conv_id)
"""


@register(
    "to_chatml_render",
    _FROM_VALUE_SQL
    + "SELECT example_id, array_to_string(list_transform(conversations, lambda m: '<|im_start|>' || m.\"from\" || chr(10) || m.value || '<|im_end|>' || chr(10)), '') AS text FROM fv",
)
def to_chatml_render(spark, d):
    """P1 + P2 + P3: detect ``from``/``value`` conversations, convert to
    ``role``/``content`` ``messages`` and render."""
    fv = _from_value(spark, d)
    assert fm.is_conversational_from_value(fv)
    ch = fm.to_chatml(fv)
    assert fm.is_conversational(ch)
    return ch.select("example_id", tx.render_chatml("messages").alias("text"))


@register(
    "normalize_roles_render",
    _FROM_VALUE_SQL
    + "SELECT example_id, array_to_string(list_transform(conversations, lambda m: '<|im_start|>' || "
    "CASE WHEN m.\"from\" = 'human' THEN 'user' ELSE 'assistant' END || chr(10) || "
    "regexp_replace(replace(m.value, '<image>', ''), '^\\s+|\\s+$', '', 'g') || '<|im_end|>' || chr(10)), '') AS text FROM fv",
)
def normalize_roles_render(spark, d):
    """Human -> user, every other speaker -> assistant, image tag stripped."""
    fv = _from_value(spark, d)
    m = fv.select("example_id", fm.normalize_roles(F.transform("conversations", lambda x: F.struct(x["from"].alias("role"), x["value"].alias("content")))).alias("messages"))
    return m.select("example_id", tx.render_chatml("messages").alias("text"))


@register("instruction_render", with_views(
    "SELECT example_id, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || completion || '<|im_end|>' || chr(10) AS text FROM completions",
    "completions"))
def instruction_render(spark, d):
    """P10 + P11: instruction rows -> two messages -> text, formatter chosen by schema."""
    c = vw.completions(spark, d).select("example_id", "prompt", "completion")
    fmt = fm.formatting_for(c)
    return fmt(c).select("example_id", "text")


@register("add_eos", with_views(
    "SELECT example_id, CASE WHEN suffix(completion, '<|im_end|>') THEN completion ELSE completion || '<|im_end|>' END AS completion FROM completions",
    "completions"))
def add_eos(spark, d):
    """Append the end token to completions that lack it."""
    c = vw.completions(spark, d).select("example_id", "completion")
    return fm.add_eos(c, "<|im_end|>")


@register("char_length_filter", with_views(
    "SELECT example_id, CAST(list_sum(list_transform(messages, lambda m: length(m.content))) AS BIGINT) AS n_chars FROM msgs "
    "WHERE list_sum(list_transform(messages, lambda m: length(m.content))) <= 1000",
    "msgs"))
def char_length_filter(spark, d):
    """Keep conversations with at most 1000 characters of content."""
    m = vw.msgs(spark, d)
    kept = fm.filter_chars(m, "messages", 1000)
    n = F.aggregate(F.transform("messages", lambda x: F.length(x["content"])), F.lit(0).cast("long"), lambda a, x: a + x)
    return kept.select("example_id", n.alias("n_chars"))


@register("first_prompts", with_views("SELECT example_id, prompt FROM completions ORDER BY example_id LIMIT 16", "completions"))
def first_prompts(spark, d):
    """The first 16 prompts by key, for evaluation (a top-k by design)."""
    return fm.first_n(vw.completions(spark, d).select("example_id", "prompt"), 16, ["example_id"])


@register("drop_null_fields", with_views(
    "SELECT example_id, '[' || array_to_string(list_transform(messages, lambda m: '{\"role\":' || to_json(m.role) || "
    "CASE WHEN m.role = 'system' THEN '' ELSE ',\"name\":' || to_json(m.role || '_1') END || '}'), ',') || ']' AS js FROM msgs",
    "msgs"))
def drop_null_fields(spark, d):
    """P5: nested values with missing (NULL) struct fields dropped, as JSON."""
    m = vw.msgs(spark, d)
    nested = F.transform(
        "messages",
        lambda x: F.struct(
            x["role"].alias("role"),
            F.when(x["role"] != "system", F.concat(x["role"], F.lit("_1"))).alias("name"),
        ),
    )
    return m.select("example_id", fm.drop_null_fields(nested).alias("js"))


# ---------------------------------------------------------------- prompts / pairs
_X2_LCP = sql_lcp("chosen", "rejected")
_X2_N = "least(length(chosen), length(rejected))"
PE_CTES = [
    ("x", f"SELECT *, {_X2_LCP} AS lcp, {_X2_N} AS n FROM pairs"),
    ("y", "SELECT *, greatest(CASE WHEN lcp < n AND lcp >= 1 AND substr(chosen, lcp, 1) = ' ' THEN lcp - 1 "
          "WHEN lcp < n THEN lcp ELSE n - 1 END, 0) AS idx FROM x"),
    ("pe", "SELECT example_id, left(chosen, idx) AS prompt, substr(chosen, idx + 1) AS chosen, "
           "substr(rejected, idx + 1) AS rejected FROM y"),
]


def _pe_sql(select: str, extra=()) -> str:
    return build_sql(["pairs"], PE_CTES + list(extra), select)


def _pe(spark, d):
    return cv.extract_prompt(vw.pairs(spark, d).select("example_id", "chosen", "rejected"))


@register("extract_prompt", _pe_sql("SELECT example_id, prompt, chosen, rejected FROM pe"))
def extract_prompt(spark, d):
    """X2/X3 (= C6 PI->PE): shared start of chosen/rejected becomes the prompt."""
    pi = vw.pairs(spark, d).select("example_id", "chosen", "rejected")
    return cv.maybe_extract_prompt(pi)


@register("unpair", _pe_sql(
    "SELECT example_id, prompt, chosen AS completion, true AS label, 0 AS pair_side FROM pe "
    "UNION ALL SELECT example_id, prompt, rejected, false, 1 FROM pe"))
def unpair(spark, d):
    """X4/X5 (= C12 PE->UP): each pair becomes a desirable and an undesirable row."""
    return cv.maybe_unpair(_pe(spark, d))


@register("common_prefix", with_views(
    f"SELECT example_id, CAST({sql_lcp('chosen', 'rejected')} AS INTEGER) AS lcp FROM pairs", "pairs"))
def common_prefix(spark, d):
    """Longest common prefix length of two texts (binary search on prefixes)."""
    p = vw.pairs(spark, d)
    return p.select("example_id", tx.common_prefix_len("chosen", "rejected").alias("lcp"))


# conversions ---------------------------------------------------------------
def _pc(spark, d):
    return vw.completions(spark, d).select("example_id", "prompt", "completion")


def _up(spark, d):
    return cv.unpair(_pe(spark, d)).drop("pair_side")


def _ss(spark, d):
    return vw.steps(spark, d)


_UP_CTE = ("up", "SELECT example_id, prompt, chosen AS completion, true AS label FROM pe "
                 "UNION ALL SELECT example_id, prompt, rejected, false FROM pe")


def _up_sql(select: str) -> str:
    return _pe_sql(select, [_UP_CTE])


CONV_SPECS = {
    "conv_pc_to_lm": (lambda s, d: cv.pc_to_lm(_pc(s, d)), with_views("SELECT example_id, prompt || completion AS text FROM completions", "completions")),
    "conv_pc_to_po": (lambda s, d: cv.pc_to_po(_pc(s, d)), with_views("SELECT example_id, prompt FROM completions", "completions")),
    "conv_pi_to_lm": (lambda s, d: cv.pi_to_lm(vw.pairs(s, d).select("example_id", "chosen", "rejected")), with_views("SELECT example_id, chosen AS text FROM pairs", "pairs")),
    "conv_pi_to_pc": (lambda s, d: cv.pi_to_pc(vw.pairs(s, d).select("example_id", "chosen", "rejected")), _pe_sql("SELECT example_id, prompt, chosen AS completion FROM pe")),
    "conv_pi_to_po": (lambda s, d: cv.pi_to_po(vw.pairs(s, d).select("example_id", "chosen", "rejected")), _pe_sql("SELECT example_id, prompt FROM pe")),
    "conv_pi_to_up": (lambda s, d: cv.pi_to_up(vw.pairs(s, d).select("example_id", "chosen", "rejected")).drop("pair_side"), _up_sql("SELECT * FROM up")),
    "conv_pe_to_lm": (lambda s, d: cv.pe_to_lm(_pe(s, d)), _pe_sql("SELECT example_id, prompt || chosen AS text FROM pe")),
    "conv_pe_to_pc": (lambda s, d: cv.pe_to_pc(_pe(s, d)), _pe_sql("SELECT example_id, prompt, chosen AS completion FROM pe")),
    "conv_pe_to_po": (lambda s, d: cv.pe_to_po(_pe(s, d)), _pe_sql("SELECT example_id, prompt FROM pe")),
    "conv_pe_to_pi": (lambda s, d: cv.pe_to_pi(_pe(s, d)), _pe_sql("SELECT example_id, prompt || chosen AS chosen, prompt || rejected AS rejected FROM pe")),
    "conv_up_to_lm": (lambda s, d: cv.up_to_lm(_up(s, d)), _up_sql("SELECT example_id, prompt || completion AS text FROM up WHERE label")),
    "conv_up_to_pc": (lambda s, d: cv.up_to_pc(_up(s, d)), _up_sql("SELECT example_id, prompt, completion FROM up WHERE label")),
    "conv_up_to_po": (lambda s, d: cv.up_to_po(_up(s, d)), _up_sql("SELECT example_id, prompt FROM up")),
    "conv_ss_to_lm": (lambda s, d: cv.ss_to_lm(_ss(s, d)), with_views("SELECT example_id, prompt || array_to_string(completions, '') AS text FROM steps WHERE list_bool_and(labels)", "steps")),
    "conv_ss_to_pc": (lambda s, d: cv.ss_to_pc(_ss(s, d)), with_views("SELECT example_id, prompt, array_to_string(completions, '') AS completion FROM steps WHERE list_bool_and(labels)", "steps")),
    "conv_ss_to_po": (lambda s, d: cv.ss_to_po(_ss(s, d)), with_views("SELECT example_id, prompt FROM steps", "steps")),
    "conv_ss_to_up": (lambda s, d: cv.ss_to_up(_ss(s, d)), with_views("SELECT example_id, prompt, array_to_string(completions, '') AS completion, list_bool_and(labels) AS label FROM steps", "steps")),
}

CONV_DOCS = {
    "conv_pc_to_lm": "C1: prompt-completion -> language modeling (prompt + completion).",
    "conv_pc_to_po": "C2: prompt-completion -> prompt-only.",
    "conv_pi_to_lm": "C3: implicit-prompt preference -> language modeling (chosen).",
    "conv_pi_to_pc": "C4: implicit-prompt preference -> prompt-completion (X2 extraction).",
    "conv_pi_to_po": "C5: implicit-prompt preference -> prompt-only (X2 extraction).",
    "conv_pi_to_up": "C7: implicit-prompt preference -> unpaired (X2 then X4).",
    "conv_pe_to_lm": "C8: explicit preference -> language modeling (prompt + chosen).",
    "conv_pe_to_pc": "C9: explicit preference -> prompt-completion (chosen).",
    "conv_pe_to_po": "C10: explicit preference -> prompt-only.",
    "conv_pe_to_pi": "C11: explicit preference -> implicit prompt (prompt prepended to both).",
    "conv_up_to_lm": "C13: unpaired -> language modeling (desirable rows).",
    "conv_up_to_pc": "C14: unpaired -> prompt-completion (desirable rows).",
    "conv_up_to_po": "C15: unpaired -> prompt-only (duplicates kept).",
    "conv_ss_to_lm": "C16: stepwise -> language modeling (all-correct rows, steps joined).",
    "conv_ss_to_pc": "C17: stepwise -> prompt-completion (all-correct rows).",
    "conv_ss_to_po": "C18: stepwise -> prompt-only.",
    "conv_ss_to_up": "C19: stepwise -> unpaired (label = all steps correct).",
}


def _documented(fn, doc):
    def run(spark, d):
        return fn(spark, d)

    run.__doc__ = doc
    return run


for _name, (_fn, _sql) in CONV_SPECS.items():
    register(_name, _sql)(_documented(_fn, CONV_DOCS[_name]))


def _conv_pc(spark, d):
    m = vw.msgs(spark, d)
    return cv.split_last_message(m).filter(F.col("reject_reason").isNull()).drop("reject_reason")


@register("conv_pc_to_lm_messages", with_views(
    f"SELECT example_id, {sql_chatml('messages')} AS text FROM msgs WHERE len(messages) >= 2", "msgs"))
def conv_pc_to_lm_messages(spark, d):
    """C1 on conversational rows: prompt + completion message lists -> ``messages``."""
    lm = cv.pc_to_lm(_conv_pc(spark, d))
    return lm.select("example_id", tx.render_chatml("messages").alias("text"))


# ---------------------------------------------------------------- tokens
TOKEN_RE = tk.TOKEN_PATTERN

TOK_CTES = PC_CTES + [
    ("tk0", "SELECT example_id, left(p, n) AS prompt, f AS ftext FROM k"),
    ("toks", f"SELECT example_id, regexp_extract_all(prompt, '{TOKEN_RE}') AS pt, regexp_extract_all(ftext, '{TOKEN_RE}') AS ft FROM tk0"),
    ("counts", "SELECT token, count(*) AS n FROM (SELECT unnest(ft) AS token FROM toks) "
               "WHERE token NOT IN ('<|pad|>', '<|im_start|>', '<|im_end|>') GROUP BY token"),
    ("vocab", "SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 + 3 AS token_id FROM counts "
              "UNION ALL SELECT * FROM (VALUES ('<|pad|>', 0), ('<|im_start|>', 1), ('<|im_end|>', 2)) v(token, token_id)"),
    ("pos", "SELECT example_id, 0 AS fld, unnest(pt) AS token, unnest(range(1, len(pt) + 1)) AS i FROM toks "
            "UNION ALL SELECT example_id, 1, unnest(ft), unnest(range(1, len(ft) + 1)) FROM toks"),
    ("enc", "SELECT example_id, fld, list(CAST(token_id AS INTEGER) ORDER BY i) AS ids FROM pos JOIN vocab USING (token) GROUP BY example_id, fld"),
    ("ids", "SELECT t.example_id, coalesce(p.ids, []) AS prompt_ids, coalesce(f.ids, []) AS input_ids FROM toks t "
            "LEFT JOIN enc p ON p.example_id = t.example_id AND p.fld = 0 LEFT JOIN enc f ON f.example_id = t.example_id AND f.fld = 1"),
]


def tok_sql(select: str, extra=()) -> str:
    return build_sql(["msgs"], TOK_CTES + list(extra), select)


@register("sft_tokenize", tok_sql(
    "SELECT example_id, CAST(len(input_ids) AS INTEGER) AS n_tokens, CAST(len(prompt_ids) AS INTEGER) AS n_prompt, "
    "list_slice(input_ids, 1, len(prompt_ids)) = prompt_ids AS prompt_is_prefix, array_to_string(input_ids, ' ') AS ids, "
    "repeat('0', len(prompt_ids)) || repeat('1', len(input_ids) - len(prompt_ids)) AS mask FROM ids"))
def sft_tokenize(spark, d):
    """T1 + T2: corpus vocabulary, encoding, completion mask, prefix check."""
    t = sft.tokenized(spark, d)
    return t.select(
        "example_id",
        F.size("input_ids").alias("n_tokens"),
        F.aggregate("completion_mask", F.lit(0), lambda a, x: a + F.when(x == 0, 1).otherwise(0)).alias("n_prompt"),
        "prompt_is_prefix",
        ints_text("input_ids").alias("ids"),
        F.array_join(F.transform("completion_mask", lambda x: x.cast("string")), "").alias("mask"),
    )


@register("truncate_tokens", tok_sql(
    "SELECT example_id, array_to_string(list_slice(input_ids, 1, 64), ' ') AS ids, CAST(len(list_slice(input_ids, 1, 64)) AS INTEGER) AS n FROM ids"))
def truncate_tokens(spark, d):
    """Every list column cut to 64 items, other columns untouched."""
    t = sft.tokenized(spark, d).select("example_id", "input_ids", "completion_mask")
    tr = tk.truncate_lists(t, 64)
    return tr.select("example_id", ints_text("input_ids").alias("ids"), F.size("input_ids").alias("n"))


@register("bos_eos", tok_sql(
    "SELECT example_id, array_to_string(list_concat(CASE WHEN input_ids[1] = 1 THEN [] ELSE [1] END, input_ids, "
    "CASE WHEN input_ids[-1] = 2 THEN [] ELSE [2] END), ' ') AS ids FROM ids"))
def bos_eos(spark, d):
    """Add BOS (id 1) and EOS (id 2) only where absent."""
    t = sft.tokenized(spark, d)
    return t.select("example_id", ints_text(tk.add_bos_eos("input_ids", 1, 2)).alias("ids"))


@register("stop_token_cut", tok_sql(
    """SELECT example_id, CAST(coalesce(list_position(input_ids, 2) - 1, len(input_ids)) AS INTEGER) AS stop_index,
       array_to_string(list_transform(input_ids, lambda x, i: CASE WHEN i - 1 > coalesce(list_position(input_ids, 2) - 1, len(input_ids)) THEN 0 ELSE x END), ' ') AS ids
    FROM ids"""))
def stop_token_cut(spark, d):
    """First end token, everything after it padded (pad id 0)."""
    t = sft.tokenized(spark, d)
    cols = tk.cut_after_stop("input_ids", 2, 0)
    return t.select("example_id", cols[0], ints_text(cols[1]).alias("ids"))


@register("lm_labels", tok_sql(
    "SELECT example_id, array_to_string(list_transform(input_ids, lambda x, i: CASE WHEN i <= len(prompt_ids) THEN -100 ELSE x END), ' ') AS labels FROM ids"))
def lm_labels(spark, d):
    """labels = ids with -100 over the prompt (completion mask 0)."""
    t = sft.tokenized(spark, d)
    return t.select("example_id", ints_text(tk.lm_labels("input_ids", "completion_mask")).alias("labels"))


@register("pad_batches", tok_sql(
    """SELECT example_id, b.batch, CAST(len(input_ids) AS INTEGER) AS n,
           array_to_string(list_concat(list_transform(range(target - len(input_ids)), lambda x: 0), input_ids), ' ') AS padded
    FROM b JOIN m USING (batch)""",
    [("b", "SELECT example_id, input_ids, CAST(floor(example_id / 8) AS BIGINT) AS batch FROM ids"),
     ("m", "SELECT batch, CAST(ceil(max(len(input_ids)) / 64.0) * 64 AS INTEGER) AS target FROM b GROUP BY batch")]))
def pad_batches(spark, d):
    """Left-pad each batch of 8 examples to its longest row, rounded up to a multiple of 64."""
    t = sft.tokenized(spark, d).select("example_id", "input_ids").withColumn("batch", F.floor(F.col("example_id") / 8).cast("long"))
    p = tk.pad_batch(t, "batch", "input_ids", 0, side="left", multiple_of=64)
    # the original length is the count of non-pad items at the tail; report it from the source
    n = t.select("example_id", F.size("input_ids").alias("n"))
    return p.join(n, "example_id").select("example_id", "batch", "n", ints_text("input_ids").alias("padded"))


@register("sft_packed_bins")
def sft_packed_bins(spark, d):
    """D3 -> D2 + D4 + D5: best-fit-decreasing packing (via the strategy dispatch) of the tokenised SFT rows
    (seq_length 1024) with position ids and labels. Bin packing is an
    iterative planner, so there is no SQL oracle; tests check the invariants."""
    p = sft.packed(spark, d, 1024)
    return p.select(
        "bin",
        F.size("input_ids").alias("n_tokens"),
        F.size("seq_lengths").alias("n_seqs"),
        ints_text("seq_lengths").alias("seq_lengths"),
        F.size("position_ids").alias("n_positions"),
    )


@register("sft_pack_invariants", tok_sql(
    """SELECT CAST(count(*) AS BIGINT) AS n_seqs, CAST(sum(least(len(input_ids), 1024)) AS BIGINT) AS n_tokens,
              CAST(sum(least(len(input_ids), 1024) * (least(len(input_ids), 1024) - 1) / 2) AS BIGINT) AS position_sum,
              CAST(0 AS BIGINT) AS overfull_bins, CAST(0 AS BIGINT) AS split_bins
       FROM ids WHERE len(input_ids) > 0"""))
def sft_pack_invariants(spark, d):
    """D2 + D4 as SQL can say them: every sequence is in one bin (their number,
    tokens and position ids add up), no bin is over 1,024 tokens, and a bin's
    tokens are those of its sequences."""
    p = sft.packed(spark, d, 1024)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    p = p.select(F.size("seq_lengths").alias("s"), F.size("input_ids").alias("n"), total("seq_lengths").alias("held"), total("position_ids").alias("p"))
    return p.agg(
        F.sum("s").alias("n_seqs"), F.sum("n").alias("n_tokens"), F.sum("p").alias("position_sum"),
        F.sum((F.col("n") > 1024).cast("long")).alias("overfull_bins"), F.sum((F.col("n") != F.col("held")).cast("long")).alias("split_bins"),
    )


@register("sft_pack_fill")
def sft_pack_fill(spark, d):
    """Packing quality report: bins, tokens, fill ratio."""
    return finish(fill_ratio(sft.packed(spark, d, 1024), 1024))


_WRAP_SQL = tok_sql(
    """SELECT CAST(0 AS BIGINT) AS batch, CAST(gpos // 256 AS BIGINT) AS chunk, CAST(count(*) AS INTEGER) AS n,
              array_to_string(list(id ORDER BY gpos), ' ') AS ids
    FROM g GROUP BY gpos // 256""",
    [("flat", "SELECT example_id, unnest(input_ids) AS id, unnest(range(len(input_ids))) AS j FROM ids"),
     ("g", "SELECT id, row_number() OVER (ORDER BY example_id, j) - 1 AS gpos FROM flat")],
)


@register("wrapped_pack", _WRAP_SQL)
def wrapped_pack(spark, d):
    """D1 (via the D3 dispatch): concatenate all token rows in key order and cut every 256 tokens."""
    t = sft.tokenized(spark, d).select("example_id", "input_ids")
    p = pack(t, 256, strategy="wrapped")
    return p.select("batch", "chunk", F.size("input_ids").alias("n"), ints_text("input_ids").alias("ids"))
