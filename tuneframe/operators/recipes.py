"""Dataset recipes: raw feedback tables -> training formats.

Each recipe is one narrow pass of column expressions over its input rows
(or an explode of a row's own nested items). Rows the reference would stop
on with an exception are kept in the output with a ``reject_reason`` (NULL
for good rows) so one bad row never fails the job; ``valid(df)`` and
``rejects(df)`` split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .formats import normalize_roles
from .conversions import split_last_message
from ..sources.readers import parse_message_literal

# Fixed values --------------------------------------------------------------
HUMAN = "\n\nHuman: "
ASSISTANT = "\n\nAssistant: "
STEP_MARK = "ки"
STEP_MARK_1 = "ⶻ"
# prompts with a stray first annotation (the first label is dropped)
ANNOTATION_ERROR_PREFIXES = (
    "Mr. Rocky",
    "Parker",
    "What is the smallest positive",
    " The Myth",
    "Let $\\mathbf{a}$",
    "Find the arithmetic",
    "Determine an ordered pair",
    "Determine the ordered pair",
    "At the Quill and Scroll stationery",
    "Round to the nearest",
    r"Calculate $\sqrt{10p}",
    r"Simplify $\sqrt{28x}",
)
CNNDM_BATCHES = ["batch0_cnndm", "cnndm0", "cnndm2"]
REDDIT_BATCHES = [f"batch{i}" for i in range(3, 23)] + ["edit_b2_eval_test"]


def valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def _msg(role, content) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"))


def _last_index_of(s: Column, needle: str) -> Column:
    """0-based start of the last occurrence of ``needle`` in ``s`` (-1 if none)."""
    p = F.locate(needle[::-1], F.reverse(s))
    return F.when(p == 0, F.lit(-1)).otherwise(F.length(s) - p - F.lit(len(needle)) + 1)


# R1 ------------------------------------------------------------------------
def dialogue_pairs(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Two ``Human:/Assistant:`` transcripts sharing a start -> explicit
    preference rows (``prompt`` messages, one-message ``chosen``/``rejected``).

    The common start is rolled back to its last assistant marker; the prompt
    text is split into turns at each marker. A pair where one transcript is a
    strict prefix of the other is rejected (the reference's strict zip fails).
    """
    c, r = F.col(chosen), F.col(rejected)
    n = tx.common_prefix_len(c, r)
    common = F.left(c, n)
    strict_fail = (n == F.least(F.length(c), F.length(r))) & (F.length(c) != F.length(r))
    ends = common.endswith(ASSISTANT)
    last = _last_index_of(common, ASSISTANT)
    cut = F.when(last >= 0, F.left(common, last)).otherwise(F.left(common, F.greatest(F.length(common) - 1, F.lit(0))))
    prompt_text = F.when(ends, common).otherwise(F.concat(cut, F.lit(ASSISTANT)))
    out = df.withColumn("_tf_p", prompt_text)
    plen = F.length("_tf_p")
    chosen_line = F.substring(c, plen + 1, F.greatest(F.length(c), F.lit(1)))
    rejected_line = F.substring(r, plen + 1, F.greatest(F.length(r), F.lit(1)))
    body = F.left(F.col("_tf_p"), plen - F.lit(len(ASSISTANT)))
    pieces = F.split(body, "(?=\\n\\nAssistant: |\\n\\nHuman: )")
    turns = F.filter(pieces, lambda p: p.startswith(HUMAN) | p.startswith(ASSISTANT))
    prompt = F.transform(
        turns,
        lambda p: F.struct(
            F.when(p.startswith(HUMAN), F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
            F.when(p.startswith(HUMAN), F.substring(p, len(HUMAN) + 1, 1 << 30))
            .otherwise(F.substring(p, len(ASSISTANT) + 1, 1 << 30)).alias("content"),
        ),
    )
    # computed before the final projection: the new "chosen"/"rejected" must
    # not shadow the input columns for these expressions (lateral aliases)
    out = (
        out.withColumn("_tf_cl", chosen_line)
        .withColumn("_tf_rl", rejected_line)
        .withColumn("_tf_fail", strict_fail)
        .withColumn("_tf_prompt", prompt)
    )
    rest = [x for x in df.columns if x not in (chosen, rejected)]
    return out.select(
        *rest,
        F.col("_tf_prompt").alias("prompt"),
        F.array(_msg("assistant", F.col("_tf_cl"))).alias("chosen"),
        F.array(_msg("assistant", F.col("_tf_rl"))).alias("rejected"),
        F.when(F.col("_tf_fail"), F.lit("transcripts differ only in length")).alias("reject_reason"),
    )


# R2 ------------------------------------------------------------------------
def inline_steps(df: DataFrame, text: str = "input", label: str = "label") -> DataFrame:
    """R2: a solution with step markers and a label string holding ``+``/``-``
    at the marker positions -> stepwise supervision (prompt, completions,
    labels). The first step is recovered from the prompt (``Step 1:``,
    ``step 1:``, or the text after ``?``); prompts with a known stray
    annotation drop their first label; anything else is rejected."""
    inputs = F.replace(F.col(text), F.lit(STEP_MARK), F.lit(STEP_MARK_1))
    parts = F.split(inputs, STEP_MARK_1)  # p0, p1, ..., pk (k markers)
    k = F.size(parts) - 1
    # 0-based marker positions: sum of the lengths of the preceding pieces plus the markers before
    lens = F.transform(parts, lambda p: F.length(p))
    pos = F.transform(
        F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))),
        lambda j: F.aggregate(F.slice(lens, 1, j + 1), F.lit(0), lambda a, x: a + x) + j,
    )
    pos = F.when(k > 0, pos).otherwise(F.array().cast("array<int>"))
    marks = F.transform(pos, lambda p: F.substring(F.col(label), p + 1, 1))
    bad_marks = F.exists(marks, lambda m: ~m.isin("+", "-"))
    labels = F.transform(marks, lambda m: m == "+")
    prompt0 = F.element_at(parts, 1)
    comps = F.transform(F.slice(parts, 2, F.greatest(k - 1, F.lit(0))), lambda p: tx.py_strip(p))
    comps = F.when(k >= 1, comps).otherwise(F.array().cast("array<string>"))
    stray = F.lit(False)
    for pre in ANNOTATION_ERROR_PREFIXES:
        stray = stray | prompt0.startswith(pre)

    def split_on(sep: str, keep_sep_in_prompt: bool):
        n_sep = F.size(F.split(prompt0, _re_quote(sep))) - 1
        before = F.substring_index(prompt0, sep, 1)
        after = F.substring_index(prompt0, sep, -1)
        first = tx.py_strip(after if keep_sep_in_prompt else F.concat(F.lit(sep), after))
        p = F.concat(before, F.lit(sep)) if keep_sep_in_prompt else before
        return n_sep, p, first

    n1, p1, f1 = split_on("Step 1:", False)
    n2, p2, f2 = split_on("step 1:", False)
    n3, p3, f3 = split_on("?", True)
    has1, has2, has3 = prompt0.contains("Step 1:"), prompt0.contains("step 1:"), prompt0.contains("?")
    prompt = F.when(stray, prompt0).when(has1, p1).when(has2, p2).when(has3, p3)
    completions = F.when(stray, comps).when(has1, F.concat(F.array(f1), comps)).when(has2, F.concat(F.array(f2), comps)).when(
        has3, F.concat(F.array(f3), comps)
    )
    labels_out = F.when(stray, F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))).otherwise(labels)
    reason = (
        F.when(k == 0, F.lit("no step markers"))
        .when(bad_marks, F.lit("label is not + or - at a step marker"))
        .when(~(stray | has1 | has2 | has3), F.lit("prompt can't be processed"))
        .when(~stray & has1 & (n1 != 1), F.lit("prompt has more than one 'Step 1:'"))
        .when(~stray & ~has1 & has2 & (n2 != 1), F.lit("prompt has more than one 'step 1:'"))
        .when(~stray & ~has1 & ~has2 & has3 & (n3 != 1), F.lit("prompt has more than one '?'"))
        .when(F.size(completions) != F.size(labels_out), F.lit("completions and labels differ in length"))
    )
    rest = [x for x in df.columns if x not in (text, label)]
    return df.select(
        *rest,
        tx.py_strip(prompt).alias("prompt"),
        completions.alias("completions"),
        labels_out.alias("labels"),
        reason.alias("reject_reason"),
    )


def _re_quote(s: str) -> str:
    import re

    return re.escape(s)


# R3 ------------------------------------------------------------------------
def step_tree(df: DataFrame, problem: Column | str = "question.problem", steps: Column | str = "label.steps") -> DataFrame:
    """A graded step tree -> stepwise rows. Every non-chosen alternative
    of a step ends a trajectory (prefix of chosen steps + the alternative);
    the chosen (or human) completion extends the prefix; the walk stops at a
    step without any data or without a chosen/human completion (after
    emitting that step's alternatives). The final prefix is one more row."""
    st = F.col(steps) if isinstance(steps, str) else steps
    pr = F.col(problem) if isinstance(problem, str) else problem

    def is_empty(s):
        return s["completions"].isNull() & s["human_completion"].isNull() & s["chosen_completion"].isNull()

    def no_pick(s):
        return s["chosen_completion"].isNull() & s["human_completion"].isNull()

    base = df.select(pr.alias("prompt"), st.alias("_tf_steps"))
    stop_flags = F.transform("_tf_steps", lambda s: is_empty(s) | no_pick(s))
    b = F.array_position(stop_flags, True)  # 1-based, 0 = none
    nsteps = F.size("_tf_steps")
    b0 = F.when(b == 0, nsteps).otherwise(b - 1)  # 0-based first stopping step (or n)
    picked_text = F.transform(
        "_tf_steps",
        lambda s: F.when(s["chosen_completion"].isNotNull(), F.element_at(s["completions"], s["chosen_completion"] + 1)["text"]).otherwise(
            s["human_completion"]["text"]
        ),
    )
    picked_label = F.transform(
        "_tf_steps",
        lambda s: F.when(s["chosen_completion"].isNotNull(), F.element_at(s["completions"], s["chosen_completion"] + 1)["rating"] == 1).otherwise(
            F.lit(True)
        ),
    )
    rows = base.withColumn("_tf_b", b0).withColumn("_tf_pt", picked_text).withColumn("_tf_pl", picked_label)
    # terminal alternatives: steps 0.._b (step _b only when it has completions but no pick)
    alts = rows.select(
        "prompt", "_tf_pt", "_tf_pl", "_tf_b",
        F.posexplode("_tf_steps").alias("s", "step"),
    ).filter(
        (F.col("s") < F.col("_tf_b")) | ((F.col("s") == F.col("_tf_b")) & ~is_empty(F.col("step")))
    ).select(
        "prompt", "_tf_pt", "_tf_pl", "s", F.col("step.chosen_completion").alias("chosen"),
        F.posexplode_outer("step.completions").alias("ci", "comp"),
    ).filter(F.col("comp").isNotNull() & (F.col("chosen").isNull() | (F.col("ci") != F.col("chosen"))))
    terminal = alts.select(
        "prompt",
        F.concat(F.slice("_tf_pt", 1, F.col("s")), F.array(F.col("comp.text"))).alias("completions"),
        F.concat(F.slice("_tf_pl", 1, F.col("s")), F.array(F.col("comp.rating") == 1)).alias("labels"),
        F.col("s").alias("_tf_order"), F.col("ci").alias("_tf_ci"),
    )
    final = rows.select(
        "prompt",
        F.slice("_tf_pt", 1, F.col("_tf_b")).alias("completions"),
        F.slice("_tf_pl", 1, F.col("_tf_b")).alias("labels"),
        F.lit(1 << 30).alias("_tf_order"), F.lit(0).alias("_tf_ci"),
    )
    return terminal.unionByName(final).drop("_tf_order", "_tf_ci")


# R4 / R5 -------------------------------------------------------------------
def ratings_to_unpaired(df: DataFrame, model: str, aspect: str = "helpfulness", threshold: int = 5) -> DataFrame:
    """Rows that include ``model`` -> conversational unpaired preference:
    the model's response is the completion, label = rating >= threshold."""
    kept = df.filter(F.array_contains("models", model))
    idx = F.array_position("models", model)
    comp = F.element_at("completions", idx.cast("int"))
    rating = comp["annotations"][aspect]["Rating"].cast("int")
    rest = [c for c in df.columns if c not in ("instruction", "models", "completions")]
    return kept.select(
        *rest,
        F.array(_msg("user", F.col("instruction"))).alias("prompt"),
        F.array(_msg("assistant", comp["response"])).alias("completion"),
        (rating >= threshold).alias("label"),
    )


def instruction_prompts(df: DataFrame, max_chars: int = 512) -> DataFrame:
    """Instruction -> conversational prompt, prompts over ``max_chars`` dropped."""
    rest = [c for c in df.columns if c != "instruction"]
    return df.filter(F.length("instruction") <= max_chars).select(*rest, F.array(_msg("user", F.col("instruction"))).alias("prompt"))


# R6 ------------------------------------------------------------------------
def best_of_n(df: DataFrame, samples: list[str], best: str = "best", query: str = "query") -> DataFrame:
    """A best-of-n human choice -> preference: chosen = the best sample,
    rejected = the first sample different from it; rows whose samples are
    all equal are dropped."""
    arr = F.array(*[F.col(s) for s in samples])
    kept = df.filter(F.size(F.array_distinct(arr)) > 1)
    chosen = F.element_at(arr, F.col(best) + 1)
    rejected = F.filter(arr, lambda x: x != chosen)[0]
    rest = [c for c in df.columns if c not in (*samples, best, query)]
    return kept.select(*rest, tx.py_strip(F.col(query)).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


# R7 / R8 -------------------------------------------------------------------
def tldr_prompt(subreddit, title, post) -> Column:
    return F.concat(F.lit("SUBREDDIT: r/"), subreddit, F.lit("\n\nTITLE: "), title, F.lit("\n\nPOST: "), post, F.lit("\n\nTL;DR:"))


def posts_to_prompt_completion(df: DataFrame) -> DataFrame:
    """Post fields -> summary prompt; completion = space + summary."""
    rest = [c for c in df.columns if c not in ("subreddit", "title", "post", "summary")]
    return df.select(
        *rest,
        tldr_prompt(F.col("subreddit"), F.col("title"), F.col("post")).alias("prompt"),
        F.concat(F.lit(" "), F.col("summary")).alias("completion"),
    )


def comparisons_to_preference(df: DataFrame) -> DataFrame:
    """Comparison batches -> preference with a per-family prompt (news
    articles or forum posts, blank lines collapsed); unknown batch -> reject."""
    info = F.col("info")
    cnn = F.col("batch").isin(*CNNDM_BATCHES)
    reddit = F.col("batch").isin(*REDDIT_BATCHES)
    article = F.replace(info["article"], F.lit("\n\n"), F.lit("\n"))
    post = F.replace(info["post"], F.lit("\n\n"), F.lit("\n"))
    prompt = F.when(cnn, F.concat(F.lit("TITLE: "), info["title"], F.lit("\n\n"), article, F.lit("\n\nTL;DR:"))).when(
        reddit, tldr_prompt(info["subreddit"], info["title"], post)
    )
    chosen = F.element_at("summaries", F.col("choice") + 1)["text"]
    rejected = F.element_at("summaries", 2 - F.col("choice"))["text"]
    rest = [c for c in df.columns if c not in ("batch", "info", "choice", "summaries")]
    return df.select(
        *rest,
        prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"),
        F.when(~(cnn | reddit), F.concat(F.lit("Unknown batch: "), F.col("batch"))).alias("reject_reason"),
    )


# R9 / R10 ------------------------------------------------------------------
BLOCK = "struct<type:string,text:string>"


def image_question_pairs(df: DataFrame) -> DataFrame:
    """Image question + two answers -> multimodal conversational
    preference (image placeholder block + text block; image reference kept)."""
    img = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    txt = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    rest = [c for c in df.columns if c not in ("question", "image", "chosen", "rejected")]
    return df.select(
        *rest,
        F.array(F.struct(F.lit("user").alias("role"), F.array(img, txt("question")).alias("content"))).alias("prompt"),
        F.array(F.col("image")).alias("images"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.array(txt("chosen")).alias("content"))).alias("chosen"),
        F.array(F.struct(F.lit("assistant").alias("role"), F.array(txt("rejected")).alias("content"))).alias("rejected"),
    )


def image_conversations(df: DataFrame, max_chars: int = 1000) -> DataFrame:
    """Literal conversation strings -> parsed (S6) -> roles normalised
    and image tags stripped (P4) -> total content <= ``max_chars`` (P16) ->
    prompt/completion split (X6). A literal that does not parse and a message
    without content give a row with ``reject_reason``."""
    parsed = df.withColumn("_tf_conv", parse_message_literal("conversations"))
    msgs = parsed.withColumn(
        "messages",
        normalize_roles(F.transform("_tf_conv", lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content")))),
    )
    total = F.aggregate(F.transform("messages", lambda m: F.length(m["content"])), F.lit(0), lambda a, x: a + x)
    reason = F.when(F.col("_tf_conv").isNull(), F.lit("conversation literal does not parse")).when(
        F.exists("messages", lambda m: m["content"].isNull()), F.lit("message without content")
    )
    rest = [c for c in df.columns if c not in ("conversations",)]
    marked = msgs.withColumn("_tf_reason", reason).filter(F.col("_tf_reason").isNotNull() | (total <= max_chars))
    kept = marked.select(*rest, F.when(F.col("_tf_reason").isNull(), F.col("messages")).alias("messages"), "_tf_reason")
    split = split_last_message(kept.withColumn("images", F.array("image")).drop("image"))
    return split.withColumn("reject_reason", F.coalesce("_tf_reason", "reject_reason")).drop("_tf_reason")
