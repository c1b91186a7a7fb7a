"""Recipe queries (R1-R10). Each builds the recipe's raw input schema from
the test tables (stand-in rows only; no recipe work) and runs the recipe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import recipes as rc
from ..sources import views as vw
from ..sources.views import build_sql, with_views
from .catalog import bools_text, register, sql_chatml, sql_lcp

H, A = "chr(10) || chr(10) || 'Human: '", "chr(10) || chr(10) || 'Assistant: '"


# R1 ------------------------------------------------------------------------
def _transcripts(spark, d):
    conv = vw.table(spark, d, "conversations")
    mark = F.when(F.col("role") == "assistant", F.lit(rc.ASSISTANT)).otherwise(F.lit(rc.HUMAN))
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = conv.join(last, "conv_id").withColumn("piece", F.concat(mark, F.col("text")))
    g = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("all"),
        F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", "piece")))).alias("head"),
    )
    join = lambda col: F.array_join(F.transform(col, lambda x: x["piece"]), "")
    return g.select(
        F.col("conv_id").alias("example_id"),
        join(F.col("all")).alias("chosen"),
        F.concat(join(F.col("head")), F.lit(rc.ASSISTANT + "No.")).alias("rejected"),
    )


_TRANS_CTES = [
    ("cv", "SELECT c.*, max(turn) OVER (PARTITION BY conv_id) AS last, "
           f"CASE WHEN role = 'assistant' THEN {A} ELSE {H} END || text AS piece FROM conversations c"),
    ("tr", "SELECT conv_id AS example_id, string_agg(piece, '' ORDER BY turn) AS chosen, "
           f"coalesce(string_agg(CASE WHEN turn < last THEN piece END, '' ORDER BY turn), '') || {A} || 'No.' AS rejected FROM cv GROUP BY conv_id"),
    ("x1", f"SELECT *, {sql_lcp('chosen', 'rejected')} AS n FROM tr"),
    ("x2", "SELECT *, left(chosen, n) AS common, n = least(length(chosen), length(rejected)) AND length(chosen) <> length(rejected) AS strict_fail FROM x1"),
    ("x3", f"SELECT *, CASE WHEN strpos(reverse(common), reverse({A})) = 0 THEN -1 "
           f"ELSE length(common) - strpos(reverse(common), reverse({A})) - 13 + 1 END AS last_idx FROM x2"),
    ("x4", f"SELECT *, CASE WHEN suffix(common, {A}) THEN common ELSE (CASE WHEN last_idx >= 0 THEN left(common, last_idx) "
           f"ELSE left(common, greatest(length(common) - 1, 0)) END) || {A} END AS pt FROM x3"),
    ("x5", "SELECT example_id, strict_fail, substr(chosen, length(pt) + 1) AS cl, substr(rejected, length(pt) + 1) AS rl, "
           f"list_slice(string_split(replace(replace(left(pt, length(pt) - 13), {H}, chr(1) || 'H'), {A}, chr(1) || 'A'), chr(1)), 2, 1000000) AS pieces FROM x4"),
]


@register("dialogue_pairs", build_sql([], _TRANS_CTES,
    f"""SELECT example_id, {sql_chatml("list_transform(pieces, lambda p: {'role': CASE WHEN left(p, 1) = 'H' THEN 'user' ELSE 'assistant' END, 'content': substr(p, 2)})")} AS prompt,
           cl AS chosen, rl AS rejected, CASE WHEN strict_fail THEN 'transcripts differ only in length' END AS reject_reason FROM x5"""))
def dialogue_pairs(spark, d):
    """Human/Assistant transcript pairs -> conversational preference rows."""
    out = rc.dialogue_pairs(_transcripts(spark, d))
    return out.select(
        "example_id", tx.render_chatml("prompt").alias("prompt"),
        F.col("chosen")[0]["content"].alias("chosen"), F.col("rejected")[0]["content"].alias("rejected"), "reject_reason",
    )


# R2 ------------------------------------------------------------------------
def _shepherd(spark, d):
    s = vw.steps(spark, d)
    pr = F.col("prompt")
    head = (
        F.when(pr == "1-URGENT", F.concat(F.lit("What is "), pr, F.lit("? ")))
        .when(pr == "2-HIGH", F.concat(F.lit("Solve "), pr, F.lit(". ")))
        .when(pr == "3-MEDIUM", F.concat(F.lit("Parker asks "), pr, F.lit(". ")))
        .otherwise(F.concat(F.lit("Compute "), pr, F.lit(". ")))
    )

    def label_of(mark_fn):
        def f(x, i):
            tag = (
                F.when(pr.isin("1-URGENT", "5-LOW"), F.lit(""))
                .when(pr == "2-HIGH", F.concat(F.lit("step "), (i + 1).cast("string"), F.lit(": ")))
                .otherwise(F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": ")))
            )
            return F.concat(tag, x["c"], F.lit(" "), mark_fn(x["l"]))

        return F.array_join(F.transform(F.arrays_zip(F.col("completions").alias("c"), F.col("labels").alias("l")), f), "\n")

    inp = F.concat(head, label_of(lambda _l: F.lit(rc.STEP_MARK)))
    lab = F.concat(head, label_of(lambda l: F.when(l, F.lit("+")).otherwise(F.lit("-"))))
    return s.select("example_id", inp.alias("input"), lab.alias("label"))


@register("inline_steps", with_views(
    """SELECT example_id,
         CASE WHEN prompt = '5-LOW' THEN NULL
              WHEN prompt = '3-MEDIUM' THEN 'Parker asks ' || prompt || '. Step 1: ' || completions[1]
              WHEN prompt = '1-URGENT' THEN 'What is ' || prompt || '?'
              WHEN prompt = '2-HIGH' THEN 'Solve ' || prompt || '.' ELSE 'Compute ' || prompt || '.' END AS prompt,
         CASE WHEN prompt = '5-LOW' THEN NULL
              WHEN prompt = '3-MEDIUM' THEN array_to_string(list_transform(list_slice(completions, 2, len(completions)), lambda c, i: 'Step ' || (i + 1) || ': ' || c), '|')
              WHEN prompt = '1-URGENT' THEN array_to_string(completions, '|')
              WHEN prompt = '2-HIGH' THEN array_to_string(list_transform(completions, lambda c, i: 'step ' || i || ': ' || c), '|')
              ELSE array_to_string(list_transform(completions, lambda c, i: 'Step ' || i || ': ' || c), '|') END AS completions,
         CASE WHEN prompt = '5-LOW' THEN NULL
              WHEN prompt = '3-MEDIUM' THEN array_to_string(list_transform(list_slice(labels, 2, len(labels)), lambda l: CASE WHEN l THEN '1' ELSE '0' END), '')
              ELSE array_to_string(list_transform(labels, lambda l: CASE WHEN l THEN '1' ELSE '0' END), '') END AS labels,
         CASE WHEN prompt = '5-LOW' THEN 'prompt can''t be processed' END AS reject_reason
       FROM steps""", "steps"))
def inline_steps(spark, d):
    """R2: inline step markers + label string -> stepwise supervision."""
    out = rc.inline_steps(_shepherd(spark, d))
    ok = F.col("reject_reason").isNull()
    return out.select(
        "example_id",
        F.when(ok, F.col("prompt")).alias("prompt"),
        F.when(ok, F.array_join("completions", "|")).alias("completions"),
        F.when(ok, bools_text(F.col("labels"))).alias("labels"),
        "reject_reason",
    )


# R3 ------------------------------------------------------------------------
def _tree(spark, d):
    """Step trees from rollouts: one problem per order, one step per sample
    (in sample order); each step has the line's own completion (rating -1 for
    returned lines, else 1) and an alternative (rating 0); open lines choose
    their own completion, other lines with a discount >= 0.05 carry a human
    completion, the rest have no pick (the walk stops there)."""
    r = vw.rollouts(spark, d)
    comp = F.array(
        F.struct(F.concat(F.lit("part "), F.col("group_id").cast("string"), F.lit("-"), F.col("sample_no").cast("string")).alias("text"),
                 F.when(F.col("reward_b").isNull(), -1).otherwise(1).alias("rating")),
        F.struct(F.concat(F.lit("supp "), F.col("l_partkey").cast("string")).alias("text"), F.lit(0).alias("rating")),
    )
    chosen = F.when(F.col("truncated"), F.lit(0))
    human = F.when(~F.col("truncated") & (F.col("l_discount") >= 0.05), F.struct(F.lit("human step").alias("text")))
    step = F.struct(comp.alias("completions"), human.alias("human_completion"), chosen.cast("int").alias("chosen_completion"))
    g = r.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", step.alias("s")))).alias("_s"))
    return g.select(
        F.struct(F.concat(F.lit("problem "), F.col("group_id").cast("string")).alias("problem")).alias("question"),
        F.struct(F.transform("_s", lambda x: x["s"]).alias("steps")).alias("label"),
    )


_BOOLS = "array_to_string(list_transform({x}, lambda v: CASE WHEN v THEN '1' ELSE '0' END), '')"
_TREE_CTES = [
    ("st", "SELECT group_id, sample_no AS s, 'part ' || group_id || '-' || sample_no AS t0, CASE WHEN reward_b IS NULL THEN -1 ELSE 1 END AS r0, "
           "'supp ' || l_partkey AS t1, truncated AS has_chosen, (NOT truncated AND l_discount >= 0.05) AS has_human FROM rollouts"),
    ("b", "SELECT group_id, coalesce(min(s) FILTER (WHERE NOT has_chosen AND NOT has_human), max(s) + 1) AS b FROM st GROUP BY group_id"),
    ("pref", "SELECT group_id, list(CASE WHEN has_chosen THEN t0 ELSE 'human step' END ORDER BY s) AS pts, "
             "list(CASE WHEN has_chosen THEN r0 = 1 ELSE true END ORDER BY s) AS pls FROM st GROUP BY group_id"),
    ("alts", "SELECT st.group_id, st.s, st.t1 AS txt, false AS lab FROM st JOIN b USING (group_id) WHERE st.s <= b.b "
             "UNION ALL SELECT st.group_id, st.s, st.t0, st.r0 = 1 FROM st JOIN b USING (group_id) WHERE st.s <= b.b AND NOT st.has_chosen"),
]


@register("step_tree", build_sql(["rollouts"], _TREE_CTES,
    "SELECT 'problem ' || group_id AS prompt, array_to_string(list_concat(list_slice(pts, 1, s), [txt]), '|') AS completions, "
    + _BOOLS.format(x="list_concat(list_slice(pls, 1, s), [lab])") + " AS labels FROM alts JOIN pref USING (group_id) "
    "UNION ALL SELECT 'problem ' || group_id, array_to_string(list_slice(pts, 1, b), '|'), "
    + _BOOLS.format(x="list_slice(pls, 1, b)") + " FROM pref JOIN b USING (group_id)"))
def step_tree(spark, d):
    """Graded step trees -> stepwise rows (every non-chosen alternative
    ends a trajectory; the chosen or human completion extends the prefix;
    the walk stops at a step without a pick; the final prefix is one more row)."""
    out = rc.step_tree(_tree(spark, d))
    return out.select("prompt", F.array_join("completions", "|").alias("completions"), bools_text(F.col("labels")).alias("labels"))


# R4 / R5 -------------------------------------------------------------------
def _ratings(spark, d):
    r = vw.rollouts(spark, d)
    g = r.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", "l_partkey", "l_quantity"))).alias("_s"))
    return g.select(
        F.concat(F.lit("Order "), F.col("group_id").cast("string")).alias("instruction"),
        F.transform("_s", lambda x: F.concat(F.lit("m"), x["sample_no"].cast("string"))).alias("models"),
        F.transform("_s", lambda x: F.struct(
            F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("response"),
            F.create_map(F.lit("helpfulness"), F.struct((x["l_quantity"].cast("int") % 10).cast("string").alias("Rating"))).alias("annotations"),
        )).alias("completions"),
    )


@register("ratings_unpaired", with_views(
    "SELECT 'Order ' || group_id AS prompt, 'part ' || l_partkey AS completion, CAST(l_quantity AS INTEGER) % 10 >= 5 AS label "
    "FROM rollouts WHERE sample_no = 2", "rollouts"))
def ratings_unpaired(spark, d):
    """Multi-model ratings -> unpaired preference for model ``m2``."""
    out = rc.ratings_to_unpaired(_ratings(spark, d), "m2")
    return out.select(F.col("prompt")[0]["content"].alias("prompt"), F.col("completion")[0]["content"].alias("completion"), "label")


@register("instruction_prompts", """
SELECT text AS prompt FROM conversations WHERE turn = 0 AND length(text) <= 512""")
def instruction_prompts(spark, d):
    """Instructions -> conversational prompts, long ones dropped."""
    c = vw.table(spark, d, "conversations").filter(F.col("turn") == 0).select(F.col("text").alias("instruction"))
    return rc.instruction_prompts(c).select(F.col("prompt")[0]["content"].alias("prompt"))


# R6 ------------------------------------------------------------------------
def _best_of_four(spark, d):
    """Best-of-4 rows from orders: the four samples are the order's lines in
    sample order, repeated cyclically for orders with fewer than four lines
    (one-line orders give four equal samples, which the recipe drops)."""
    r = vw.rollouts(spark, d)
    g = r.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_no", F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("t")))).alias("_s"),
        F.min_by(F.col("l_quantity").cast("int") % 4, F.col("sample_no")).alias("best"),
    )
    n = F.size("_s")
    samples = [F.element_at("_s", (F.lit(i) % n) + 1)["t"].alias(f"sample{i}") for i in range(4)]
    return g.select(F.concat(F.lit("  query "), F.col("group_id").cast("string"), F.lit(" ")).alias("query"), *samples, "best")


@register("best_of_four", with_views(
    """SELECT prompt, s[best + 1] AS chosen, list_filter(s, lambda x: x <> s[best + 1])[1] AS rejected FROM (
         SELECT 'query ' || group_id AS prompt,
                list_transform(range(4), lambda i: l[(i % len(l)) + 1]) AS s, best
         FROM (SELECT group_id, list('part ' || (l_partkey % 50) ORDER BY sample_no) AS l,
                      arg_min(CAST(l_quantity AS INTEGER) % 4, sample_no) AS best
               FROM rollouts GROUP BY group_id))
       WHERE len(list_distinct(s)) > 1""", "rollouts"))
def best_of_four(spark, d):
    """Best-of-4 human choice -> preference (rows with four equal samples dropped)."""
    return rc.best_of_n(_best_of_four(spark, d), [f"sample{i}" for i in range(4)])


def four_samples(r):
    """Best-of-4 rows of groups of any size (``sample_no`` counts a group's
    ``t`` from 0): row b holds samples 4b to 4b + 3; a short last row goes on with
    the group's first samples, cyclically. ``pick`` of a row's first sample is the
    best one."""
    heads = r.groupBy("group_id").agg(
        (F.max("sample_no") + 1).alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("sample_no") < 3, F.struct("sample_no", "t")))).alias("_head"),
    )
    g = r.groupBy("group_id", F.floor(F.col("sample_no") / 4).alias("row_no")).agg(
        F.array_sort(F.collect_list(F.struct("sample_no", "t"))).alias("_s"),
        F.min_by("pick", "sample_no").alias("best"),
    ).join(heads, "group_id")
    own = F.size("_s")
    at = lambda i: F.when(F.lit(i) < own, F.get("_s", F.lit(i))["t"]).otherwise(
        F.get("_head", F.pmod(F.col("row_no") * 4 + i, F.col("_n")).cast("int"))["t"])
    return g.select("group_id", "row_no", F.concat(F.lit("  query "), F.col("group_id").cast("string"), F.lit(" ")).alias("query"),
                    *[at(i).alias(f"sample{i}") for i in range(4)], "best")


@register("best_of_four_all", with_views(
    """SELECT group_id, row_no, prompt, s[best + 1] AS chosen, list_filter(s, lambda x: x <> s[best + 1])[1] AS rejected FROM (
         SELECT group_id, b AS row_no, 'query ' || group_id AS prompt,
                list_transform(range(4), lambda i: l[((4 * b + i) % len(l)) + 1]) AS s, q[4 * b + 1] AS best
         FROM (SELECT group_id, l, q, unnest(range((len(l) + 3) // 4)) AS b
               FROM (SELECT group_id, list('part ' || (l_partkey % 50) ORDER BY sample_no) AS l,
                            list(CAST(l_quantity AS INTEGER) % 4 ORDER BY sample_no) AS q
                     FROM rollouts GROUP BY group_id)))
       WHERE len(list_distinct(s)) > 1""", "rollouts"))
def best_of_four_all(spark, d):
    """R6 with every sample of an order: one row for each four."""
    r = vw.rollouts(spark, d).select(
        "group_id", "sample_no", F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("t"),
        (F.col("l_quantity").cast("int") % 4).alias("pick"))
    out = rc.best_of_n(four_samples(r), [f"sample{i}" for i in range(4)])
    return out.select("group_id", "row_no", "prompt", "chosen", "rejected")


# R7 / R8 -------------------------------------------------------------------
@register("tldr_prompts", """
SELECT doc_id, 'SUBREDDIT: r/' || source || chr(10) || chr(10) || 'TITLE: ' || lang || chr(10) || chr(10) || 'POST: ' || text
       || chr(10) || chr(10) || 'TL;DR:' AS prompt, ' ' || text AS completion FROM documents""")
def tldr_prompts(spark, d):
    """Posts -> summary prompt / completion."""
    docs = vw.table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("subreddit"), F.col("lang").alias("title"), F.col("text").alias("post"),
        F.col("text").alias("summary"),
    )
    return rc.posts_to_prompt_completion(docs)


def _comparisons(spark, d):
    p = vw.pairs(spark, d)
    num = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    batch = F.when(num <= 2, F.element_at(F.array(*[F.lit(b) for b in rc.CNNDM_BATCHES]), num + 1)).when(
        num <= 18, F.concat(F.lit("batch"), (num + 1).cast("string"))
    ).otherwise(F.lit("unlisted"))
    info = F.struct(F.col("source").alias("title"), F.col("chosen").alias("article"), F.col("chosen").alias("post"),
                    F.lit("writing").alias("subreddit"))
    summaries = F.array(F.struct(F.col("chosen").alias("text")), F.struct(F.col("rejected").alias("text")))
    return p.select("example_id", batch.alias("batch"), (F.col("example_id") % 2).cast("int").alias("choice"),
                    info.alias("info"), summaries.alias("summaries"))


_NL2 = "chr(10) || chr(10)"


@register("tldr_preference", build_sql(["pairs"], [
    ("b", "SELECT *, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS num FROM pairs")],
    f"""SELECT example_id,
         CASE WHEN num <= 2 THEN 'TITLE: ' || source || {_NL2} || replace(chosen, {_NL2}, chr(10)) || {_NL2} || 'TL;DR:'
              WHEN num <= 18 THEN 'SUBREDDIT: r/writing' || {_NL2} || 'TITLE: ' || source || {_NL2} || 'POST: '
                   || replace(chosen, {_NL2}, chr(10)) || {_NL2} || 'TL;DR:' END AS prompt,
         CASE WHEN example_id % 2 = 0 THEN chosen ELSE rejected END AS chosen,
         CASE WHEN example_id % 2 = 0 THEN rejected ELSE chosen END AS rejected,
         CASE WHEN num > 18 THEN 'Unknown batch: unlisted' END AS reject_reason
       FROM b"""))
def tldr_preference(spark, d):
    """Comparison batches -> preference rows (unknown batch families rejected)."""
    return rc.comparisons_to_preference(_comparisons(spark, d))


# R9 / R10 ------------------------------------------------------------------
@register("image_pairs", """
SELECT page_id, '<|im_start|>user' || chr(10) || '[image]' || url || '<|im_end|>' || chr(10) AS prompt, 'page://' || page_id AS image,
       left(html, length(html) // 2) AS chosen, substr(html, length(html) // 2 + 1) AS rejected FROM pages""")
def image_pairs(spark, d):
    """Image question pairs -> multimodal conversational preference."""
    pg = vw.table(spark, d, "pages").select(
        "page_id", F.col("url").alias("question"), F.concat(F.lit("page://"), F.col("page_id").cast("string")).alias("image"),
        F.expr("left(html, length(html) div 2)").alias("chosen"), F.expr("substring(html, length(html) div 2 + 1)").alias("rejected"),
    )
    out = rc.image_question_pairs(pg)
    blocks = lambda m: F.array_join(F.transform(m["content"], lambda b: F.when(b["type"] == "image", F.lit("[image]")).otherwise(b["text"])), "")
    return out.select(
        "page_id",
        F.array_join(F.transform("prompt", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), blocks(m), F.lit("<|im_end|>\n"))), "").alias("prompt"),
        F.col("images")[0].alias("image"),
        F.col("chosen")[0]["content"][0]["text"].alias("chosen"),
        F.col("rejected")[0]["content"][0]["text"].alias("rejected"),
    )


def _llava(spark, d):
    conv = vw.table(spark, d, "conversations")
    spk = F.when(F.col("role") == "user", F.lit("human")).otherwise(F.lit("gpt"))
    val = F.when(F.col("turn") == 0, F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text"))
    item = F.concat(F.lit("{'from': '"), spk, F.lit("', 'value': "), F.to_json(F.struct(val.alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.lit(1 << 30)))
    g = conv.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("s")))).alias("_s"))
    return g.select(
        F.col("conv_id").alias("example_id"),
        F.concat(F.lit("["), F.array_join(F.transform("_s", lambda x: x["s"]), ", "), F.lit("]")).alias("conversations"),
        F.concat(F.lit("img://"), F.col("conv_id").cast("string")).alias("image"),
    )


_LLAVA_CTES = [
    ("m", "SELECT conv_id AS example_id, list(struct_pack(role := CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, "
          "content := regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id"),
]


@register("image_conversations", build_sql([], _LLAVA_CTES,
    f"""SELECT example_id, {sql_chatml('list_slice(messages, 1, len(messages) - 1)')} AS prompt,
           {sql_chatml('list_slice(messages, len(messages), len(messages))')} AS completion
       FROM m WHERE list_sum(list_transform(messages, lambda x: length(x.content))) <= 1000 AND len(messages) >= 2"""))
def image_conversations(spark, d):
    """Literal image conversations -> parsed, normalised, length-filtered
    prompt/completion rows (conversations of one message rejected)."""
    out = rc.image_conversations(_llava(spark, d))
    ok = out.filter(F.col("reject_reason").isNull())
    return ok.select("example_id", tx.render_chatml("prompt").alias("prompt"), tx.render_chatml("completion").alias("completion"))
