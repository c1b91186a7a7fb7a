"""Dropping lines whose template recurs across documents (operator 6).

A fixed-depth tree parses lines: first by the number of tokens, then by the
leading ``depth`` tokens, one with a digit counting as a variable field. Within a
leaf, a token that at least ``min_docs`` (document, line) pairs have at its place is
constant, others are variable fields (``<*>``); the line with its variables
generalised is its template. Lines are dropped when at least ``min_docs`` documents
hold their template and at least ``constant_share`` of its tokens are constant.
The result doesn't depend on the order of lines, so the tree needs no single parser.

Only lines of leaves that enough documents share go on past the tree; tokens are
counted on different lines with their number of documents as weight, and every
count is pre-aggregated. Frequent leaves, lines and templates meet their rows in
joins whose large keys Spark can split. What is gathered in one row (a line's
tokens, a document's line numbers) is part of one document.

Defined cases: null texts have no lines and stay null; lines of white space only
are no lines for the tree and always stay; rows that repeat a text under one id
count as one document and get the same result; extra columns are kept; columns
named n_lines, n_dropped or kept are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

VARIABLE = "<*>"
_SPACE = "[\\x20\\x09-\\x0D]+"


def _tokens(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\x0b\x0c\r")), _SPACE)


def _has_digit(token: Column) -> Column:
    return token.rlike("[0-9]")


def recurring_lines(docs: DataFrame, scratch: Scratch, *, text_column: str = "text", uid: Column, depth: int = 3, min_docs: int = 8, constant_share: float = 0.5) -> DataFrame:
    """(uid, line_no): the lines to drop."""
    lines = (
        docs.select(uid.alias("uid"), F.posexplode(F.split(text_column, "\n")).alias("line_no", "line"))
        .where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "")
        .withColumn("tokens", _tokens(F.col("line")))
        .withColumn("leaf", F.md5(F.concat_ws("\n", F.size("tokens").cast("string"), F.transform(F.slice("tokens", 1, depth), lambda t: F.when(_has_digit(t), VARIABLE).otherwise(t)))))
    )
    leaves = scratch.save(lines.select("leaf", "uid").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
    known = scratch.save(lines.join(leaves, "leaf", "left_semi").select("uid", "line_no", "leaf", F.md5("line").alias("id"), "line"))
    different = scratch.save(known.select("id", "leaf", "line", "uid").distinct().groupBy("id", "leaf").agg(F.any_value("line").alias("line"), F.count("*").alias("docs")))
    places = different.select("id", "leaf", "docs", F.posexplode(_tokens(F.col("line"))).alias("place", "token"))
    later = places.where(F.col("place") >= depth)
    constant = scratch.save(
        later.where(~_has_digit(F.col("token"))).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("constant"))
    )
    marked = later.join(constant, ["leaf", "place", "token"], "left").select("id", "leaf", "place", "token", F.coalesce("constant", F.lit(False)).alias("constant"))
    lead = places.where(F.col("place") < depth).select("id", "leaf", "place", "token", (~_has_digit(F.col("token"))).alias("constant"))
    templates = (
        lead.unionByName(marked).groupBy("id", "leaf")
        .agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE).alias("word")))).alias("words"), F.avg(F.col("constant").cast("int")).alias("share"))
        .where(F.col("share") >= constant_share)
        .select("id", F.md5(F.concat_ws(" ", "leaf", F.col("words.word"))).alias("template"))
    )
    templates = scratch.save(templates)
    of = scratch.save(known.select("uid", "line_no", "id").join(templates, "id").select("uid", "line_no", "template"))
    recurring = scratch.save(of.select("template", "uid").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("template"))
    return of.join(recurring, "template", "left_semi").select("uid", "line_no")


def drop_recurring_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """``docs`` with n_lines, n_dropped and ``kept``, the text of the lines that stay."""
    scratch = Scratch(docs.sparkSession, "line-templates")
    docs = docs.drop("n_lines", "n_dropped", "kept")
    uid = F.xxhash64(F.col(id_column), F.col(text_column))
    gone = recurring_lines(docs, scratch, text_column=text_column, uid=uid, **parameters).distinct()
    gone = scratch.save(gone.groupBy("uid").agg(F.sort_array(F.collect_list("line_no")).alias("_gone")).withColumnRenamed("uid", "_uid"))
    lines = F.split(text_column, "\n")
    kept = F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)), "\n"))
    # both sides grow with the corpus: one plan at every size
    out = docs.withColumn("_uid", uid).hint("merge").join(gone, "_uid", "left")
    return out.withColumns({
        "n_lines": F.coalesce(F.when(F.col(text_column).isNull(), 0).otherwise(F.size(lines)), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")), F.lit(0)).cast("long"),
        "kept": kept,
    }).drop("_uid", "_gone")


ORACLE = """
WITH l AS (
  SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
), t AS (
  SELECT *, string_split_regex(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') AS tokens FROM l
  WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), p AS (
  SELECT *, len(tokens) AS n, list_transform(tokens[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS head FROM t
), leaves AS (SELECT n, head FROM p GROUP BY n, head HAVING count(DISTINCT doc_id) >= 8),
k AS (SELECT p.* FROM p JOIN leaves USING (n, head)),
d AS (SELECT line, any_value(tokens) AS tokens, any_value(n) AS n, any_value(head) AS head, count(DISTINCT doc_id) AS docs FROM k GROUP BY line),
w AS (SELECT line, n, head, docs, i AS place, tokens[i] AS token FROM d, unnest(range(1, n + 1)) AS u(i)),
c AS (SELECT n, head, place, token FROM w WHERE place > 3 AND NOT regexp_matches(token, '[0-9]') GROUP BY n, head, place, token HAVING sum(docs) >= 8),
m AS (
  SELECT w.line, w.n, w.head, w.place, w.token,
    CASE WHEN w.place <= 3 THEN NOT regexp_matches(w.token, '[0-9]') ELSE c.token IS NOT NULL END AS constant
  FROM w LEFT JOIN c ON w.n = c.n AND w.head = c.head AND w.place = c.place AND w.token = c.token
), g AS (
  SELECT line, any_value(n) AS n, any_value(head) AS head, list(CASE WHEN constant THEN token ELSE '<*>' END ORDER BY place) AS words
  FROM m GROUP BY line HAVING avg(constant::INT) >= 0.5
), r AS (SELECT g.n, g.head, g.words FROM k JOIN g USING (line) GROUP BY g.n, g.head, g.words HAVING count(DISTINCT k.doc_id) >= 8),
gone AS (SELECT DISTINCT g.line FROM g JOIN r USING (n, head, words)),
a AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.line) AS n_dropped,
    string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE gone.line IS NULL) AS kept
  FROM l LEFT JOIN gone USING (line) GROUP BY l.doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
"""
