"""Multimodal message blocks.

Images stay references (URI / content hash strings); bytes live in a side
table. All work is per-row array expressions over the message list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_FIELDS = "struct<type:string,text:string,image:string>"
ROLES = ("system", "user", "assistant")


def _block(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (text if text is not None else F.lit(None).cast("string")).alias("text"),
        (image if image is not None else F.lit(None).cast("string")).alias("image"),
    )


def prepare_multimodal(df: DataFrame, messages: str = "messages", images: str = "images") -> DataFrame:
    """String contents become text blocks; one image placeholder per
    image goes before the text of the first user message; placeholders are
    bound to the image references in order. A role outside system/user/
    assistant, or images without a user message to hold them, is rejected
    (``reject_reason``)."""
    m, imgs = F.col(messages), F.col(images)
    first_user = F.array_position(F.transform(m, lambda x: x["role"] == "user"), True)  # 1-based, 0 = none
    n_img = F.coalesce(F.size(imgs), F.lit(0))

    def blocks(x, i):
        text = F.array(_block("text", x["content"]))
        with_images = F.concat(F.transform(F.coalesce(imgs, F.array().cast("array<string>")), lambda u: _block("image", image=u)), text)
        return F.when((x["role"] == "user") & (i + 1 == first_user), with_images).otherwise(text)

    prepared = F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), blocks(x, i).alias("content")))
    bad_role = F.exists(m, lambda x: ~x["role"].isin(*ROLES))
    placeholders = F.when(first_user > 0, n_img).otherwise(F.lit(0))
    reason = F.when(bad_role, F.lit("message role is none of the known ones")).when(
        placeholders != n_img,
        F.concat(F.lit("images given ("), n_img.cast("string"), F.lit(") differ from placeholders ("),
                 placeholders.cast("string"), F.lit(")")),
    )
    rest = [c for c in df.columns if c != messages]
    return df.select(*rest, prepared.alias(messages), reason.alias("reject_reason"))


def bind_images(df: DataFrame, messages: str = "messages", images: str = "images") -> DataFrame:
    """P13 for already-structured contents: fill existing image placeholders
    with the image references in order; count mismatch is rejected."""
    m, imgs = F.col(messages), F.col(images)
    counts = F.transform(m, lambda x: F.size(F.filter(x["content"], lambda b: b["type"] == "image")))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)

    def fill(x, i):
        before = F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, c: a + c)

        def blk(b, j):
            k = before + F.size(F.filter(F.slice(x["content"], 1, j), lambda y: y["type"] == "image")) + 1
            return F.when(b["type"] == "image", F.struct(b["type"].alias("type"), b["text"].alias("text"), F.try_element_at(imgs, k).alias("image"))).otherwise(b)

        return F.struct(x["role"].alias("role"), F.transform(x["content"], blk).alias("content"))

    out = F.transform(m, fill)
    reason = F.when(total != F.coalesce(F.size(imgs), F.lit(0)), F.lit("image count does not match placeholders"))
    rest = [c for c in df.columns if c != messages]
    return df.select(*rest, out.alias(messages), reason.alias("reject_reason"))
