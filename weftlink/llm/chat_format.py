"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an ordered list of typed parts: text, image, audio or document. A visitor
turns every part into text: text parts are escaped, the other kinds become a placeholder such as
``<|image:1|>``, numbered by the part's place in its message. Attachments are recorded beside the
text with the number of tokens that each placeholder expands to later.

Template of one turn: ``<|turn|>ROLE<|body|>CONTENT<|end|>`` and a newline. Control strings inside
roles and texts are escaped with a backslash after their first character, and backslashes are
doubled, so unescaping (drop a backslash, keep what follows) gives back every text exactly.

Defined cases: a null text, role or parts list is empty; turns of a conversation are ordered by
turn (null first), then role, then content, so repeated rows stand next to each other and all
count; a null conv_id is a conversation of its own; an unknown part type is kept as a
``<|attachment:n|>`` placeholder of ``other_tokens``; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("units", T.IntegerType()),
])


@dataclass(frozen=True)
class ChatTemplate:
    turn_open: str = "<|turn|>"
    body_open: str = "<|body|>"
    turn_close: str = "<|end|>\n"
    #: Strings that mean something to this template or to other common ones.
    controls: tuple[str, ...] = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Roles whose content is trained on.
    trained: tuple[str, ...] = ("assistant",)
    #: Tokens that one unit of an attachment expands to: a tile, a second, a page.
    image_tokens: int = 256
    audio_tokens: int = 25
    document_tokens: int = 512
    other_tokens: int = 1


def escape(text: Column, template: ChatTemplate) -> Column:
    """Make control strings harmless; ``unescape`` is the inverse."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.cast("string").alias("ref"), nothing.cast("int").alias("units")))


def _tokens(part: Column, t: ChatTemplate) -> Column:
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    return units * (F.when(part["type"] == "image", t.image_tokens).when(part["type"] == "audio", t.audio_tokens)
                    .when(part["type"] == "document", t.document_tokens).otherwise(t.other_tokens))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio", "document"), part["type"]).otherwise("attachment")


def _visit(part: Column, at: Column, t: ChatTemplate) -> Column:
    """The text that stands for one part."""
    placeholder = F.concat(F.lit("<|"), _kind(part), F.lit(":"), (at + 1).cast("string"), F.lit("|>"))
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(part["text"], t)).otherwise(placeholder)


def format_chats(messages: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Format conversations given as rows (conv_id, turn, role, parts).

    Returns one row per conversation: conv_id, n_turns, formatted, loss_mask (spans of code points
    in ``formatted``, one for each trained turn), attachments (turn_index, ordinal, type, ref,
    placeholder_at, tokens) and attachment_tokens. One shuffle by conv_id; everything is linear in
    the text, as offsets come from a running sum over the conversation's rows.
    """
    t = template
    parts = F.coalesce(F.col("parts"), F.array().cast(T.ArrayType(PART)))
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("pieces", F.transform("parts", lambda p, i: _visit(p, i, t)))
    rows = rows.withColumn("body", F.array_join("pieces", ""))
    rows = rows.withColumn("head", F.concat(F.lit(t.turn_open), escape(F.col("role"), t), F.lit(t.body_open)))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(t.turn_close)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body", F.to_json("parts"))
    before = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"rn": F.row_number().over(order), "at": F.coalesce(before, F.lit(0)) + F.length("head")})
    offsets = F.transform("parts", lambda p, i: F.struct(
        (i + 1).alias("ordinal"), _kind(p).alias("type"), p["ref"].alias("ref"),
        (F.col("at") + F.length(F.array_join(F.slice("pieces", F.lit(1), i), ""))).alias("placeholder_at"), _tokens(p, t).alias("tokens"),
        (F.coalesce(p["type"], F.lit("text")) != "text").alias("attached")))
    plain = ~F.exists("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    rows = rows.withColumn("files", F.when(plain, F.filter(offsets, lambda x: F.lit(False))).otherwise(F.filter(offsets, lambda x: x["attached"])))
    one = F.struct("rn", "piece", F.col("role").isin(*t.trained).alias("trained"), "at", (F.col("at") + F.length("body")).alias("until"), "files")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    files = F.flatten(F.transform("turns", lambda x: F.transform(x["files"], lambda f: F.struct(
        x["rn"].alias("turn_index"), f["ordinal"].alias("ordinal"), f["type"].alias("type"), f["ref"].alias("ref"),
        f["placeholder_at"].alias("placeholder_at"), f["tokens"].alias("tokens")))))
    chats = chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["trained"]), lambda x: F.struct(x["at"].alias("start"), x["until"].alias("end"))).alias("loss_mask"),
        files.alias("attachments"))
    return chats.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, f: s + f["tokens"]))


def parse_formatted(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Read (role, text) pairs back from a formatted text. The closing mark can't occur inside an escaped text."""
    turns = F.split(formatted, re.escape(template.turn_close))
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)

    def one(x: Column) -> Column:
        halves = F.split(F.substr(x, F.lit(len(template.turn_open) + 1)), re.escape(template.body_open), 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(turns, one)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
