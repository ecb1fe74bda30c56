"""Chat formatting: turns of typed parts become one training text, with a loss mask and attachment references.

A visitor for each type of part flattens it: text stands as it is, images, audio and documents become numbered
placeholders, whose attachment, place and expanded token count are recorded. Each turn is written as

    <turn:ROLE>\\nTEXT</turn>\\n

Control strings inside texts get a backslash behind their ``<``: a run of backslashes between ``<`` and a control word is
one longer in the output than in the text, so a mark has none, a text at least one, and reading back takes one away.
Everything is DataFrame functions. A conversation is one row of the output, so its turns meet in one task, once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words that make marks. Fixed values.
CONTROL = ("turn", "part", "image", "audio", "document", "other")
_WORDS = "|".join(CONTROL)
_TURN_END = "</turn>\n"
_PART = "<part>"
# The role whose text the loss covers.
LEARNED = "assistant"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for once its attachment is encoded."""

    image_base: int = 85
    image_tile: int = 170
    tile_pixels: int = 512
    audio_per_second: int = 25
    document_per_page: int = 256


# A part: its type, a text (of text parts), a reference (of attachments) and the measures that its tokens come from.
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    """Control strings of a text told apart from marks."""
    return F.regexp_replace(text, rf"<(\\*+)(?=/?(?:{_WORDS})[:>])", r"<$1\\")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, rf"<\\(\\*+)(?=/?(?:{_WORDS})[:>])", "<$1")


def _role_mark(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E")), F.lit("\n"), F.lit("%0A"))


def _role_read(mark: Column) -> Column:
    return F.replace(F.replace(F.replace(mark, F.lit("%0A"), F.lit("\n")), F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def _measure(value: Column) -> Column:
    """Missing and negative measures count as 0."""
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def visitors(expansion: Expansion) -> Mapping[str, Callable[[Column], Column]]:
    """For each type of attachment the tokens that its placeholder expands to."""

    def image(part: Column) -> Column:
        tiles = F.ceil(_measure(part["width"]) / expansion.tile_pixels) * F.ceil(_measure(part["height"]) / expansion.tile_pixels)
        return F.lit(expansion.image_base) + expansion.image_tile * tiles

    return {
        "image": image,
        "audio": lambda part: F.ceil(_measure(part["seconds"]) * expansion.audio_per_second),
        "document": lambda part: expansion.document_per_page * _measure(part["pages"]),
        "other": lambda part: F.lit(0),
    }


def _visited(part: Column, expansion: Expansion) -> Column:
    """A part as ``kind``, ``text``, ``ref``, ``tokens``; null types with a reference and unknown types are ``other``."""
    known = visitors(expansion)
    is_text = F.coalesce(part["type"] == "text", part["type"].isNull() & part["ref"].isNull(), F.lit(True))
    kind = F.when(is_text, "text").when(part["type"].isin(*known), part["type"]).otherwise("other")
    tokens = F.lit(0).cast("long")
    for name, visit in known.items():
        tokens = F.when(kind == name, visit(part).cast("long")).otherwise(tokens)
    text = F.when(is_text, escaped(F.coalesce(part["text"], F.lit("")))).otherwise("")
    return F.struct(kind.alias("kind"), text.alias("text"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: str = "text") -> Column:
    """One text part; null is an empty text."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))),
    )
    return F.array(part)


def formatted(turns: DataFrame, parts: Column | None = None, learned: str = LEARNED, expansion: Expansion = Expansion()) -> DataFrame:
    """One row per ``conv_id``: ``text``, ``spans``, ``attachments``, ``expanded_tokens``.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``, or ``parts``, an array of ``PART_TYPE`` (null and empty: no text;
    a null part is an empty text). Turns are in order of ``turn``, nulls first, ties by role and text; a repeated row is a
    turn again. A null role is the empty one. Rows of a null ``conv_id`` make a conversation of their own; other columns
    aren't read. Neighbouring text parts are told apart by a ``<part>`` mark.

    ``spans`` has for each turn the code points ``start`` to ``end`` of the whole turn and ``loss_start`` to ``loss_end`` of its
    text, empty for all roles but ``learned``. ``attachments`` (``number``, ``turn``, ``kind``, ``ref``, ``tokens``, ``at``) are
    numbered through the conversation as in their placeholders, ``at`` being a placeholder's first code point in ``text``.
    """
    parts = text_parts() if parts is None else parts
    visited = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: _visited(p, expansion))
    rows = turns.select("conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), visited.alias("_parts"))
    rows = rows.withColumn("_attached", F.size(F.filter("_parts", lambda p: p["kind"] != "text")))
    in_order = Window.partitionBy("conv_id").orderBy("_turn", "_role", F.col("_parts")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.sum("_attached").over(in_order) - F.col("_attached")).withColumn("_n", F.count("*").over(in_order))
    # Flattened from left to right: a text stands behind a mark if a text is before it, an attachment takes the next number.
    start = F.struct(
        F.lit("").alias("text"),
        F.lit("").alias("last"),
        F.col("_before").alias("number"),
        F.array().cast("array<struct<number:bigint,kind:string,ref:string,tokens:bigint,at:bigint>>").alias("attached"),
    )

    def add(done: Column, part: Column) -> Column:
        number = done["number"] + F.when(part["kind"] == "text", 0).otherwise(1)
        mark = F.concat(F.lit("<"), part["kind"], F.lit(":"), number.cast("string"), F.lit(">"))
        piece = F.when(part["kind"] == "text", F.concat(F.when(done["last"] == "text", _PART).otherwise(""), part["text"])).otherwise(mark)
        entry = F.struct(number.alias("number"), part["kind"].alias("kind"), part["ref"].alias("ref"), part["tokens"].alias("tokens"), F.length(done["text"]).cast("long").alias("at"))
        attached = F.when(part["kind"] == "text", done["attached"]).otherwise(F.concat(done["attached"], F.array(entry)))
        return F.struct(F.concat(done["text"], piece).alias("text"), part["kind"].alias("last"), number.alias("number"), attached.alias("attached"))

    flat = F.when(
        (F.size("_parts") == 1) & (F.col("_attached") == 0),
        F.struct(F.col("_parts")[0]["text"].alias("text"), F.lit("text").alias("last"), F.col("_before").alias("number"), start["attached"].alias("attached")),
    ).otherwise(F.aggregate("_parts", start, add))
    rows = rows.withColumn("_flat", flat)
    head = F.concat(F.lit("<turn:"), _role_mark(F.col("_role")), F.lit(">\n"))
    rows = rows.select("conv_id", "_n", "_turn", "_role", head.alias("_head"), F.col("_flat.text").alias("_body"), F.col("_flat.attached").alias("_attached"))
    rows = rows.withColumn("_size", (F.length("_head") + F.length("_body") + len(_TURN_END)).cast("long"))
    place = Window.partitionBy("conv_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("_size").over(place))
    first = F.col("_end") - F.col("_size")
    body = first + F.length("_head")
    span = F.struct(
        first.alias("start"),
        F.col("_end").alias("end"),
        body.alias("loss_start"),
        (body + F.when(F.col("_role") == learned, F.length("_body")).otherwise(0)).alias("loss_end"),
    )
    turn = F.struct(
        F.col("_n"),
        F.concat("_head", "_body", F.lit(_TURN_END)).alias("text"),
        span.alias("span"),
        F.transform(
            "_attached",
            lambda a: F.struct(
                a["number"].alias("number"), F.col("_turn").alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), (a["at"] + body).alias("at")
            ),
        ).alias("attached"),
    )
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    attachments = F.flatten(F.col("_turns.attached"))
    return joined.select(
        "conv_id",
        F.array_join("_turns.text", "").alias("text"),
        F.col("_turns.span").alias("spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("expanded_tokens"),
    )


def turns_read(text: Column | str = "text") -> Column:
    """The turns of a formatted text: ``role``, ``body`` (with placeholders, still escaped) and ``text`` (without escapes)."""
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.split(text, _TURN_END)

    def read(piece: Column) -> Column:
        mark = F.substring_index(piece, ">\n", 1)
        body = F.substring(piece, F.length(mark) + 3, F.length(piece))
        role = _role_read(F.substring(mark, F.lit(len("<turn:") + 1), F.length(mark)))
        return F.struct(role.alias("role"), body.alias("body"), unescaped(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read)


def loss_read(text: Column | str = "text", spans: Column | str = "spans") -> Column:
    """All text under the loss mask, without escapes, nothing between turns. Spans are cut from their own turn's piece."""
    text = F.col(text) if isinstance(text, str) else text
    spans = F.col(spans) if isinstance(spans, str) else spans

    def under(piece: Column, span: Column) -> Column:
        size = (span["loss_end"] - span["loss_start"]).cast("int")
        return F.when(size > 0, unescaped(F.substring(piece, (span["loss_start"] - span["start"] + 1).cast("int"), size))).otherwise("")

    pieces = F.split(text, _TURN_END)
    return F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), spans, under), "")


def digests(conversations: DataFrame) -> DataFrame:
    """What a formatted text reads back as: ``conv_id``, ``n_turns``, digests of turns and of the text under the loss mask, sizes."""
    read = conversations.select("conv_id", "text", F.col("spans"), turns_read().alias("_read"), loss_read().alias("_loss"))
    pieces = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(pieces, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )
