"""Chat formatting with typed content parts, in built-in expressions only.

A turn's content is an array of parts.  A visitor turns each part into text:
text parts are escaped, attachments become numbered placeholders whose
references and token counts are recorded in order.  Turns are marked by
control strings; ``\\`` and ``<|`` inside texts are escaped reversibly, so no
text can forge a mark and reading back gives the very same turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Tokens an attachment stands for when its part names no count.
DEFAULT_TOKENS = {"image": 576, "audio": 250, "document": 1024}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    slashed = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(slashed, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """Roles stand on the first line, so their line breaks are marked as well."""
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """Plain text (null: empty) as a content of one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(0).cast("bigint").alias("tokens"),
        )
    )


def kind_of(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("unknown"))


def attachments(parts: Column) -> Column:
    """The parts that are no text, in order, with references and token counts."""
    default = F.lit(0).cast("bigint")
    media = F.filter(parts, lambda p: kind_of(p) != "text")
    return F.transform(
        media,
        lambda p, i: F.struct(
            (i + 1).cast("bigint").alias("position"),
            kind_of(p).alias("type"),
            p["ref"].alias("ref"),
            F.coalesce(
                p["tokens"],
                *[F.when(p["type"] == k, F.lit(v).cast("bigint")) for k, v in DEFAULT_TOKENS.items()],
                default,
            ).alias("tokens"),
        ),
    )


def visit(parts: Column) -> Column:
    """Flatten parts: escaped texts and ``<|type:k|>`` for the k-th attachment of the turn.

    Texts between two attachments are joined before they are escaped, so that
    no mark can be put together from neighbouring parts.  A null part or a part
    without type is an attachment of type ``unknown``.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"), F.lit(0).alias("k"))

    def step(a: Column, p: Column) -> Column:
        is_text = kind_of(p) == "text"
        mark = F.concat(F.lit("<|"), escape(kind_of(p)), F.lit(":"), (a["k"] + 1).cast("string"), F.lit("|>"))
        return F.struct(
            F.when(is_text, a["done"]).otherwise(F.concat(a["done"], escape(a["text"]), mark)).alias("done"),
            F.when(is_text, F.concat(a["text"], F.coalesce(p["text"], F.lit("")))).otherwise(F.lit("")).alias("text"),
            (a["k"] + F.when(is_text, 0).otherwise(1)).alias("k"),
        )

    return F.aggregate(parts, start, step, lambda a: F.concat(a["done"], escape(a["text"])))


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, media_tokens.

    ``loss_spans`` holds (start, length) in code points of ``formatted``, one
    for each turn of ``trained_role``.  Turns go by number, nulls first; equal
    numbers by role, then content.  Null role or content: empty.  Rows with a
    null conversation id form one conversation.  A conversation is one group:
    its output is one string, which has to fit in a row anyway.
    """
    body = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(visit(F.col(parts_col)), F.lit("")).alias("body"),
        F.coalesce(attachments(F.col(parts_col)), F.array().cast("array<struct<position:bigint,type:string,ref:string,tokens:bigint>>")).alias("media"),
    ).withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    placed = (
        body.withColumn("ord", F.row_number().over(w))
        .withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
        .withColumn("at", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    turn = F.struct(
        "ord",
        F.concat("head", "body", F.lit(END)).alias("piece"),
        F.when(
            F.col("role") == trained_role,
            F.struct(
                (F.col("at") + F.length("head")).cast("bigint").alias("start"),
                F.length("body").cast("bigint").alias("length"),
            ),
        ).alias("loss"),
        "media",
    )
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    media = F.flatten(F.transform("t", lambda x: x["media"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]).alias("media_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    bodies = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1))
    )
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + F.lit(2))).alias("text"),
        ),
    )


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(
        spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
