"""Chat formatting with typed content parts.

A turn is a role and a list of parts (text, image, audio, document). A visitor turns each part into text: texts are
escaped, other parts become numbered placeholders, their references and expanded token counts are recorded. The
turns of a conversation are joined in order; the loss mask lists the spans of the trained roles' texts.

Template: `<|turn|>role<|body|>parts<|end|>` and a line end for each turn. In roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so no text holds a marker; reading drops each escaping backslash.

Cases: null roles, texts and part lists are empty; turns are ordered by number (null first), then role, then body, so
ties and repeated rows have a fixed order; a null conv_id is a conversation; an unknown kind of part becomes a
placeholder without tokens; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TILE, TILE_TOKENS, AUDIO_TOKENS_PER_SECOND, PAGE_TOKENS = 512, 170, 25.0, 800


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A part list that holds one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text")))


def _field(parts_type: str, part: Column, name: str, kind: str) -> Column:
    return part[name].cast(kind) if f"{name}:" in parts_type else F.lit(None).cast(kind)


def visit(part: Column, turn: Column, index: Column, has: str) -> Column:
    """What a part contributes: its string in the turn, whether it is text, its reference and its tokens."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    width, height = _field(has, part, "width", "double"), _field(has, part, "height", "double")
    tokens = (
        F.when(kind == "image", F.ceil(width / TILE) * F.ceil(height / TILE) * TILE_TOKENS)
        .when(kind == "audio", F.ceil(_field(has, part, "seconds", "double") * AUDIO_TOKENS_PER_SECOND))
        .when(kind == "document", _field(has, part, "pages", "long") * PAGE_TOKENS)
    )
    slot = F.concat_ws(".", turn.cast("string"), index.cast("string"))
    return F.struct(
        F.when(kind == "text", escape(part["text"])).otherwise(
            F.concat(F.lit("<|part "), escape(kind), F.lit(" "), slot, F.lit("|>"))).alias("shown"),
        (kind == "text").alias("is_text"), kind.alias("kind"), slot.alias("slot"),
        _field(has, part, "ref", "string").alias("ref"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def format_conversations(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start from 0, length; code points), attachments, expanded_tokens.

    `turns` has conv_id, turn, role and parts. Everything of a turn is made on its own row; one shuffle brings the turns
    of a conversation together.
    """
    has = turns.schema["parts"].dataType.simpleString()
    parts = F.coalesce("parts", F.array().cast(has))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), "body")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    seen = turns.select("conv_id", "turn", "role", head.alias("head"), F.transform(
        parts, lambda p, i: visit(p, F.coalesce("turn", F.lit(-1)), i, has)).alias("seen"))
    lengths = F.transform("seen", lambda p: F.length(p["shown"]))
    before = F.transform("seen", lambda p, i: F.aggregate(
        F.slice(lengths, 1, i), F.length("head"), lambda a, x: a + x))
    rows = (
        seen.withColumn("body", F.array_join(F.transform("seen", lambda p: p["shown"]), ""))
        .withColumn("whole", F.concat("head", "body", F.lit(END)))
        .withColumn("loss", F.when(F.col("role").isin(*trained_roles), F.filter(
            F.transform(F.arrays_zip("seen", before.alias("before")), lambda p: F.struct(
                p["seen"]["is_text"].alias("is_text"), p["before"].alias("start"),
                F.length(p["seen"]["shown"]).alias("length"))), lambda s: s["is_text"])))
        .withColumn("attached", F.transform(F.filter("seen", lambda p: ~p["is_text"]), lambda p: F.struct(
            p["slot"].alias("slot"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))))
    )
    placed = rows.withColumn("number", F.row_number().over(in_order)).withColumn(
        "at", F.coalesce(F.sum(F.length("whole")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    loss = F.transform(F.coalesce("loss", F.array().cast("array<struct<is_text:boolean,start:int,length:int>>")), lambda s: F.struct(
        (F.col("at") + s["start"]).cast("long").alias("start"), s["length"].cast("long").alias("length")))
    turn = F.struct("number", "whole", loss.alias("loss"), "attached")
    return (
        placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select(
            "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.col("t.whole"), "").alias("formatted"),
            F.flatten("t.loss").alias("loss_spans"), F.flatten("t.attached").alias("attachments"))
        .withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation; placeholders stay in the texts."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    sides = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda s: F.split(s, r"<\|body\|>", 2))
    return F.transform(sides, lambda s: F.struct(
        unescape(F.substring(s[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(s[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
