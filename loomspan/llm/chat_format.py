"""Chat formatting with typed content parts, in DataFrame functions alone.

A visitor flattens each turn's parts in order: text is escaped, and an image,
audio or document part becomes a numbered placeholder. A turn is written as

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings all start with ``<|``. Inside texts a ``<``, any backslashes
and a ``|`` get one backslash more, so ``<|`` never stands in content, and
taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Tokens that one unit of an attachment expands to: an image tile, a second
#: of audio, a page of a document.
UNIT_TOKENS = {"image": 576, "audio": 25, "document": 1024}

PART_TYPE = "array<struct<type:string,text:string,ref:string,units:int>>"
TURN_TYPE = "struct<turn:bigint,role:string,parts:" + PART_TYPE + ">"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    part = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
    return F.array(part)


def _attachments(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")


def _visit(parts: Column, before: Column) -> Column:
    """The content of a turn; its attachments are numbered from ``before``."""
    others = lambda i: F.size(_attachments(F.slice(parts, F.lit(1), i)))

    def one(p: Column, i: Column) -> Column:
        kind = F.coalesce(p["type"], F.lit("text"))
        mark = F.concat(F.lit("<|"), F.regexp_replace(kind, r"[^A-Za-z0-9_]", "_"), F.lit(":"), (before + others(i)).cast("string"), F.lit("|>"))
        return F.when(kind == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)

    return F.array_join(F.transform(parts, one), "")


def _units(p: Column) -> Column:
    each = F.lit(1)
    for kind, n in UNIT_TOKENS.items():
        each = F.when(p["type"] == kind, F.lit(n)).otherwise(each)
    return (F.coalesce(p["units"], F.lit(1)) * each).cast("long")


def format_chat(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans`` (array of
    start, from 0, and length, in code points of ``formatted``: the contents
    of turns whose role is in ``learn``), ``attachments`` (array of index,
    turn, type, ref, n_tokens in order of their placeholders) and
    ``attachment_tokens``.

    Turns go by number, ties by role and content; a null number comes first.
    Null roles and texts are empty, null or empty parts give an empty content,
    a part of an unknown type is an attachment of one token a unit. Rows of a
    null conv_id make one conversation. Repeated rows are turns of their own.
    An empty table gives no rows; other columns are ignored. A conversation
    is one output row, so its own turns, and nothing else, meet in one task.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(parts, F.array().cast(PART_TYPE)).alias("parts"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.count("*").over(order)).withColumn("held", _attachments(F.col("parts")))
    rows = rows.withColumn("first", F.coalesce(F.sum(F.size("held")).over(ahead), F.lit(0)).cast("int"))
    rows = rows.withColumn("head", F.concat(F.lit(START), F.regexp_replace(escape(F.col("role")), "\n", NEWLINE), F.lit("\n")))
    rows = rows.withColumn("content", _visit(F.col("parts"), F.col("first")))
    rows = rows.withColumn("chars", F.length("head") + F.length("content") + F.lit(len(END)))
    rows = rows.withColumn("at", F.coalesce(F.sum("chars").over(ahead), F.lit(0)))
    noted = F.transform(F.col("held"), lambda p, i: F.struct((F.col("first") + i).alias("index"), F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _units(p).alias("n_tokens")))
    rows = rows.select("conv_id", F.struct(
        "nth", F.concat("head", "content", F.lit(END)).alias("written"),
        (F.col("at") + F.length("head")).cast("long").alias("start"), F.length("content").cast("long").alias("length"),
        F.col("role").isin(*learn).alias("learnt"), noted.alias("noted"),
    ).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = F.transform(F.filter("xs", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    whole = whole.select(
        "conv_id", F.array_join(F.transform("xs", lambda x: x["written"]), "").alias("formatted"),
        spans.alias("loss_spans"), F.flatten(F.transform("xs", lambda x: x["noted"])).alias("attachments"),
    )
    return whole.withColumn("attachment_tokens", F.aggregate(F.col("attachments"), F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and content, both
    unescaped; placeholders stay."""
    written = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda w: F.length(w) > 0)

    def one(w: Column) -> Column:
        body = F.substring(w, len(START) + 1, F.length(w))
        cut = F.instr(body, "\n")
        role = F.substring(body, F.lit(1), cut - 1)
        return F.struct(unescape(F.regexp_replace(role, r"<\|nl\|>", "\n")).alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("content"))

    return F.transform(written, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, span after span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
