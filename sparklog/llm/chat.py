"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one block by array functions, and the blocks are concatenated:

    <|im_start|>ROLE\\nTEXT<|im_turn|>TEXT<|im_end|>\\n ...

Inside roles and texts, ``%`` is written ``%25`` and ``<|`` is written ``%3C|``,
and in roles a line end ``%0A``, so control strings occur where the template puts them and nowhere else, and the
text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<|"), F.lit("%3C|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C|"), F.lit("<|")), F.lit("%25"), F.lit("%"))


def escape_role(role: Column) -> Column:
    """A role ends with its line, so its own line ends are written ``%0A``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, formatted, and loss_mask: the code point spans (start from
    0, n) of the formatted string that carry loss, which are the texts of
    ``loss_role``, one span for each turn.

    A null text or role is empty, an empty text stays a turn. Turns with equal
    numbers follow each other by role and text; a repeated row is a turn of its
    own; a null turn number comes first, and rows of a null conv_id form one
    conversation. Other columns are ignored. An empty table gives no rows.
    A conversation is one string, so it has to fit a task.
    """
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Where a block starts: the first turn, and each whose role isn't the last one's.
    n = F.size("ts")
    blocks = (
        sorted_.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"])))
        .withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(n)))
        .withColumn(
            "blocks",
            F.transform(
                F.arrays_zip("starts", "ends"),
                lambda b: F.struct(F.get("ts", b["starts"])["role"].alias("role"), F.transform(F.slice("ts", b["starts"] + 1, b["ends"] - b["starts"]), lambda t: escape(t["text"])).alias("texts")),
            ),
        )
        .select("conv_id", "blocks")
    )
    head = lambda role: F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b["role"]), F.array_join(b["texts"], TURN), F.lit(END + "\n"))), "")
    # Places of the spans: lengths summed up over turns, one running total for the whole conversation.
    sizes = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.length(head(b["role"]))).otherwise(F.lit(len(TURN))).alias("lead"),
                    F.length(x).alias("n"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(len(END) + 1)).otherwise(F.lit(0)).alias("tail"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    place = blocks.select("conv_id", formatted.alias("formatted"), F.filter(spans(sizes), lambda s: s["loss"]).alias("loss_mask"))
    return place.select("conv_id", "formatted", F.transform("loss_mask", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"))).alias("loss_mask"))


def chunks(items: Column) -> Column:
    """An array cut into about as many parts as each has entries, so that work that grows with the square of a part stays small."""
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda c: F.slice(items, c * width + 1, width))
    return F.when(n > 0, parts).otherwise(F.slice(F.array(items), 1, 0))


def spans(sizes: Column) -> Column:
    """Start of each text, given lead, n and tail of all: a fold inside each chunk, and one over the chunks."""
    kind = "array<struct<start:int,n:int,loss:boolean>>"
    span = lambda start, s: F.struct(start.alias("start"), s["n"].alias("n"), s["loss"].alias("loss"))

    def inside(chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
            lambda acc, s: F.struct((acc["at"] + s["lead"] + s["n"] + s["tail"]).alias("at"), F.concat(acc["out"], F.array(span(acc["at"] + s["lead"], s))).alias("out")),
        )

    folded = F.aggregate(
        F.transform(chunks(sizes), inside),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(c["out"], lambda s: span(acc["at"] + s["start"], s)))).alias("out")),
    )
    return F.flatten(folded["out"])


def cut_out(text: Column, found: Column) -> Column:
    """The spans (start, n) of a text as strings; each chunk of spans is cut from the text once."""

    def inside(chunk: Column) -> Column:
        first, last = F.element_at(chunk, 1), F.element_at(chunk, -1)
        piece = F.substr(text, first["start"] + 1, last["start"] + last["n"] - first["start"])
        return F.struct(chunk.alias("spans"), piece.alias("piece"))

    one = lambda c: F.transform(c["spans"], lambda s: F.substr(c["piece"], s["start"] - F.element_at(c["spans"], 1)["start"] + 1, s["n"]))
    return F.flatten(F.transform(F.transform(chunks(found), inside), one))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted string: an array of (role, text)."""
    blocks = F.split(F.substr(formatted, F.lit(len(START) + 1)), r"<\|im_end\|>\n(?:<\|im_start\|>|$)", -1)
    blocks = F.filter(blocks, lambda b: b != "")
    parts = lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), F.split(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2), r"<\|im_turn\|>", -1).alias("texts"))
    return F.flatten(F.transform(F.transform(blocks, parts), lambda b: F.transform(b["texts"], lambda t: F.struct(unescape_role(b["role"]).alias("role"), unescape(t).alias("text")))))


def digests(formatted: DataFrame) -> DataFrame:
    """Figures of formatted conversations, taken from the strings and masks alone."""
    loss = F.array_join(F.transform(cut_out(F.col("formatted"), F.col("loss_mask")), unescape), "")
    turns = read_back(F.col("formatted"))
    read = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
