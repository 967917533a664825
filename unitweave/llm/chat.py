"""Chat formatting: conversations as one marked-up text each, with a loss mask, and reading them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitweave.llm.common import prefix_sums

#: Control strings that may not stand in a text as they are, each with the letter that stands for it after a backslash.
CONTROL = (
    ("\\", "b"),
    ("<|", "m"),
    ("<s>", "s"),
    ("</s>", "e"),
    ("[INST]", "i"),
    ("[/INST]", "j"),
    ("<<SYS>>", "y"),
    ("<</SYS>>", "z"),
)
#: Opens a block of turns of one role, parts the turns of a block, ends it.
OPEN, BODY, PART, END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"


def escape(text: Column) -> Column:
    """Replace control strings by a backslash and a letter. The backslash itself goes first, so this is reversible."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit("\\" + x[1])), CONTROL, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit("\\" + x[1]), F.lit(x[0])), CONTROL[::-1], text)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length of each assistant turn).

    Turn structs are collected and sorted by (turn, role, text); adjacent turns of one role are merged into a block
    `<|role|>role<|text|>turn<|turn|>turn<|end|>` by looking at the neighbours in the array. Control strings inside roles and texts
    are escaped, so `read_chats` gets every turn back. Work grows in proportion to the turns of a conversation.
    Null text and null role: empty. Null conv_id: one conversation. Equal turn numbers: by role, then text. Repeated
    rows are turns of their own. Empty table: no rows. Columns other than conv_id, turn, role, text are ignored.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = F.transform(
        "turns",
        lambda t: F.struct(
            escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")
        ),
    )
    chats = chats.select("conv_id", rows.alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.element_at("turns", F.greatest(i, F.lit(1)))["role"] == t["role"])
        last = i == F.size("turns") - 1
        more = ~last & (F.get("turns", i + 1)["role"] == t["role"])
        before = F.when(same, F.lit(PART)).otherwise(F.concat(F.lit(OPEN), t["role"], F.lit(BODY)))
        return F.struct(
            before.alias("before"),
            t["text"].alias("text"),
            F.when(more, F.lit("")).otherwise(F.lit(END)).alias("after"),
            t["loss"].alias("loss"),
        )

    chats = chats.withColumn("pieces", F.transform("turns", piece))
    chats = chats.withColumn(
        "formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    )
    lengths = F.transform(
        "pieces",
        lambda p: F.struct(
            F.length(p["before"]).cast("long").alias("b"),
            F.length(p["text"]).cast("long").alias("t"),
            F.length(p["after"]).cast("long").alias("a"),
            p["loss"].alias("loss"),
        ),
    )
    placed = F.zip_with(
        lengths,
        prefix_sums(F.transform(lengths, lambda p: p["b"] + p["t"] + p["a"])),
        lambda p, at: F.struct((at + p["b"]).alias("start"), p["t"].alias("length"), p["loss"].alias("loss")),
    )
    spans = F.transform(
        F.filter(placed, lambda p: p["loss"]),
        lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")),
    )
    return chats.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """The turns (array of role, text) and the texts under the loss mask, got back from the formatted text alone.

    chats: as `format_chats` gives them. The text is cut at its marks once; the lengths of the pieces give the turns' places,
    and a loss span takes the turn that stands at its place (found by sorting both by place). A span that is no whole turn
    is cut out of the text. Null conv_ids are read like others, very long conversations in proportion to their turns but
    for a sort. Empty table: no rows. Columns other than conv_id, formatted and loss_spans are ignored.
    """
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")

    def turns_of(block: Column, b: Column) -> Column:
        body = F.split(F.substring(block, len(OPEN) + 1, 2147483647), r"<\|text\|>")
        role = F.get(body, F.lit(0))
        head = F.when(b > 0, len(END)).otherwise(0) + len(OPEN) + len(BODY) + F.length(role)
        return F.transform(
            F.split(F.get(body, F.lit(1)), r"<\|turn\|>"),
            lambda t, i: F.struct(role.alias("role"), t.alias("text"), F.when(i > 0, len(PART)).otherwise(head).cast("long").alias("skip")),
        )

    def placed(turns: Column) -> Column:
        ends = prefix_sums(F.transform(turns, lambda t: t["skip"] + F.length(t["text"])))
        return F.zip_with(turns, ends, lambda t, at: F.struct((at + t["skip"]).alias("start"), F.lit(0).alias("span"), F.length(t["text"]).cast("long").alias("length"), t["text"].alias("text"), t["role"].alias("role")))

    bound = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  so that x is made once
    read = chats.select("conv_id", "formatted", "loss_spans", bound(F.flatten(F.transform(blocks, turns_of)), placed).alias("_turns"))
    spans = F.transform(
        "loss_spans", lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("span"), s["length"].alias("length"), F.lit("").alias("text"), F.lit("").alias("role"))
    )
    # a turn of no characters may begin where the next one does not: places are told apart by the marks between them
    both = F.array_sort(F.concat("_turns", spans))

    def under(x: Column) -> Column:
        def text(s: Column, i: Column) -> Column:
            turn = F.get(x, i - 1)
            whole = (turn["start"] == s["start"]) & (turn["length"] == s["length"]) & (turn["span"] == 0)
            return F.when(s["span"] == 1, F.when(whole, turn["text"]).otherwise(F.substring("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))

        return F.filter(F.transform(x, text), lambda t: t.isNotNull())

    return read.select(
        "conv_id",
        "formatted",
        "loss_spans",
        F.transform("_turns", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
        F.transform(bound(both, under), unescape).alias("loss_texts"),
    )
