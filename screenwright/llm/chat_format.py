"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role
are merged by an array aggregation, and the blocks are concatenated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.functions.core import note, noted, paged

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: Strings that steer the template; a backslash behind their first character disarms them inside texts.
CONTROL = (BEGIN, END, OPEN, CLOSE)
GUARD = "\\"


def escape(text: Column) -> Column:
    """Disarm control strings; :func:`unescape` gives back the text exactly."""
    out = F.replace(text, F.lit(GUARD), F.lit(GUARD * 2))
    for word in CONTROL:
        out = F.replace(out, F.lit(word), F.lit(word[0] + GUARD + word[1:]))
    return out


def unescape(text: Column) -> Column:
    for word in reversed(CONTROL):
        text = F.replace(text, F.lit(word[0] + GUARD + word[1:]), F.lit(word))
    return F.replace(text, F.lit(GUARD * 2), F.lit(GUARD))


def _block_starts(turns: Column) -> Column:
    """Places (from 1) of the turns whose role differs from that of the turn in front."""
    return F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )


def _merge(turns: Column, starts: Column) -> Column:
    """Blocks ``(role, texts)``: a turn joins the last block if the role is the same.

    Both arguments should be columns, not expressions, since each block reads them.
    """

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.try_element_at(starts, (k + 2).cast("int")), F.size(turns) + 1)
        return F.struct(
            F.element_at(turns, start)["role"].alias("role"),
            F.transform(F.slice(turns, start, stop - start), lambda t: t["text"]).alias("texts"),
        )

    return F.transform(starts, block)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv, formatted, loss_spans``.

    A block is ``<s>role[INST]text[/INST]...</s>`` with one bracket pair per merged
    turn; ``loss_spans`` holds ``(start, length)`` in code points of the texts of
    ``loss_role`` inside ``formatted``. Null texts and null roles are empty; equal
    turn numbers go by role, then text; repeated rows are repeated turns; null turn
    numbers come first; a null conversation id is a conversation; an empty table
    gives no rows. Other columns are not carried. One conversation becomes one value,
    so its size is bounded by what a row can hold.
    """
    given = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    gathered = given.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # inline() keeps each step computed once: the optimiser does not copy a generator's input
    started = gathered.select("conv", "turns", F.inline(F.array(F.struct(_block_starts(F.col("turns")).alias("starts")))))
    blocks = started.select("conv", F.inline(F.array(F.struct(_merge(F.col("turns"), F.col("starts")).alias("blocks")))))
    pieces = F.flatten(
        F.transform(
            F.col("blocks"),
            lambda b: F.concat(
                F.array(F.struct(F.concat(F.lit(BEGIN), escape(b["role"])).alias("s"), F.lit(False).alias("loss"))),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda t: F.array(
                            F.struct(F.lit(OPEN).alias("s"), F.lit(False).alias("loss")),
                            F.struct(escape(t).alias("s"), (b["role"] == loss_role).alias("loss")),
                            F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("loss")),
                        ),
                    )
                ),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("loss"))),
            ),
        )
    )
    cut = blocks.select("conv", F.inline(F.array(F.struct(pieces.alias("pieces")))))
    # spans are noted in a string, since an array that grows in a fold is copied as a whole at each step
    noted_spans = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], note(acc["spans"], acc["at"], F.length(p["s"]))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    ends = noted(noted_spans, "start", "length").cast("array<struct<start:bigint,length:bigint>>")
    out = cut.select(
        "conv",
        F.inline(
            F.array(
                F.struct(
                    F.array_join(F.transform(F.col("pieces"), lambda p: p["s"]), "").alias("formatted"),
                    ends.alias("loss_spans"),
                )
            )
        ),
    )
    return out.withColumnRenamed("conv", conv)


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, one per original row."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"\[INST\]", -1)
        role = unescape(F.substring(F.element_at(parts, 1), len(BEGIN) + 1, 2**31 - 1))
        return F.transform(
            F.slice(parts, 2, F.size(parts)),
            lambda p: F.struct(role.alias("role"), unescape(F.substring(p, F.lit(1), F.length(p) - len(CLOSE))).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""

    def texts(cut) -> Column:
        return F.transform(spans, lambda s: unescape(cut(s["start"].cast("int"), (s["start"] + s["length"]).cast("int"))))

    return F.array_join(paged(formatted, texts), "")
