"""Conversations to training strings and back, with DataFrame expressions only.

A run of turns with one role is a block::

    <|im_start|>role<|im_sep|>text<|im_sep|>next text<|im_end|>

``<|im_sep|>`` ends the role and parts the texts of merged turns, so every turn can be
read back. Inside roles and texts a backslash is put into each ``<|``; where backslashes
stand there already, one more. No control string survives inside a text, and taking one
backslash away restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _blocks(turns: Column) -> Column:
    """Runs of adjacent turns of one role: where each begins, then a slice up to the next."""
    count = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(1), count),
        lambda i: (i == 1)
        | (F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]),
    )
    return F.transform(
        starts,
        lambda begin, k: F.struct(
            F.element_at(turns, begin)["role"].alias("role"),
            F.transform(
                F.slice(turns, begin, F.coalesce(F.get(starts, k + 1), count + 1) - begin),
                lambda t: t["text"],
            ).alias("texts"),
        ),
    )


def _pieces(blocks: Column) -> Column:
    """The string in pieces, each with its place under the loss mask or outside it."""

    def of(block: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(START), block["role"], F.lit(SEP))
        lossy = block["role"] == LOSS_ROLE
        body = F.flatten(
            F.transform(
                block["texts"],
                lambda text, i: F.array(
                    piece(F.when(i == 0, head).otherwise(F.lit(SEP)), F.lit(False)),
                    piece(text, lossy),
                ),
            )
        )
        return F.concat(body, F.array(piece(F.lit(END), F.lit(False))))

    return F.flatten(F.transform(blocks, of))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask`` from ``conv_id, turn, role, text``.

    Turns are sorted by ``(turn, role, text)``, so ties and repeated rows have one order and
    every row counts as a turn. A null turn comes first; null role and null text are empty.
    Rows with a null conv_id form one conversation of their own. ``loss_mask`` holds runs of
    ``(length, loss)`` in characters that cover ``formatted``; loss marks the escaped texts of
    ``assistant``. Other columns are ignored; an empty table gives an empty result. A
    conversation is one string by definition and is built in one task.
    """
    clean = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    # Sorted as they are said; escaping would change the order of ties.
    safe = lambda t: F.struct(
        t["turn"].alias("turn"), escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")
    )
    ordered = F.sort_array(F.collect_list("t"))
    grouped = clean.groupBy("conv_id").agg(ordered.alias("_said"))
    grouped = grouped.select("conv_id", F.transform("_said", safe).alias("turns"))
    pieces = grouped.select("conv_id", _pieces(_blocks(F.col("turns"))).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(F.char_length(p["text"]).alias("length"), p["loss"].alias("loss")),
        ).alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` out of ``formatted`` and ``loss_mask``."""
    parts = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>"), lambda b: b != ""),
        lambda b: F.split(F.substring(b, len(START) + 1, 2**31 - 1), r"<\|im_sep\|>"),
    )
    turns = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.slice(p, 2, F.size(p) - 1),
                lambda text: F.struct(
                    unescaped(F.element_at(p, 1)).alias("role"), unescaped(text).alias("text")
                ),
            ),
        )
    )
    # Each run's end from its length: runs are few beside characters, and only numbers move.
    spans = F.aggregate(
        "loss_mask",
        F.struct(F.lit(1).alias("at"), F.expr("array()").cast(
            "array<struct<at:int,length:int>>").alias("spans")),
        lambda acc, run: F.struct(
            (acc["at"] + run["length"]).alias("at"),
            F.when(
                run["loss"],
                F.concat(acc["spans"], F.array(
                    F.struct(acc["at"].alias("at"), run["length"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    loss = F.array_join(
        F.transform(spans, lambda s: unescaped(F.substring("formatted", s["at"], s["length"]))), ""
    )
    return formatted.select("*", turns.alias("turns"), loss.alias("loss_text"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` gives."""
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
