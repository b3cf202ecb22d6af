"""Chat formatting with Spark expressions only: one formatted string per conversation, its loss mask, and the way back.

A conversation is a run of blocks, one for each run of turns of one role::

    <|begin|>role<|text|>first text<|next|>second text<|end|>

Control strings inside roles and texts are broken up by one backslash after their first character; a control string
that is broken up already gets one more. No text can therefore hold a control string, and taking one backslash away
restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, TEXT, NEXT, END = "<|begin|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings of this template and of common others, cut after the first character.
CONTROL = r"([<\[])(\\*)(\|[A-Za-z_]+\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])(\\*)\\(\|[A-Za-z_]+\|>|/?s>|/?INST\])"
#: Roles whose texts are trained on.
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_mask``.

    The turn structs of a conversation are collected and sorted; adjacent turns of one role are merged into one block, a slice of the sorted
    array. ``loss_mask`` has a run for each turn: characters of marks before its text, characters of its text as it stands
    in ``formatted``, and whether it is trained on. A null role or text counts as empty; null turns come first; turns
    with equal numbers are ordered by role, then text; repeated rows stay; rows with a null conversation are one
    conversation. Other columns are ignored; an empty table gives no rows. A conversation becomes one string, so it
    is the unit that has to fit into a task.
    """
    turns = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("one"),
    )
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    def merged(all_turns: Column) -> Column:
        """The blocks: a role, and the escaped texts of its adjacent turns."""
        first = lambda x, i: (i == 0) | (F.get(all_turns, i - 1)["role"] != x["role"])
        starts = F.filter(F.transform(all_turns, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())

        def blocks(at: Column) -> Column:
            end = lambda k: F.coalesce(F.get(at, k + 1), F.size(all_turns))
            texts = lambda i, k: F.transform(F.slice(all_turns, i + 1, end(k) - i), lambda x: escape(x["text"]))
            role = lambda i: F.get(all_turns, i)["role"]
            return F.transform(at, lambda i, k: F.struct(escape(role(i)).alias("role"), role(i).isin(*LOSS_ROLES).alias("loss"), texts(i, k).alias("texts")))

        return _bound(starts, blocks)

    # exploding the one-element array binds the blocks to a column, so that they are made once
    pieces = turns.select("conv_id", F.explode(F.array(_bound(F.col("turns"), merged))).alias("blocks"))
    opening = lambda b: F.concat(F.lit(BEGIN), b["role"], F.lit(TEXT))
    closing = lambda k: F.when(k == 0, 0).otherwise(len(END))
    whole = F.transform("blocks", lambda b: F.concat(opening(b), F.array_join(b["texts"], NEXT), F.lit(END)))
    marks = lambda b, k, i: F.when(i == 0, closing(k) + F.length(opening(b))).otherwise(len(NEXT))
    runs = F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda t, i: F.struct(marks(b, k, i).alias("marks"), F.length(t).alias("chars"), b["loss"].alias("loss"))))
    return pieces.select("conv_id", F.array_join(whole, "").alias("formatted"), F.flatten(runs).alias("loss_mask"))


def _bound(value: Column, body) -> Column:
    """The body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The way back: ``conv_id``, ``turns`` (array of role and text) and ``loss_texts`` (the texts under the mask), besides the given columns.

    The mask has to fit the string: as many runs as turns, each text as long as its run says, and all marks and texts together with the last
    mark as long as the string. A row where it doesn't fails the job.
    """

    def block(b: Column) -> Column:
        parts = F.split(b, r"<\|text\|>")
        role = unescape(F.regexp_replace(F.get(parts, F.lit(0)), r"^<\|begin\|>", ""))
        return F.transform(F.split(F.get(parts, F.lit(1)), r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), t.alias("raw")))

    whole = F.regexp_replace("formatted", r"<\|end\|>$", "")
    raw = F.flatten(F.transform(F.split(whole, r"<\|end\|>", -1), block))
    out = formatted.withColumn("raw_turns", raw)
    pairs = F.arrays_zip("raw_turns", "loss_mask")
    same = F.forall(pairs, lambda z: F.coalesce(z["loss_mask"]["chars"] == F.length(z["raw_turns"]["raw"]), F.lit(False)))
    covered = F.aggregate("loss_mask", F.lit(len(END)).cast("long"), lambda n, m: n + m["marks"] + m["chars"])
    fits = (F.size("raw_turns") == F.size("loss_mask")) & same & (covered == F.length("formatted"))
    masked = F.filter(pairs, lambda z: z["loss_mask"]["loss"])
    learnt = F.transform(masked, lambda z: unescape(z["raw_turns"]["raw"]))
    return out.select(
        *formatted.columns,
        F.transform("raw_turns", lambda t: F.struct(t["role"].alias("role"), unescape(t["raw"]).alias("text"))).alias("turns"),
        F.when(fits, learnt).otherwise(F.raise_error(F.lit("a loss mask doesn't fit its conversation")).cast("array<string>")).alias("loss_texts"),
    )
