"""Chat formatting: logged conversations that are the beginning of a longer one are dropped before rendering.

A log often holds a conversation after every turn. Each turn prefix gets a rolling hash (the exclusive
or of its turns' hashes, each taken with its place). A conversation is a mere snapshot if its whole hash
is that of a shorter prefix of another one; two anti-joins keep the others, one of each kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chromaspark.llm.common import keep

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _hash(kind: int, role: Column, text: Column) -> Column:
    """64-bit hash of a turn; a null differs from an empty string."""
    blank = F.lit("")
    return F.xxhash64(F.lit(kind), F.col("pos"), role.isNull(), F.coalesce(role, blank), text.isNull(), F.coalesce(text, blank))


def maximal(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, n_turns, n_copies)`` of the conversations to keep.

    Turns are ordered by (turn, role, text), nulls first. A conversation goes if all its turns begin a
    longer one; of conversations with the same turns the one with the smallest id stays,
    and ``n_copies`` counts them. Rows without an id belong to no conversation. Prefixes are compared by
    two 64-bit hashes.
    """
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = Window.partitionBy("conv")
    order = own.orderBy("turn", "role", "text")
    placed = turns.select(
        "conv", F.row_number().over(order).alias("pos"), F.count(F.lit(1)).over(own).alias("n"), "turn", "role", "text"
    ).select("conv", "pos", "n", "turn", "role", "text", *[_hash(i, F.col("role"), F.col("text")).alias(f"t{i}") for i in (1, 2)])
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = keep(placed.select("conv", "pos", "n", *[F.expr(f"bit_xor(t{i})").over(sofar).alias(f"h{i}") for i in (1, 2)]), "prefixes")
    ends = prefixes.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    begun = prefixes.where("pos < n").select("pos", "h1", "h2").distinct()
    left = ends.join(begun, ["pos", "h1", "h2"], "left_anti")
    return left.select(F.col("conv").alias(conv), F.col("pos").cast("bigint").alias("n_turns"), F.col("copies").alias("n_copies"))


def render(
    conversations: DataFrame, kept: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Add ``rendered`` to ``kept``: the turns of each conversation, marked with their roles, as one string.

    A null role is written as ``unknown``, a null text as nothing. One conversation must fit into one row.
    """
    turns = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).alias("c"), F.struct(
        F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    chosen = kept.withColumnRenamed(conv, "conv")
    own = turns.join(chosen.select("conv"), F.col("c") == F.col("conv"), "left_semi")
    line = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))
    whole = own.groupBy("c").agg(F.collect_list("t").alias("ts"))
    # sort_array puts nulls first, as the window of maximal() does
    whole = whole.select("c", F.array_join(F.transform(F.sort_array("ts"), line), "\n").alias("rendered"))
    out = chosen.join(whole, F.col("conv") == F.col("c")).drop("c")
    return out.withColumnRenamed("conv", conv)


def format_chats(conversations: DataFrame, **names) -> DataFrame:
    """``(conv_id, n_turns, n_copies, rendered)`` of the conversations that no longer one repeats.

    Conversations without a row do not exist; an empty table gives an empty result. Rows with a null id
    belong to no conversation and are left out: nothing tells which of them belong together. Repeated rows are repeated turns. Other columns are not looked at.
    """
    return render(conversations, maximal(conversations, **names), **names)
