"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

The turns of both conversations of a pair are laid side by side by turn number. The prompt is their
longest common prefix of turns, rendered once; the remaining turns of either side are its completion.
A mask says for each rendered turn whether it counts towards the loss: turns of the trained role inside
a completion do, everything else does not. The result has one row per rendered turn, so a conversation
of any length stays spread over tasks.

Defined results: rows of one conversation that share a turn number belong to one turn, in order of role
and text; such a turn is common if both sides hold the same rows equally often. Turns without a number
come before all others. A null role renders as an empty one, a null text as an empty text. Turns without
a conv_id belong to no pair. A conversation without a partner has no prompt; all its turns are its
completion. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointgrid.stages import cut

TRAINED = "assistant"
HEAD, TAIL = ("<|", "|>\n"), "\n"


def rendered() -> Column:
    return F.concat(F.lit(HEAD[0]), F.col("role"), F.lit(HEAD[1]), F.col("text"), F.lit(TAIL))


def with_swapped_replies(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Turns with pair_id and side: every conversation is chosen, and rejected with its neighbour's last reply.

    Conversations 2k and 2k + 1 are neighbours. The last turn of the trained role is exchanged for the
    neighbour's; a conversation without such a turn has no rejected side, and one whose neighbour has none
    is rejected without a reply. Rows without conv_id are left out.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    last = cut(rows.where(F.col("role") == trained).groupBy("pair_id").agg(F.max("turn").alias("_last")), "last")
    marked = rows.join(last, "pair_id", "left").withColumn("_reply", F.coalesce((F.col("turn") == F.col("_last")) & (F.col("role") == trained), F.lit(False)))
    side = lambda df, s: df.select("pair_id", F.lit(s).alias("side"), "turn", "role", "text")
    neighbour = F.col("pair_id") + 1 - 2 * F.pmod("pair_id", F.lit(2))
    replies = marked.where("_reply").select(neighbour.alias("pair_id"), "role", "text")
    replies = replies.join(last.where("_last IS NOT NULL"), "pair_id").withColumnRenamed("_last", "turn")
    return side(rows, "chosen").union(side(marked.where("_last IS NOT NULL AND NOT _reply"), "rejected")).union(side(replies, "rejected"))


def formatted(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, text, rendered, n (times), in_loss.

    ``turns`` has pair_id, side (chosen or rejected), turn, role and text.
    """
    rows = turns.select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    counted = cut(
        rows.groupBy("pair_id", "turn", "role", "text").agg(
            F.count_if(F.col("side") == "chosen").alias("chosen"), F.count_if(F.col("side") == "rejected").alias("rejected")
        ),
        "turns",
    )
    number = F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63)))
    apart = cut(
        counted.where("chosen <> rejected").groupBy("pair_id").agg(F.min(number).alias("_first")), "apart"
    )
    placed = counted.join(apart, "pair_id", "left").withColumn("_common", F.col("_first").isNull() | (number < F.col("_first")))
    parts = F.when(
        F.col("_common"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("n")))
    ).otherwise(F.array(*(F.struct(F.lit(s).alias("part"), F.col(s).alias("n")) for s in ("chosen", "rejected"))))
    return placed.withColumn("_p", F.explode(parts)).where("_p.n > 0").select(
        "pair_id", F.col("_p.part").alias("part"), "turn", "role", "text", rendered().alias("rendered"), F.col("_p.n").alias("n"),
        ((F.col("role") == trained) & ~F.col("_common")).alias("in_loss"),
    )


def assembled(parts: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected, and the loss spans [start, end) of both completions.

    For pairs whose conversations fit into one row each.
    """
    item = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("t"), "role", "text", "rendered", "n", "in_loss")
    sorted_ = parts.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.repeat(x["rendered"], x["n"].cast("int"))), "")
    head = F.lit(len(HEAD[0]) + len(HEAD[1]))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["rendered"]) * x["n"]).alias("at"),
            F.when(
                x["in_loss"],
                F.concat(
                    a["spans"],
                    F.transform(
                        F.sequence(F.lit(0).cast("long"), x["n"] - 1),
                        lambda k: F.struct(
                            (a["at"] + k * F.length(x["rendered"]) + F.length(x["role"]) + head).cast("long").alias("start"),
                            (a["at"] + (k + 1) * F.length(x["rendered"])).cast("long").alias("end"),
                        ),
                    ),
                ),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    one = sorted_.select("pair_id", "part", text.alias("text"), spans.alias("spans"))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return one.groupBy("pair_id").agg(
        *(F.coalesce(pick(p, "text"), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")),
        *(F.max_by("spans", F.when(F.col("part") == p, 1)).alias(f"{p}_loss") for p in ("chosen", "rejected")),
    )
