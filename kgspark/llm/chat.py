"""Preference formatting: the common prefix of two conversations once, as prompt, and two completions.

For each pair the longest run of leading turns in which the chosen and the rejected conversation agree
in role and text is rendered once; the turns behind it are rendered as the two completions, with a mask:
the character ranges, in the completion, of what assistants say. If one conversation is the start of
the other, or both are alike, the last common turn goes to the completions, so neither is empty.

Turns are ordered by turn, then role and text. A null role is `user`, a null text empty. `<|` in a text
becomes `< |`, so a text holds no mark. A pair of which a side has no turns gives no row. Repeated rows
are turns of their own. Empty tables give none. Rows with a null pair_id are left out. Other columns
are ignored. The rows of a pair meet in one task, sorted and spilled there; a rendered text is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def preferences(chosen: DataFrame, rejected: DataFrame, one_sided: bool = False) -> DataFrame:
    """From turns (pair_id, turn, role, text) of both sides: pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    Masks are arrays of (first, behind), counted in characters. With one_sided a pair of which a side has no
    turns gives a row too: all turns of the other side are its prompt, completions and masks are null.
    """

    def side(turns: DataFrame, name: str) -> DataFrame:
        role, text = F.coalesce("role", F.lit("user")), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
        return turns.where("pair_id is not null").select("pair_id", F.lit(name).alias("side"), "turn", role.alias("role"), text.alias("text"))

    both = side(chosen, "c").unionByName(side(rejected, "r")).repartition("pair_id")
    at = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text"))
    mine = lambda name: F.max(F.when(F.col("side") == name, F.struct("role", "text"))).alias(name)
    met = both.withColumn("at", at).groupBy("pair_id", "at").agg(mine("c"), mine("r"))
    so_far = Window.partitionBy("pair_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("pair_id")
    sizes = met.select("*", F.count("c").over(whole).alias("n_c"), F.count("r").over(whole).alias("n_r"), F.max(F.when(~F.col("c").eqNullSafe(F.col("r")), 1)).over(so_far).alias("differs"))
    paired = (F.col("n_c") > 0) & (F.col("n_r") > 0)
    common = (sizes if one_sided else sizes.where(paired)).withColumn("prefix", ~paired | (F.col("differs").isNull() & (F.col("at") < F.least("n_c", "n_r"))))
    for name in ("c", "r"):
        own = F.col(name)
        common = common.withColumn(f"{name}_out", F.when(own.isNotNull(), rendered(own["role"], own["text"])))
        common = common.withColumn(f"{name}_end", F.sum(F.when(~F.col("prefix"), F.length(f"{name}_out"))).over(so_far))
        end = F.col(f"{name}_end") - F.lit(len("<|end|>\n"))
        said = F.when(~F.col("prefix") & (own["role"] == "assistant"), F.struct((end - F.length(own["text"])).cast("long").alias("first"), end.cast("long").alias("behind")))
        common = common.withColumn(f"{name}_said", said)

    def joined(column: str, where: Column) -> Column:
        parts = F.array_sort(F.collect_list(F.when(where & F.col(column).isNotNull(), F.struct("at", F.col(column).alias("x")))))
        return F.array_join(F.transform(parts, lambda p: p["x"]), "")

    mask = lambda name: F.array_sort(F.collect_list(f"{name}_said"))
    out = common.withColumn("either", F.coalesce("c_out", "r_out")).groupBy("pair_id").agg(
        F.sum(F.col("prefix").cast("long")).alias("n_prompt_turns"), joined("either", F.col("prefix")).alias("prompt"),
        joined("c_out", ~F.col("prefix")).alias("chosen"), mask("c").alias("chosen_mask"), joined("r_out", ~F.col("prefix")).alias("rejected"), mask("r").alias("rejected_mask"), F.min(paired).alias("paired"),
    )
    return out.select("pair_id", "n_prompt_turns", "prompt", *(F.when(F.col("paired"), F.col(c)).alias(c) for c in ("chosen", "chosen_mask", "rejected", "rejected_mask")))


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs for a table of single conversations: each conversation up to its last assistant turn is chosen;
    rejected is the same with that turn's text from the last assistant turn of the conversation whose
    conv_id differs in the lowest bit. Conversations without such a turn or partner give no pair."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("pair_id is not null")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    pairs = last.join(last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("other")), "pair_id")
    all_turns = turns.join(pairs, "pair_id")
    is_last = (F.col("role") == "assistant") & (F.struct("turn", "text") == F.col("last"))
    before = (F.struct("turn", "role", "text") < F.struct(F.col("last.turn"), F.lit("assistant"), F.col("last.text"))) | is_last
    chosen = all_turns.where(before)
    return chosen.select("pair_id", "turn", "role", "text"), chosen.select("pair_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))


def ring(sizes: DataFrame) -> DataFrame:
    """(pair_id, n) with the next pair_id in order and its n, as other_id and other_n; the first follows the last.

    Ranges of ids are tasks of their own; of each range one row goes on to the ranking of the ranges.
    """
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(sizes.approxQuantile("pair_id", [i / n for i in range(1, n)], 0.5 / n)))
    within = F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("pair_id").cast("double"))
    dealt = sizes.withColumn("range", F.size(within) if bounds else F.lit(0))
    heads = dealt.groupBy("range").agg(F.min(F.struct("pair_id", "n")).alias("head"))
    order = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("behind"))
    own = Window.partitionBy("range").orderBy("pair_id")
    found = dealt.withColumn("near", F.lead(F.struct("pair_id", "n")).over(own)).join(heads, "range").withColumn("other", F.coalesce("near", "behind"))
    return found.select("pair_id", "n", F.col("other.pair_id").alias("other_id"), F.col("other.n").alias("other_n"))


def branched(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides for a table of single conversations: each whole conversation is chosen. Rejected is the same up to
    its k-th answer, and from there on what the next conversation with an answer says from its own k-th answer
    to its end; ids are taken in order, and the first follows the last. k goes through the answers that both
    have, by conv_id. A conversation without an answer, or the only one with any, has no rejected side."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("pair_id is not null")
    so_far = Window.partitionBy("pair_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("pair_id", F.count("*").over(so_far).alias("turn"), "role", "text", F.count(F.when(F.col("role") == "assistant", 1)).over(so_far).alias("answer"))
    pairs = ring(turns.where("role = 'assistant'").groupBy("pair_id").agg(F.count("*").alias("n"))).where("pair_id <> other_id")
    pairs = pairs.select("pair_id", "other_id", (F.pmod("pair_id", F.least("n", "other_n")) + 1).alias("k"))
    head = placed.join(pairs, "pair_id").where("answer < k").select("pair_id", F.lit(0).alias("part"), "turn", "role", "text")
    tail = placed.withColumnRenamed("pair_id", "other_id").join(pairs, "other_id").where("answer >= k").select("pair_id", F.lit(1).alias("part"), "turn", "role", "text")
    return placed.select("pair_id", F.struct(F.lit(0).alias("part"), "turn").alias("turn"), "role", "text"), head.unionByName(tail).select("pair_id", F.struct("part", "turn").alias("turn"), "role", "text")
