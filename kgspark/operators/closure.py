"""Fixpoints over edges (a, b): transitive closure, reachability from seeds, connected components.

Loops run on the driver, rows never do: each round is a join and a difference, written to the shared
folder. The closure doubles path lengths each round, so a chain of depth d takes about log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.checkpoints import counted, discard, saved, small


class FixpointError(RuntimeError):
    """A fixpoint did not settle within its bound of rounds."""


def transitive_closure(edges: DataFrame, rounds: int = 40, two_hop: bool = False) -> DataFrame:
    """All (a, b) with a path of one or more edges. Cycles give (a, a). two_hop stops at paths of length 2."""
    known = saved(edges.select("a", "b").where("a is not null and b is not null").distinct(), "closure")
    fresh = known
    for _ in range(rounds):
        right = small(known).select(F.col("a").alias("via"), F.col("b").alias("to"))
        longer = fresh.join(right, fresh["b"] == right["via"]).select("a", F.col("to").alias("b")).distinct()
        before, fresh = fresh, saved(longer.join(small(known), ["a", "b"], "left_anti"), "closure-new")
        if before is not known:
            discard(before)
        if not counted(fresh):
            discard(fresh)
            return known
        smaller, known = known, saved(known.unionByName(fresh), "closure")
        discard(smaller)
        if two_hop:
            return known
    raise FixpointError(f"no closure in {rounds} rounds")


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """All (a, b) with a of seeds (column a) and a path of one or more edges from a to b."""
    step = edges.select(F.col("a").alias("via"), F.col("b").alias("to")).where("via is not null and to is not null").distinct()
    step = saved(step, "edges")
    front = seeds.select("a", F.col("a").alias("b")).distinct()
    known: DataFrame | None = None
    for _ in range(rounds):
        met = front.join(small(step), front["b"] == F.col("via")).select("a", F.col("to").alias("b")).distinct()
        before, front = front, saved(met if known is None else met.join(known, ["a", "b"], "left_anti"), "front")
        if before is not known:
            discard(before)
        if not counted(front):
            discard(step)
            return front if known is None else known
        smaller, known = known, front if known is None else saved(known.unionByName(front), "reached")
        if smaller is not front and smaller is not before:
            discard(smaller)
    raise FixpointError(f"not all reached in {rounds} rounds")


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component): the smallest node of each connected component, for links (a, b).

    Each round every node goes to the one of itself and its neighbours with the smallest hash, and the links
    between the places gone to are the next, smaller graph. Hashes differ from round to round, so however nodes
    are named and arranged two thirds at most are expected to be left: a chain of n takes about log2(n) rounds.
    Then the last places are handed back round by round. Tables of few rows are broadcast, more are joined by a
    shuffle. A link with a null end counts for nothing, one from a node to itself makes the node known; no links
    give no rows.
    """
    ends = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = saved(ends.distinct(), "links")
    steps: list[DataFrame] = []
    while counted(edges):
        if len(steps) == rounds:
            raise FixpointError(f"components did not settle in {rounds} rounds")
        ranked = lambda c, k=len(steps): F.struct(F.xxhash64(F.lit(k), c), F.col(c).alias("at"))
        both = edges.union(edges.select("b", "a"))
        step = saved(both.groupBy("a").agg(F.min(ranked("b")).alias("first")).select(F.col("a").alias("node"), F.least("first", ranked("a"))["at"].alias("root")), "steps")
        to = lambda x, step=step: small(step).select(F.col("node").alias(x), F.col("root").alias(f"to_{x}"))
        moved = edges.where("a <> b").join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        before, edges = edges, saved(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        discard(before)
        steps.append(step)
    if not steps:
        return saved(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
    roots = steps[-1]
    written = [edges, *steps]
    for step in reversed(steps[:-1]):
        roots = saved(step.join(small(roots).select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
        written.append(roots)
    least = saved(roots.groupBy("root").agg(F.min("node").alias("component")), "least")
    labels = saved(roots.join(small(least), "root").select("node", "component"), "labels")
    discard(*written, least)
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of all links so far: labels (node, component) of the earlier ones, and the further links (a, b).

    Only what the further links join is looked at again: a graph whose nodes are the earlier components.
    """
    of = lambda x: small(labels).select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(ends.where("a <> b"))
    if not counted(joined):
        return labels
    to = small(joined).select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = labels.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    others = joined.join(small(labels).select("node"), "node", "left_anti")
    return saved(known.unionByName(others.select("node", "component")), "labels")
