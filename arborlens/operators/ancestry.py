"""Ancestors by binary lifting: depths, lowest common ancestors and distances in a number of rounds that grows with the logarithm of the depth.

A table of 2^k-th ancestors has a row for each node and power of two up to its depth, n log n rows in all, where a closure has one for each node and
ancestor. Nothing carries paths, and no task holds a tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlens.operators.graph import chain_heads, checkpointed, stored


@dataclass
class Lifting:
    """up: id, k, ancestor (the 2^k-th above); nodes: id, depth, root; powers: the number of values of k."""

    up: DataFrame
    nodes: DataFrame
    powers: int


def _doubled(parents: DataFrame) -> list[DataFrame]:
    """The tables (id, ancestor) of 2^k-th ancestors, k from 0, until none is left or, where parents form a cycle, 2^k exceeds the number of nodes."""
    n = parents.count()
    step = checkpointed(parents.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")))
    out = []
    while not step.isEmpty():
        out.append(step)
        if 1 << (len(out) - 1) > n:
            break
        step = checkpointed(step.join(step.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("id", F.col("next").alias("ancestor")))
    return out


def without_cycles(parents: DataFrame) -> DataFrame:
    """parents(id, parent) with each cycle cut above its smallest member, which becomes a root; forests stay as they are."""
    tables = _doubled(parents)
    n = parents.count()
    if not tables or 1 << (len(tables) - 1) <= n:
        return parents
    # What is more than n steps above something stands on a cycle, and on a cycle everything does.
    on = checkpointed(tables[-1].select(F.col("ancestor").alias("id")).distinct())
    least = on.select("id", F.col("id").alias("least"))
    for table in tables:
        above = table.join(least.select(F.col("id").alias("ancestor"), F.col("least").alias("other")), "ancestor")
        least = checkpointed(least.join(above.select("id", "other"), "id").select("id", F.least("least", "other").alias("least")))
    cut = least.where("id = least").select("id", F.lit(True).alias("cut"))
    return parents.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"))


def rooted(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parents(id, parent or null; parents that are no nodes themselves count as none, and the smallest of several holds) -> (the forest, with cycles cut; its nodes: id, depth, root).

    Each node jumps as far as the one it jumps to has come, and is done at a root, so a round moves only those that are not and no table of ancestors is made.
    """
    one = parents.groupBy("id").agg(F.min("parent").alias("parent"))
    known = one.join(one.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    forest = checkpointed(one.select("id").join(known, "id", "left"))
    climb = lambda f: chain_heads(f.where("parent IS NOT NULL").select(F.lit(0).cast("long").alias("view_id"), F.col("id").alias("element_id"), F.col("parent").alias("head")))
    hops = climb(forest)
    if not hops.where("open").isEmpty():
        # Only what is on a cycle or behind one is looked at again.
        lost = checkpointed(forest.join(hops.where("open").select(F.col("element_id").alias("id")), "id", "left_semi"))
        cut = without_cycles(lost).where("parent IS NULL").select("id", F.lit(True).alias("cut"))
        forest = checkpointed(forest.join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent")))
        hops = climb(forest)
    nodes = forest.where("parent IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"))
    return forest, nodes.unionByName(hops.select(F.col("element_id").alias("id"), F.col("head").alias("root"), F.col("steps").alias("depth")))


def lifting(parents: DataFrame) -> Lifting:
    """The ancestors of what rooted() gives."""
    forest, nodes = rooted(parents)
    tables = _doubled(forest)
    up = None
    for k, table in enumerate(tables):
        one = table.select("id", F.lit(k).alias("k"), "ancestor")
        up = one if up is None else up.unionByName(one)
    if up is None:
        up = forest.where("false").select("id", F.lit(0).alias("k"), F.col("id").alias("ancestor"))
    return Lifting(up, nodes, len(tables))


def _stepped(pairs: DataFrame, lift: Lifting, k: int, *sides: str) -> DataFrame:
    """pairs with up_<side>: the 2^k-th ancestor of each side, null where there is none."""
    for side in sides:
        pairs = pairs.join(lift.up.where(F.col("k") == k).select(F.col("id").alias(f"at_{side}"), F.col("ancestor").alias(f"up_{side}")), f"at_{side}", "left")
    return pairs


def _kept(pairs: DataFrame) -> DataFrame:
    """Pairs between rounds, in files whose size is known: few pairs are sent to the tables of ancestors, which then stay where they are."""
    return stored(pairs)[0]


def common_ancestors(lift: Lifting, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> a, b, lca, distance, for pairs of one tree: the deeper end is lifted to the other's depth, then both as far as they stay apart."""
    side = lambda p: lift.nodes.select(F.col("id").alias(p), F.col("depth").alias(f"d_{p}"), F.col("root").alias(f"r_{p}"))
    at = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where("r_a = r_b")
    # "at_a" is the deeper end.
    deeper = F.col("d_a") >= F.col("d_b")
    at = _kept(at.select("a", "b", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("at_a"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("at_b"), F.abs(F.col("d_a") - F.col("d_b")).alias("ahead"), (F.col("d_a") + F.col("d_b")).alias("depths")))
    kept = ["a", "b", "at_b", "depths"]
    for k in range(lift.powers):
        lifted = _stepped(at, lift, k, "a")
        now = F.col("ahead").bitwiseAND(F.lit(1 << k)) > 0
        at = _kept(lifted.select(*kept, "ahead", F.when(now, F.col("up_a")).otherwise(F.col("at_a")).alias("at_a")))
    for k in reversed(range(lift.powers)):
        lifted = _stepped(at, lift, k, "a", "b")
        apart = (F.col("at_a") != F.col("at_b")) & (F.col("up_a") != F.col("up_b"))
        move = lambda s, apart=apart: F.when(apart, F.col(f"up_{s}")).otherwise(F.col(f"at_{s}")).alias(f"at_{s}")
        at = _kept(lifted.select("a", "b", "depths", move("a"), move("b")))
    above = _stepped(at, lift, 0, "a").withColumn("lca", F.when(F.col("at_a") == F.col("at_b"), F.col("at_a")).otherwise(F.col("up_a")))
    named = above.join(lift.nodes.select(F.col("id").alias("lca"), F.col("depth").alias("d")), "lca")
    return named.select("a", "b", "lca", (F.col("depths") - 2 * F.col("d")).alias("distance"))


def ancestor_at(lift: Lifting, wanted: DataFrame) -> DataFrame:
    """wanted(id, steps) -> id, steps, ancestor: so many steps above; nothing where the root is nearer."""
    at = wanted.select("id", "steps", F.col("id").alias("at_a"))
    for k in range(lift.powers):
        now = F.col("steps").bitwiseAND(F.lit(1 << k)) > 0
        at = checkpointed(_stepped(at, lift, k, "a").where(~now | F.col("up_a").isNotNull()).select("id", "steps", F.when(now, F.col("up_a")).otherwise(F.col("at_a")).alias("at_a")))
    return at.where(F.col("steps") < (1 << lift.powers)).select("id", "steps", F.col("at_a").alias("ancestor"))
