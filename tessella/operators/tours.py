"""Walks over trees: order of entering and leaving, depth and size, all nodes at once.

The walk of a depth-first visitor is a list of two steps a node, into it and out of it,
and each step knows the next: into the first child or out again, then into the next
sibling or out of the parent. Pointer doubling adds up what follows each step, in as
many rounds as the logarithm of the longest walk, however deep the tree is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import written


def tour(tree: DataFrame, keep: Column | None = None) -> DataFrame:
    """``node``, ``root``, ``parent``, ``pre``, ``post``, ``depth`` and ``size`` of the nodes of a forest.

    ``tree``: node, parent (null at a root), at (order among siblings, of equal ones by node).
    ``pre`` and ``post`` count from 0 in each tree; ``size`` counts the nodes below. With ``keep``,
    a condition on rows of ``tree``, branches whose row does not meet it are not entered. Repeated
    rows count once, of several parents the least; a node that hangs on no root, being in a circle
    or below an unknown node, is left out.
    """
    given = tree if keep is None else tree.filter(keep)
    t = written(given.groupBy("node").agg(F.min(F.struct("parent", "at")).alias("p")).select("node", "p.*"))
    siblings = Window.partitionBy("parent").orderBy("at", "node")
    placed = t.withColumn("next", F.when(F.col("parent").isNotNull(), F.lead("node").over(siblings))).withColumn("rank", F.row_number().over(siblings))
    first = placed.filter("parent is not null and rank = 1").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    steps = placed.join(first, "node", "left")
    into = F.struct(F.lit(False).alias("out"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).alias("d"), F.lit(0).alias("u"))
    out = F.struct(F.lit(True).alias("out"), F.coalesce("next", "parent").alias("to"), F.col("next").isNull().alias("to_out"), F.lit(0).alias("d"), F.lit(1).alias("u"))
    state = steps.select("node", F.explode(F.array(into, out)).alias("s")).select("node", "s.out", "s.to", F.when(F.col("s.to").isNotNull(), F.col("s.to_out")).alias("to_out"), F.col("s.d").cast("long").alias("d"), F.col("s.u").cast("long").alias("u"), F.col("node").alias("last"))
    state = written(state)
    left, before = state.filter("to is not null").count(), None
    while left and left != before:
        ahead = state.select(F.col("node").alias("to"), F.col("out").alias("to_out"), F.struct("to", "to_out", "d", "u", "last").alias("a"))
        met = state.join(ahead, ["to", "to_out"], "left")
        state = written(
            met.select("node", "out", F.col("a.to").alias("to"), F.col("a.to_out").alias("to_out"), (F.col("d") + F.coalesce("a.d", F.lit(0))).alias("d"), (F.col("u") + F.coalesce("a.u", F.lit(0))).alias("u"), F.when(F.col("to").isNull(), F.col("last")).otherwise(F.col("a.last")).alias("last"))
        )
        left, before = state.filter("to is not null").count(), left
    done = state.filter("to is null and last is not null")
    pair = done.filter("not out").select("node", F.col("last").alias("root"), F.col("d").alias("d_in"), F.col("u").alias("u_in")).join(done.filter("out").select("node", F.col("d").alias("d_out"), F.col("u").alias("u_out")), "node")
    # what follows the first step of a tree is all of it
    whole = pair.filter("node = root").select("root", F.col("d_in").alias("n")).join(t.filter("parent is null").select(F.col("node").alias("root")), "root", "left_semi")
    numbered = pair.join(whole, "root").select(
        "node", "root", (F.col("n") - F.col("d_in")).alias("pre"), (F.col("n") - F.col("u_out")).alias("post"), (F.col("u_in") - F.col("d_in")).alias("depth"), (F.col("d_in") - F.col("d_out") - 1).alias("size"),
    )
    return numbered.join(t.select("node", "parent"), "node").select("node", "root", "parent", "pre", "post", "depth", "size")


def leaves(walked: DataFrame) -> DataFrame:
    """The nodes with nothing below them, in order of the walk."""
    return walked.filter("size = 0")


def inside(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(top, node) for all nodes below those in ``nodes`` (node), by their numbers.

    A node below several of them is given for each.
    """
    tops = nodes.select("node").distinct().join(walked, "node").select(F.col("node").alias("top"), "root", F.col("pre").alias("low"), F.col("size").alias("below"))
    # the numbers below a node are known, so it meets them by equality
    wanted = tops.filter("below > 0").select("top", "root", F.explode(F.sequence(F.col("low") + 1, F.col("low") + F.col("below"))).alias("pre"))
    return wanted.join(walked.select("node", "root", "pre"), ["root", "pre"]).select("top", "node")
