"""Graph operators over edge tables (src, dst and further columns).

Traversals are semi-naive: each round joins only the newest nodes with the edges,
drops what is known, and checkpoints, so the lineage stays flat and a lost
executor costs a round. Only counts and small fronts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import cut, spread

#: Nodes of a round that may be broadcast.
SMALL = 10_000

# Kinds of relations and their inverses.
INVERSE_KINDS = {
    "prerequisite": "nextStep", "nextStep": "previousStep", "previousStep": "nextStep", "exampleOf": "referenceFor",
    "referenceFor": "exampleOf", "configuredBy": "uses", "uses": "usedBy", "usedBy": "uses", "explains": "deepens",
    "deepens": "explains", "migrationFrom": "migrationTo", "migrationTo": "migrationFrom", "causedBy": "fixes",
    "fixes": "causedBy", "partOf": "belongsTo", "belongsTo": "partOf", "summarizes": "deepens",
}
DEPENDENCY_KINDS = ("prerequisite", "extends", "depends-on", "example-for")


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int = 10_000, include_seeds: bool = False) -> DataFrame:
    """``node``, ``depth``: all that ``seeds.node`` reach along src to dst, at their least depth.

    Seeds count only if they are reached again, unless ``include_seeds``.
    """
    links = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select(F.col("node")).distinct())
    size = front.count()
    known = front.select("node", F.lit(0).alias("depth")) if include_seeds else front.limit(0).select("node", F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        near = front.select(F.col("node").alias("src"))
        step = links.join(F.broadcast(near) if size <= SMALL else spread(near), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(spread(known), "node", "left_anti"))
        size = front.count()
        if not size:
            return known
        known = cut(known.unionByName(front.select("node", F.lit(depth).alias("depth"))))
    return known


def reversed_edges(edges: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def walked_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges that a walk from the seeds follows: those whose source is a seed or reached."""
    nodes = reachable(edges, seeds, include_seeds=True).select(F.col("node").alias("src"))
    return edges.join(spread(nodes), "src", "left_semi")


def ancestors(parents: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``, ``ancestor``, ``depth`` up a tree given as (node, parent)."""
    up = parents.filter("parent is not null").select(F.col("node").alias("from"), "parent")
    front = seeds.select("node", F.col("node").alias("at"))
    out = None
    depth = 0
    while True:
        depth += 1
        front = cut(front.join(up, F.col("at") == F.col("from")).select("node", F.col("parent").alias("at")))
        if front.isEmpty():
            return out if out is not None else front.select("node", F.col("at").alias("ancestor"), F.lit(0).alias("depth"))
        level = front.select("node", F.col("at").alias("ancestor"), F.lit(depth).alias("depth"))
        out = level if out is None else out.unionByName(level)


def leaves(parents: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return parents.select("node").join(parents.select(F.col("parent").alias("node")), "node", "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``incoming``, ``outgoing`` for every node, isolated ones too."""
    count = lambda c, name: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(name))
    both = nodes.join(count("dst", "incoming"), "node", "left").join(count("src", "outgoing"), "node", "left")
    return both.select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing")])


def relation_gaps(nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """Orphans, dead ends and underconnected nodes."""
    kind = (
        F.when(F.col("incoming") + F.col("outgoing") == 0, "orphan")
        .when((F.col("incoming") == 0) | (F.col("outgoing") == 0), "dead-end")
        .when(F.col("incoming") + F.col("outgoing") < least, "underconnected")
    )
    return degrees(nodes, edges).withColumn("kind", kind).filter("kind is not null")


def inverse_kind(kind: Column) -> Column:
    """The inverse of a relation's kind, null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in INVERSE_KINDS.items() for x in kv]), kind)


def mirror_inverse(relations: DataFrame) -> DataFrame:
    """Inverse edges that are not there yet, at nine tenths of the weight; columns src, dst, kind, weight."""
    mirrored = relations.select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), inverse_kind(F.col("kind")).alias("kind"), (F.col("weight") * 0.9).alias("weight")
    ).filter("kind is not null")
    return mirrored.join(relations.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")


def dependency_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(dependency, dependent) pairs between known nodes, of the kinds that order pages."""
    kept = relations.filter(F.col("kind").isin(*DEPENDENCY_KINDS) & (F.col("src") != F.col("dst")))
    kept = kept.join(spread(nodes.select(F.col("node").alias("src"))), "src", "left_semi").join(spread(nodes.select(F.col("node").alias("dst"))), "dst", "left_semi")
    return kept.select("src", "dst")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``level``: length of the longest chain before it; nodes on or behind a cycle have none."""
    links = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("node").distinct())
    done = left.limit(0).select("node", F.lit(0).alias("level"))
    level = 0
    while True:
        blocked = links.join(spread(left.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node"))
        ready = cut(left.join(spread(blocked), "node", "left_anti"))
        if ready.isEmpty():
            return done.unionByName(left.select("node", F.lit(None).cast("int").alias("level")))
        done = cut(done.unionByName(ready.select("node", F.lit(level).alias("level"))))
        left = cut(left.join(spread(ready), "node", "left_anti"))
        level += 1


def topological_order(levels: DataFrame) -> DataFrame:
    """Levels in reading order: by level, then name; nodes without a level last."""
    return levels.orderBy(F.col("level").asc_nulls_last(), "node")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that remain when nodes without an incoming or outgoing edge are taken off again and again."""
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    size = left.count()
    while size:
        kept = left.join(spread(left.select(F.col("dst").alias("src"))), "src", "left_semi")
        kept = cut(kept.join(spread(kept.select(F.col("src").alias("dst"))), "dst", "left_semi").select("src", "dst"))
        now = kept.count()
        if now == size:
            return kept
        left, size = kept, now
    return left


def weak_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: least node that it is connected to, by minimum labels and pointer jumps."""
    both = cut(edges.select("src", "dst").union(reversed_edges(edges)).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = cut(low.join(jump, "component").select("node", F.col("root").alias("component"), "moved"))
        if new.filter("moved").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")


def elementary_cycles(edges: DataFrame, max_length: int = 200) -> DataFrame:
    """Cycles of two or more nodes, each once, as an array that begins with its least node.

    Paths grow from their least node inside the cyclic core, so a cycle is found
    once and a path never leaves what can close.
    """
    core = cyclic_core(edges)
    paths = core.filter("src < dst").select(F.col("src").alias("start"), F.array("src", "dst").alias("path"))
    step = core.select(F.col("src").alias("tail"), F.col("dst").alias("next"))
    found = None
    for _ in range(2, max_length + 1):
        grown = cut(paths.withColumn("tail", F.element_at("path", -1)).join(spread(step), "tail").filter("next >= start"))
        closed = grown.filter("next = start").select("path")
        found = closed if found is None else found.unionByName(closed)
        paths = grown.filter(~F.array_contains("path", F.col("next"))).select("start", F.concat("path", F.array("next")).alias("path"))
        if paths.isEmpty():
            break
    return found if found is not None else core.select(F.array("src", "dst").alias("path")).limit(0)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind."""
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("element"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def rank_relations(relations: DataFrame, limit: int | None = None) -> DataFrame:
    """Relations of each source by weight, confidence, then label; ``rank`` from 1."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), F.desc("confidence"), "label", "dst")
    ranked = relations.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)
