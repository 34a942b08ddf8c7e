"""Relations between pages and symbols: deduplication, neighbours, cycles by kind, counts, filters."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import graph

#: Nodes and edges that :func:`alphabetical_order` takes; one worker holds them.
ORDER_ROWS = 5_000_000


def dedupe_relations(relations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of relations equal in ``keys`` the one that is first in ``order``."""
    rest = [c for c in relations.columns if c not in keys]
    best = relations.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return best.select(*keys, *[f"first.{c}" for c in rest])


def neighbours(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, other) of linked nodes that exist, either way round; with ``limit`` the first ones by name."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    found = both.distinct().join(nodes.select(F.col("node").alias("other")), "other", "left_semi").select("node", "other")
    if limit is None:
        return found
    return found.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("other"))).filter(F.col("at") <= limit).drop("at")


def related_pages(relations: DataFrame, page: Column, excluded: list[str]) -> DataFrame:
    """Relations that leave ``page``, without the excluded kinds, in order of rank."""
    return graph.rank_relations(relations.filter((F.col("src") == page) & ~F.col("kind").isin(*excluded)))


def relation_cycles(relations: DataFrame, directional: list[str]) -> DataFrame:
    """Cycles of the relations of each directional kind (hard) and of all others taken together, both ways round (soft)."""
    out = None
    for kind in directional:
        found = graph.elementary_cycles(relations.filter(F.col("kind") == kind).select("src", "dst"))
        found = found.select(F.lit(kind).alias("kind"), F.lit("hard").alias("severity"), "path")
        out = found if out is None else out.unionByName(found)
    loose = relations.filter(~F.col("kind").isin(*directional)).select("src", "dst")
    soft = graph.elementary_cycles(loose.unionByName(loose.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    soft = soft.select(F.lit("relatedTo").alias("kind"), F.lit("soft").alias("severity"), "path")
    return soft if out is None else out.unionByName(soft)


def relation_counts(relations: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: relations, kinds, pages with none, relations whose end is no page."""
    known = pages.select("slug").distinct()
    ends = relations.select(F.col("src").alias("slug")).unionByName(relations.select(F.col("dst").alias("slug")))
    alone = known.join(ends.distinct(), "slug", "left_anti").agg(F.count("*").alias("orphans"))
    broken = relations.join(known.select(F.col("slug").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("broken"))
    total = relations.agg(F.count("*").alias("relations"), F.count_distinct("kind").alias("kinds"))
    return total.join(F.broadcast(alone)).join(F.broadcast(broken))  # one row each


def repeated_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols (file, ordinal, name, parent) whose name the one before of that name has in the same scope, and unnamed ones."""
    before = Window.partitionBy("file", "name").orderBy("ordinal", "parent")
    marked = symbols.withColumn("number", F.row_number().over(before)).withColumn("last", F.lag("parent").over(before))
    code = F.when(F.col("name") == "", "unnamed-symbol").when((F.col("number") > 1) & F.col("last").eqNullSafe(F.col("parent")), "duplicate-symbol")
    return marked.withColumn("code", code).filter("code is not null").select("file", "ordinal", "name", "code")


def symbol_matches(kinds: list[str] | None = None, exported: bool | None = None, name: str | None = None, pattern: str | None = None) -> Column:
    """Predicate on symbols (kind, exported, name); what is not given does not filter."""
    out = F.lit(True)
    if kinds is not None:
        out = out & F.col("kind").isin(*kinds)
    if exported is not None:
        out = out & (F.col("exported") == exported)
    if name is not None:
        out = out & (F.col("name") == name)
    return out & F.col("name").rlike(pattern) if pattern is not None else out


def on_paths(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """Changes (path, old_path) of which either path is listed."""
    listed = paths.select(F.col("path").alias("_p")).distinct()
    return changes.join(listed, (F.col("path") == F.col("_p")), "left_semi").unionByName(
        changes.join(listed, F.col("path") == F.col("_p"), "left_anti").join(listed, F.col("old_path") == F.col("_p"), "left_semi")
    )


def reconcile(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What becomes of previous files (bucket, path, exists, generated) that are no longer planned: remove or keep."""
    gone = previous.filter("exists").join(current.select("bucket", "path").distinct(), ["bucket", "path"], "left_anti")
    return gone.select("bucket", "path", F.when(F.col("generated") | F.col("path").endswith(".json"), "remove").otherwise("keep").alias("action"))


def health(pages: Column, stale: Column, conflicts: Column) -> list[Column]:
    """Percentages of fresh pages and of pages without conflict, and of documented ones."""
    share = lambda n: F.when(pages > 0, F.floor(n * 100.0 / pages + 0.5)).otherwise(100).cast("long")
    return [
        share(pages - stale).alias("freshness"), share(pages - conflicts).alias("consistency"),
        F.when(pages > 0, 100).otherwise(0).cast("long").alias("coverage"),
    ]


def alphabetical_order(nodes: DataFrame, edges: DataFrame, most: int = ORDER_ROWS) -> DataFrame:
    """``position``, ``node`` (text): each time the alphabetically first node whose dependencies are placed; the cyclic rest last.

    ``nodes`` has node and, for the order of the rest, ordinal; ``edges`` lead from
    dependency to dependent. This order is sequential by nature, so it is for the
    graph of one site: more than ``most`` nodes and edges are refused, for which
    there is :func:`tessella.operators.graph.topological_levels`.
    """
    known = nodes.select(F.col("node").cast("string").alias("node"), "ordinal").dropDuplicates(["node"])
    links = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    size = known.count() + links.count()
    if size > most:
        raise ValueError(f"{size} nodes and edges are more than one worker is given")
    rows = known.select("node", "ordinal", F.lit(None).cast("string").alias("src")).unionByName(
        links.select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("ordinal"), "src")
    )

    def order(table: pa.Table) -> pa.Table:
        given, after, waits = [], {}, {}
        for node, ordinal, src in zip(*(table.column(c).to_pylist() for c in ("node", "ordinal", "src")), strict=True):
            if src is None:
                given.append((ordinal, node))
            else:
                after.setdefault(src, []).append(node)
                waits[node] = waits.get(node, 0) + 1
        ready = [node for _, node in given if not waits.get(node)]
        heapq.heapify(ready)
        placed, seen = [], set()
        while ready:
            node = heapq.heappop(ready)
            placed.append(node)
            seen.add(node)
            for other in after.get(node, ()):
                waits[other] -= 1
                if not waits[other]:
                    heapq.heappush(ready, other)
        placed += [node for _, node in sorted(given) if node not in seen]
        return pa.table({"position": pa.array(range(len(placed)), pa.int64()), "node": pa.array(placed, pa.string())})

    return rows.groupBy().applyInArrow(order, "position long, node string")
