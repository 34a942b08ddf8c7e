"""Structure of a corpus: cycles by kind, ownership, architecture differences, generated links, page orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import spread
from tessella.operators.graph import elementary_cycles

#: Kinds of generated links that name something in the model, and the finding where it is missing.
MODEL_KINDS = {"page": "missing-page", "api": "missing-api", "concept": "missing-concept"}
ASSUMED_KINDS = ("external", "anchor")


def typed_cycles(edges: DataFrame, max_length: int = 200) -> DataFrame:
    """Cycles inside each kind of edges (src, dst, kind, resolved): kind, nodes from the least one on, resolved.

    A cycle is resolved if all its edges are; an edge given twice is if it is once.
    """
    node = lambda c: F.struct("kind", F.col(c).alias("id")).alias(c)
    path = elementary_cycles(edges.select(node("src"), node("dst")), max_length)
    cycles = path.select(F.element_at("path", 1)["kind"].alias("kind"), F.transform("path", lambda x: x["id"]).alias("nodes"))
    turned = F.concat(F.slice("nodes", F.lit(2), F.size("nodes")), F.slice("nodes", 1, 1))
    hops = cycles.select("kind", "nodes", F.explode(F.arrays_zip(F.col("nodes").alias("src"), turned.alias("dst"))).alias("hop"))
    known = edges.filter("resolved").select("kind", "src", "dst").distinct().withColumn("known", F.lit(True))
    met = hops.select("kind", "nodes", "hop.*").join(spread(known), ["kind", "src", "dst"], "left")
    return met.groupBy("kind", "nodes").agg(F.every(F.coalesce("known", F.lit(False))).alias("resolved"))


def ownership_tree(symbols: DataFrame) -> DataFrame:
    """Symbols (id, parent) as a tree: position among the children of a known parent, number of children, whether a root.

    A symbol whose parent is unknown hangs nowhere and is no root.
    """
    s = symbols.select("id", "parent").distinct()
    ids = s.select(F.col("id").alias("parent")).distinct()
    hung = s.filter("parent is not null").join(ids, "parent", "left_semi")
    placed = hung.select("id", "parent", F.row_number().over(Window.partitionBy("parent").orderBy("id")).cast("long").alias("position"))
    sizes = hung.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return s.join(placed, ["id", "parent"], "left").join(sizes, "id", "left").select(
        "id", "parent", "position", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("parent").isNull().alias("root")
    )


def diff_architecture(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes between two snapshots of pages (slug, fingerprint): slug, change (added, removed or updated)."""
    a = before.select("slug", F.struct("fingerprint").alias("old"))
    b = after.select("slug", F.struct("fingerprint").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return a.join(b, "slug", "full").select("slug", change.alias("change")).filter("change is not null")


def summarize_architecture(changes: DataFrame, navigation_changed: Column, archetypes_changed: Column) -> DataFrame:
    """One row over :func:`diff_architecture`: counts, the two flags, and whether nothing changed."""
    counts = [F.count_if(F.col("change") == k).alias(f"n_{k}") for k in ("added", "removed", "updated")]
    return changes.agg(*counts).select(
        "*", navigation_changed.alias("navigation_changed"), archetypes_changed.alias("archetypes_changed"),
        (F.expr("n_added + n_removed + n_updated = 0") & ~navigation_changed & ~archetypes_changed).alias("is_empty"),
    )


def validate_generated_links(links: DataFrame, model: DataFrame) -> DataFrame:
    """Links (kind, target and more) with ``valid`` and ``finding``, by the names of each kind in the model (kind, name).

    External links and anchors are taken as valid, other kinds without a model as
    invalid. The closest slug of a missing page is ``similarity.closest_names``.
    """
    names = model.select("kind", F.col("name").alias("target")).distinct().withColumn("_found", F.lit(True))
    modelled = F.col("kind").isin(*MODEL_KINDS)
    valid = F.coalesce(F.when(modelled, F.col("_found").isNotNull()).otherwise(F.col("kind").isin(*ASSUMED_KINDS)), F.lit(False))
    code = F.lit("unknown-kind")
    for kind, missing in MODEL_KINDS.items():
        code = F.when(F.col("kind") == kind, missing).otherwise(code)
    found = links.join(names, ["kind", "target"], "left").withColumn("valid", valid).drop("_found")
    return found.withColumn("finding", F.when(~F.col("valid"), code))


def category_positions(pages: DataFrame) -> DataFrame:
    """Pages (category, order, ordinal and more) with their position within the category, ties as they came."""
    w = Window.partitionBy("category").orderBy(F.col("order").asc_nulls_last(), "ordinal")
    return pages.withColumn("position", F.row_number().over(w).cast("long"))


def by_importance(pages: DataFrame) -> DataFrame:
    """Pages (importance, ordinal and more), most important first, ties as they came; a distributed sort."""
    return pages.orderBy(F.col("importance").desc_nulls_last(), "ordinal")
