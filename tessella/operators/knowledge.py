"""Knowledge graphs and relations from registered set functions.

A contributor turns tables into nodes and edges; it may need what others contributed, and
runs after them. A resolver turns pages into relations. What several give is one row
that names all of them: the first one's columns count, in order of registration.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graph, relations
from tessella.operators.common import written

NODE = ("id", "kind", "label", "file", "detail")
EDGE = ("src", "dst", "kind", "label")
RELATION = ("src", "dst", "kind", "label", "weight", "confidence")


class Graph(NamedTuple):
    """``nodes`` and ``edges`` of a contribution, or of a whole graph."""

    nodes: DataFrame | None
    edges: DataFrame | None


class Contributor(NamedTuple):
    """``build`` gets the input tables, and the contributions of those that it ``needs`` by id."""

    id: str
    build: Callable[[Mapping[str, DataFrame], Mapping[str, Graph]], Graph]
    needs: tuple[str, ...] = ()


def in_order(contributors: Sequence[Contributor]) -> list[Contributor]:
    """The contributors, each after those it needs, else as registered; raises where that cannot be."""
    ids = [c.id for c in contributors]
    if len(set(ids)) < len(ids):
        raise ValueError("a contributor is registered twice")
    out: list[Contributor] = []
    left = list(contributors)
    while left:
        done = {c.id for c in out}
        ready = next((c for c in left if set(c.needs) <= done), None)
        if ready is None:
            raise ValueError("contributors need each other or something unknown: " + ", ".join(c.id for c in left))
        out.append(ready)
        left.remove(ready)
    return out


def _merged(parts: list[tuple[int, str, DataFrame]], keys: tuple[str, ...], rest: tuple[str, ...]) -> DataFrame:
    """Rows of all parts, one for equal keys: the first part's columns, of repeats in it the least, and all parts' ids."""
    union = None
    for at, name, df in parts:
        row = df.select(*keys, *rest, F.lit(at).alias("_at"), F.lit(name).alias("_name"))
        union = row if union is None else union.unionByName(row)
    first = F.min(F.struct("_at", *rest)).alias("_f")
    named = F.transform(F.array_sort(F.collect_set(F.struct("_at", "_name"))), lambda x: x["_name"]).alias("sources")  # at most as many as there are parts
    return union.groupBy(*keys).agg(first, named).select(*keys, *[f"_f.{c}" for c in rest], "sources")


def build_graph(contributors: Sequence[Contributor], inputs: Mapping[str, DataFrame]) -> Graph:
    """The graph of all contributors: nodes by id, edges by kind, ends and label, each with its ``sources``.

    Edges have an ``id`` of kind and hash. An edge whose end is no node of the graph is left out.
    """
    at = {c.id: k for k, c in enumerate(contributors)}
    made: dict[str, Graph] = {}
    for c in in_order(contributors):
        made[c.id] = c.build(inputs, {n: made[n] for n in c.needs})
    nodes = _merged([(at[i], i, g.nodes) for i, g in made.items() if g.nodes is not None], ("id",), NODE[1:])
    edges = [(at[i], i, g.edges.withColumn("label", F.coalesce("label", F.lit("")))) for i, g in made.items() if g.edges is not None]
    merged = _merged([(k, i, e.withColumn("_one", F.lit(1))) for k, i, e in edges], EDGE, ("_one",)).drop("_one")
    known = nodes.select("id")
    for end in ("src", "dst"):
        merged = merged.join(known.withColumnRenamed("id", end), end, "left_semi")
    key = F.concat_ws("\x00", "src", "dst", "label")
    return Graph(nodes, merged.select(F.concat("kind", F.lit(":"), X.hash16(key)).alias("id"), *EDGE, "sources"))


def _structural(inputs: Mapping[str, DataFrame], needed: Mapping[str, Graph]) -> Graph:
    """Symbols as nodes; who owns whom, and the module of its file that each is declared in."""
    s = inputs["symbols"]
    kind = F.when(F.col("kind").isin("project", "package", "module"), F.col("kind")).otherwise("symbol")
    nodes = s.select("id", kind.alias("kind"), F.col("name").alias("label"), "file", F.col("qualified").alias("detail"))
    label = F.lit(None).cast("string").alias("label")
    owns = s.filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("owns").alias("kind"), label)
    modules = s.filter("kind = 'module' and file is not null").groupBy("file").agg(F.max("id").alias("dst"))
    declared = s.join(modules, "file").filter("id <> dst").select(F.col("id").alias("src"), "dst", F.lit("declared-in").alias("kind"), label)
    return Graph(nodes, owns.unionByName(declared))


# Kinds of references and of the edges they make.
REFERENCE_EDGES = {"import": "imports", "import-name": "imports-name", "export": "exports", "re-export": "re-exports", "heritage": "references", "type-use": "references"}


def _references(inputs: Mapping[str, DataFrame], needed: Mapping[str, Graph]) -> Graph:
    """Resolved references (kind, from_id, to_id, name, specifier) as edges, labelled by name or else by specifier."""
    kinds = F.create_map(*[F.lit(x) for kv in REFERENCE_EDGES.items() for x in kv])
    r = inputs["references"].filter("to_id is not null").withColumn("edge", F.try_element_at(kinds, F.col("kind"))).filter("edge is not null")
    return Graph(None, r.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("edge").alias("kind"), F.coalesce("name", "specifier").alias("label")))


STRUCTURAL = Contributor("structural", _structural)
REFERENCES = Contributor("references", _references)


class Resolver(NamedTuple):
    """``resolve`` turns pages into relations (src, dst, kind, label, weight, confidence)."""

    id: str
    resolve: Callable[[DataFrame], DataFrame]


def derive_relations(pages: DataFrame, resolvers: Sequence[Resolver], mirror: bool = True) -> DataFrame:
    """Relations of all resolvers, and their inverses where there are none yet: one row for equal ends and kind.

    Columns: src, dst, kind, label, weight, confidence, sources. Relations of a page with itself and
    those with an end that is no page (``slug``) are left out. A mirrored one has nine tenths of the
    weight, the confidence and label of the relation it mirrors, and the source ``mirror``; of
    several that mirror into one the heaviest counts.
    """
    known = pages.select("slug").distinct()
    found = _merged([(k, r.id, r.resolve(pages)) for k, r in enumerate(resolvers)], ("src", "dst", "kind"), ("label", "weight", "confidence")).filter("src <> dst")
    for end in ("src", "dst"):
        found = found.join(known.withColumnRenamed("slug", end), end, "left_semi")
    found = written(found.select(*RELATION, "sources"))
    if not mirror:
        return found
    turned = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), graph.inverse_kind(F.col("kind")).alias("kind"), (F.col("weight") * 0.9).alias("weight"), "confidence", "label").filter("kind is not null")
    best = turned.groupBy("src", "dst", "kind").agg(F.max(F.struct("weight", "confidence", "label")).alias("m")).join(found, ["src", "dst", "kind"], "left_anti")
    return found.unionByName(best.select("src", "dst", "kind", "m.label", "m.weight", "m.confidence", F.array(F.lit("mirror")).alias("sources")))


class Findings(NamedTuple):
    """What is to say about relations: cycles, gaps, one row of counts, and recommended actions."""

    cycles: DataFrame
    gaps: DataFrame
    counts: DataFrame
    actions: DataFrame


# What a gap calls for.
ACTIONS = {"orphan": "link-page", "dead-end": "add-next-step", "underconnected": "add-related"}


def actions_of(pages: DataFrame, links: DataFrame) -> DataFrame:
    """What each page (slug) that is linked (src, dst) too little calls for: slug, action, reason."""
    gaps = graph.relation_gaps(pages.select(F.col("slug").alias("node")).distinct(), links)
    wanted = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return gaps.select(F.col("node").alias("slug"), F.element_at(wanted, F.col("kind")).alias("action"), F.col("kind").alias("reason"))


def examine(pages: DataFrame, derived: DataFrame, directional: list[str]) -> Findings:
    """Cycles, gaps, counts and actions of derived relations."""
    links = derived.select("src", "dst").distinct()
    gaps = graph.relation_gaps(pages.select(F.col("slug").alias("node")).distinct(), links)
    return Findings(relations.relation_cycles(derived, directional), gaps, relations.relation_counts(derived, pages), actions_of(pages, links))
