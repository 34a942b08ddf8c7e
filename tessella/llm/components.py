"""Connected components of an edge table, without bringing links to the driver.

Edges are first thinned inside each task to a spanning forest, which keeps every
connection. Then large-star and small-star rounds alternate until nothing moves:
each round hooks a node's neighbours to the smallest node known, so all that is
left is a star around the least node of each component. Minimums are aggregated
before the shuffle; the minimums of nodes with very many links, the centres of
large stars, are broadcast instead of shuffling all their links to one task. Each
round is checkpointed in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, join_unique

#: Edges that a task thins at a time.
CHUNK = 500_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of an edge list that are not least."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[left], least[right])
        np.minimum.at(least, least[left], low)
        np.minimum.at(least, least[right], low)
        while True:  # point every node at its root
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        if (before == least).all():
            break
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _thinned(edges: DataFrame) -> DataFrame:
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                size += batch.num_rows
            if size >= CHUNK:
                held = [spanning_forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                # a forest has fewer edges than nodes; what is still large goes out as it is
                if len(held[0][0]) > CHUNK // 2:
                    yield _batch(*held[0])
                    held = []
                size = len(held[0][0]) if held else 0
        if held:
            yield _batch(*spanning_forest(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return edges.mapInArrow(run, "u long, v long")


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component`` (least node reachable) for every node that has an edge to another.

    Nulls and self-loops are no links; repeated edges change nothing; without
    edges the result is empty.
    """
    links = _thinned(
        edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
        .filter("u is not null and v is not null and u <> v")
    )
    # from here on u > v
    state = cut(links.distinct())
    seen = None
    while True:
        mark = state.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if not mark["n"] or (mark["n"], mark["h"]) == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = (mark["n"], mark["h"])
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        low = low.select("u", F.least("u", "least").alias("m"), "n")
        large = (
            join_unique(both.filter("v > u"), low, "u", "n", 2 * mark["n"], ["m"]).filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_unique(large, low, "u", "n", mark["n"], ["m"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
