"""Walks over trees against a recursive visitor."""

import random

from pyspark.sql import functions as F

from tessella.operators import tours


def visit(rows):
    """node -> (root, pre, post, depth, size) of a recursive depth-first walk."""
    below = {}
    for node, parent, at in rows:
        below.setdefault(parent, []).append((at, node))
    out, counts = {}, {}

    def walk(node, root, depth):
        pre = counts.setdefault(root, [0, 0])[0]
        counts[root][0] += 1
        size = sum(1 + walk(child, root, depth + 1) for _, child in sorted(below.get(node, []), key=lambda x: (x[0] is not None, x)))
        out[node] = (root, pre, counts[root][1], depth, size)
        counts[root][1] += 1
        return size

    for _, root in below.get(None, []):
        walk(root, root, 0)
    return out


def tree(spark, rows):
    return spark.createDataFrame(rows, "node long, parent long, at int").withColumn("size", F.lit("clash"))


def test_random_forests_and_a_long_chain(spark):
    rng = random.Random(11)
    rows = [(k, None if k % 40 == 0 else rng.randrange(k - k % 40, k), rng.randrange(5)) for k in range(200)]
    rows += [(1000, None, 0)] + [(1000 + k, 999 + k, 0) for k in range(1, 150)]
    got = {r.node: (r.root, r.pre, r.post, r.depth, r["size"]) for r in tours.tour(tree(spark, rows)).collect()}
    assert got == visit(rows)


def test_circles_unknown_parents_and_repeats(spark):
    rows = [(1, None, 0), (2, 1, 0), (2, 1, 0), (3, 4, 0), (4, 3, 0), (5, 99, 0), (6, 5, 0), (7, 3, 1)]
    walked = tours.tour(tree(spark, rows))
    assert sorted((r.node, r.pre, r.post) for r in walked.collect()) == [(1, 0, 1), (2, 1, 0)]
    assert tours.tour(tree(spark, rows).limit(0)).count() == 0


def test_filter_leaves_and_what_is_inside(spark):
    rows = [(1, None, 0), (2, 1, 1), (3, 1, 0), (4, 2, 0), (5, 4, 0), (6, 3, 0)]
    walked = tours.tour(tree(spark, rows))
    assert sorted(r.node for r in tours.leaves(walked).collect()) == [5, 6]
    below = tours.inside(walked, spark.createDataFrame([(2,), (3,), (5,), (4,)], "node long"))
    assert sorted(tuple(r) for r in below.collect()) == [(2, 4), (2, 5), (3, 6), (4, 5)]
    kept = tours.tour(tree(spark, rows), F.col("node") != 4)
    assert sorted(r.node for r in kept.collect()) == [1, 2, 3, 6]
