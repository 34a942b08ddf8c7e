"""Merkle manifest of a dataset, built by superblocks.

Every row becomes a leaf, a SHA-256 over its columns, each written as ``-`` where
it is null and else as its UTF-8 length, a colon and its value. The leaves of a
group are numbered by the order columns. A superblock is a run of
``fanout ** levels`` neighbours: one ``applyInPandas`` call collapses that many
levels of it and gives each node its siblings on them. The roots of the blocks are
the nodes of the next round, until a group has one node, its subroot; the subroots,
in order of their groups, are reduced likewise to the root. Proofs are put together
from the top: a block's upper proof is joined to the nodes of the block, so every
join is on a key that at most ``fanout ** levels`` rows share.

Numbers come from a sort by range, a count for each partition and group, and
running sums of these counts; no group is ever gathered in one task, however large.
Each round is written to the shared folder.

Defined cases: null groups are one group, first in order; null ids come first in
their group, equal ids are ordered by their leaf; rows equal in all columns have
leaves of their own, side by side, interchangeable; a group of one row has its leaf
as subroot and an empty proof but for the groups' own levels; a table of one group
has its subroot as root; texts are hashed whole whatever their length; a run of one
node is hashed alone as long as its level has other nodes; extra columns are ignored
unless carried, in a struct, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import cut, scratch_path

FANOUT = 2
#: Levels that one call collapses.
LEVELS = 10
#: Rows of the small table of offsets that may be broadcast, about 100 bytes each.
BROADCAST_ROWS = 50_000


def field(value: Column) -> Column:
    """One column inside a leaf."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, concatenated."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse_block(digests: list[str], steps: int, fanout: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """Root of a block after ``steps`` levels, and for each node what stands before and after it in its run on each."""
    before: list[list[str]] = [[] for _ in digests]
    after: list[list[str]] = [[] for _ in digests]
    level, width = digests, 1
    for _ in range(steps):
        left, right, up = [], [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            left += ["".join(run[:k]) for k in range(len(run))]
            right += ["".join(run[k + 1 :]) for k in range(len(run))]
            up.append(hashlib.sha256("".join(run).encode()).hexdigest())
        for k in range(len(digests)):
            before[k].append(left[k // width])
            after[k].append(right[k // width])
        level, width = up, width * fanout
    return level[0], before, after


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``, the place inside the group from 0 on, and ``n``, the size of the group."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("_tie")]
    placed = cut(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_o", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_o", 33).alias("_part")
    parts = placed.groupBy(group, part).agg(F.count("*").alias("c"), F.min("_o").alias("_low"))
    whole = Window.partitionBy(group)
    ahead = F.sum("c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    offsets = cut(parts.select(group, "_part", "_low", ahead.alias("_ahead"), F.sum("c").over(whole).alias("n")))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    joined = placed.withColumn("_part", part).join(offsets, [group, "_part"])
    return joined.select(*rows.columns, (F.col("_o") - F.col("_low") + F.col("_ahead")).alias("idx"), "n")


def _superblocks(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of collapsing nodes (g, idx, n, digest, row) until each group has one node.

    A round holds g, idx, bucket, before, after, digest and n of the bucket's root, and the first ``row`` too.
    """
    spark, size, rounds = nodes.sparkSession, fanout**levels, []
    made = [
        T.StructField("bucket", T.LongType()), *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("before", "after")],
        T.StructField("digest", T.StringType()), T.StructField("n", T.LongType()),
    ]

    def collapse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = int(pdf["n"].iloc[0])
        root, before, after = collapse_block(pdf["digest"].tolist(), min(levels, height(n, fanout)), fanout)
        return pdf.drop(columns=["digest", "n"]).assign(bucket=key[1], before=before, after=after, digest=root, n=-(-n // size))

    while True:
        path = scratch_path(spark, "merkle")
        schema = T.StructType([f for f in nodes.schema.fields if f.name not in ("digest", "n")] + made)
        nodes.groupBy("g", F.expr(f"idx div {size}").alias("bucket")).applyInPandas(collapse, schema).write.parquet(path)
        rounds.append(spark.read.schema(schema).parquet(path))
        nodes = rounds[-1].filter(f"idx % {size} = 0").select("g", F.col("bucket").alias("idx"), "n", "digest")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds


def _proofs(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of the first round with whole proofs; ``tops`` has g, before, after and more columns of each group's root."""
    more = [c for c in tops.columns if c not in ("g", "before", "after")]
    above = tops.withColumn("bucket", F.lit(0).cast("long"))
    for k, own in enumerate(reversed(rounds)):
        upper = above.withColumnsRenamed({"before": "_before", "after": "_after"})
        above = own.drop("digest", "n").join(upper, ["g", "bucket"]).select(
            "g", F.col("idx").alias("bucket"), F.concat("before", "_before").alias("before"), F.concat("after", "_after").alias("after"),
            *more, *(["row"] if k == len(rounds) - 1 else []),
        )
    return above.withColumnRenamed("bucket", "idx")


def build(rows: DataFrame, group: Column, order: list[str], digest: Column, carry: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``row`` (struct of ``carry``), ``leaf``, ``idx`` in its group, ``before`` and ``after``, ``subroot``, ``root`` of every row.

    ``before[k]`` and ``after[k]`` hold the siblings on level k, concatenated: hashing
    before, digest and after, level by level, leads from the leaf to the root.
    """
    g = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("g")
    leaves = rows.select(
        g, digest.alias("digest"), F.struct(*[F.col(f"`{c}`").alias(f"_order{k}") for k, c in enumerate(order)]).alias("by"),
        F.struct(digest.alias("leaf"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")).alias("row"),
    )
    by = [F.col(f"by._order{k}").asc_nulls_first() for k in range(len(order))]
    rounds = _superblocks(ranked(leaves, "g", [*by, F.col("digest")]).drop("by"), fanout, levels)
    subroots = rounds[-1].select("g", "digest").distinct()
    own = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "g", [F.col("name")])
    upper = _superblocks(own.select("g", "idx", "n", "digest", F.struct("name", F.col("digest").alias("subroot")).alias("row")), fanout, levels)
    none = F.array().cast("array<string>")
    top = upper[-1].select("g", F.col("digest").alias("root")).distinct().select("g", none.alias("before"), none.alias("after"), "root")
    tops = _proofs(upper, top).select(F.col("row.name").alias("g"), "before", "after", "row.subroot", "root")
    return _proofs(rounds, tops).select("row.row", "row.leaf", "idx", "before", "after", "subroot", "root")


def fold(start: Column, before: Column | str = "before", after: Column | str = "after") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(F.arrays_zip(before, after), start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(before: str = "before", after: str = "after") -> Column:
    """All siblings of a proof, level by level, left to right, concatenated."""
    return F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "")
