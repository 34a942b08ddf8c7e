"""Duplicates, shared entities and close names.

Pairs come from equi-joins on what the two sides share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

#: Entities of a key that its rows take along when pairs are counted.
LISTED = 256


def first_by_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def duplicate_groups(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Groups of rows with one digest: digest, n, first key."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def _listed_pairs(rows: DataFrame) -> DataFrame:
    """a, b, na, nb, shared of the pairs among ``rows`` (k, e, n, s) that share an entity, without gathering pairs.

    A pair meets on each entity that it shares; it is counted from the two lists ``s`` and kept at the least of them.
    """
    a, b = rows.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"), "e"), rows.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), "e")
    common = F.array_intersect("sa", "sb")
    met = a.join(b.hint("merge"), "e").filter(F.col("a") < F.col("b")).filter(F.array_min(common) == F.col("e"))
    return met.select("a", "b", "na", "nb", F.size(common).cast("long").alias("shared"))


def sharing_pairs(rows: DataFrame, listed: int = LISTED) -> DataFrame:
    """a, b, na, nb, shared: each pair (a < b) of keys that share entities once, how many each has and both share; ``rows``: k, e.

    A key with at most ``listed`` entities takes its list along. Pairs with a longer one are
    gathered and counted. Null entities count in ``na`` and ``nb`` and are shared with nothing.
    """
    own = Window.partitionBy("k")
    sized = rows.filter("k is not null").repartition("k").distinct().withColumn("n", F.count(F.lit(1)).over(own))
    lists = sized.filter(F.col("n") <= listed).groupBy("k", "n").agg(F.collect_list("e").alias("s"))
    near = _listed_pairs(lists.select("k", "n", "s", F.explode("s").alias("e")))
    wide = sized.filter((F.col("n") > listed) & F.col("e").isNotNull()).select(F.col("k").alias("x"), F.col("n").alias("nx"), "e")
    met = sized.join(wide.hint("merge"), "e").filter((F.col("k") != F.col("x")) & ((F.col("n") <= listed) | (F.col("x") < F.col("k"))))
    turned = F.col("x") > F.col("k")
    ends = [F.when(turned, F.col(p)).otherwise(F.col(q)).alias(c) for p, q, c in (("k", "x", "a"), ("x", "k", "b"), ("n", "nx", "na"), ("nx", "n", "nb"))]
    return near.unionByName(met.select(*ends).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")))


def shared_entity_pairs(items: DataFrame, key: str, entity: str) -> DataFrame:
    """Pairs (a < b) of keys that share entities, how many, and the weight and confidence of their relation."""
    pairs = sharing_pairs(items.select(F.col(key).alias("k"), F.col(entity).alias("e")))
    return pairs.select(
        "a", "b", "shared", F.least(F.lit(1.0), 0.6 + 0.1 * F.col("shared")).alias("confidence"), F.least(F.lit(1.0), 0.25 * F.col("shared")).alias("weight")
    )


def subject_similarity(pairs: DataFrame, a: str, b: str) -> Column:
    """Shared tokens of two token arrays over the larger one's size."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def subject_classes(items: DataFrame, key: str, block: list[str], tokens: str) -> DataFrame:
    """a, b, similarity, member: pairs (a < b) of classes of a block, and each row ``b`` with its class ``a``.

    Rows of one block with the same set of tokens are a class, named by its least key. Two rows are
    as similar as their classes, so pairs grow with the texts that differ and not with their copies.
    """
    rows = items.select(F.col(key).alias("b"), *block, F.array_sort(F.array_distinct(tokens)).alias("t")).dropna(subset=["b", *block])
    classes = rows.groupBy(*block, "t").agg(F.min("b").alias("a"))
    met = classes.withColumnRenamed("t", "ta").join(classes.select(*block, F.col("a").alias("b"), F.col("t").alias("tb")), block).filter("a < b")
    held = classes.select(*[F.col(c).alias(f"_{c}") for c in block], F.col("t").alias("_t"), "a")
    own = held["_t"].eqNullSafe(rows["t"])
    for c in block:
        own = own & (held[f"_{c}"] == rows[c])
    members = rows.join(held, own)
    return met.select("a", "b", subject_similarity(met, "ta", "tb").alias("similarity"), F.lit(False).alias("member")).unionByName(
        members.select("a", "b", subject_similarity(members, "t", "t").alias("similarity"), F.lit(True).alias("member"))
    )


def containment(a: Column | str, b: Column | str) -> Column:
    """Whether the smaller of two sets lies in the other, and they share something."""
    shared = F.size(F.array_intersect(X.col(a), X.col(b)))
    return (shared > 0) & (shared == F.least(F.size(X.col(a)), F.size(X.col(b))))


def containment_pairs(items: DataFrame, key: str, elements: str) -> DataFrame:
    """Pairs (a < b) of keys of which one's element set holds the other's; rows of one key are taken together."""
    rows = items.select(F.col(key).alias("k"), F.explode(elements).alias("e"))
    return sharing_pairs(rows).filter("shared = least(na, nb)").select("a", "b", "shared")


def closest_names(targets: DataFrame, target: str, names: DataFrame, name: str, allowed: Column, fold: bool = True, unique: bool = True) -> DataFrame:
    """Nearest name of each target by edit distance, at most ``allowed``.

    With ``unique``, a tie for the least distance gives none; else the least name
    wins. Candidates meet on length: a name within d edits has a length within d,
    so an equi-join on the length buckets replaces comparing all pairs.
    """
    case = F.lower if fold else (lambda c: c)
    t = targets.select(F.col(target).alias("target")).distinct().withColumn("far", allowed.cast("int")).withColumn("t", case(F.col("target")))
    reach = F.sequence(F.greatest(F.length("t") - F.col("far"), F.lit(0)), F.length("t") + F.col("far"))
    t = t.withColumn("size", F.explode(reach))
    n = names.select(F.col(name).alias("name")).distinct().withColumn("n", case(F.col("name"))).withColumn("size", F.length("n"))
    pairs = t.join(n, "size").withColumn("distance", F.levenshtein("t", "n")).filter(F.col("distance") <= F.col("far"))
    near = pairs.groupBy("target", "distance").agg(F.min("name").alias("name"), F.count("*").alias("ties"))
    best = near.groupBy("target").agg(F.min(F.struct("distance", "name", "ties")).alias("best"))
    return (best.filter("best.ties = 1") if unique else best).select("target", "best.name", F.col("best.distance").cast("long").alias("distance"))


def longest_prefix(files: DataFrame, path: str, owners: DataFrame, owner: str) -> DataFrame:
    """Owner of each path: the longest directory prefix that is one; ``.`` owns what no other does.

    Each path offers its own prefixes, so the join is on equality.
    """
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))
    offered = files.withColumn("_prefix", F.explode(prefixes))
    known = owners.select(F.col(owner).alias("_prefix")).distinct()
    return offered.join(known, "_prefix").groupBy(path).agg(F.max_by("_prefix", F.when(F.col("_prefix") == ".", -1).otherwise(F.length("_prefix"))).alias("owner"))


def rename_similarity(a: Column | str, b: Column | str) -> Column:
    """Larger of shared name parts and nine tenths of the edit similarity."""
    x, y = F.lower(X.col(a)), F.lower(X.col(b))
    p, q = F.array_distinct(F.split(x, "[-_]")), F.array_distinct(F.split(y, "[-_]"))
    tokens = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q), F.lit(1))
    edits = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.greatest(tokens, edits * 0.9)
