"""Names and texts that match: substrings, renames paired one to one, and what changes call for.

No step compares all pairs: substrings meet on the rarest of a needle's grams, similar
names on shared grams or parts that both sides must have if they are similar enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.common import written
from tessella.operators.similarity import rename_similarity

#: Least similarity of a rename.
SIMILAR = 0.6
#: Pieces of names, under 100 bytes each, that may be broadcast.
BROADCAST_PIECES = 200_000
#: Pairs of an old and a new name, most of which never meet, that the probes of one task stand for, and the most tasks.
TASK_PAIRS, TASKS = 2_000_000, 4_000


def _grams(text: Column, n: int) -> Column:
    """The runs of ``n`` characters of a text, in order."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (key, needle) where the text holds the needle; an empty needle is in every text that is not null.

    A needle is looked up by its rarest run of three characters (or by itself if it is
    shorter), so only texts that have this run are compared with it.
    """
    t = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    wanted = needles.select(F.col(needle).alias("_needle")).filter("_needle is not null").distinct()
    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("_text"), n) for n in (1, 2, 3)]))
    offered = t.select("_key", "_text", F.explode(runs).alias("_gram"))
    short = wanted.filter(F.length("_needle") < 3).select("_needle", F.col("_needle").alias("_gram"))
    long = wanted.filter(F.length("_needle") >= 3).select("_needle", F.explode(F.array_distinct(_grams(F.col("_needle"), 3))).alias("_gram"))
    counts = offered.join(long.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = long.join(counts, "_gram", "left").groupBy("_needle").agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    met = offered.join(short.unionByName(rarest), "_gram").filter(F.contains("_text", F.col("_needle")))
    return met.select(F.col("_key").alias(key), F.col("_needle").alias(needle)).distinct()


def _cuts(size: Column, k: Column) -> tuple[Column, Column]:
    """Where the k-th of the ``size div 3 + 1`` pieces of a name of that size begins, and its length."""
    pieces = F.floor(size / 3) + 1
    base, short = F.floor(size / pieces), pieces - size % pieces
    return (k * base + F.greatest(F.lit(0), k - short)).cast("int"), (base + F.when(k >= short, 1).otherwise(0)).cast("int")


def _pieces(names: DataFrame) -> DataFrame:
    """name, size, k, piece: a name cut into one piece more than the edits that its similarity allows."""
    size = F.length("low")
    each = F.explode(F.transform(F.sequence(F.lit(0), F.floor(size / 3).cast("int")), lambda k: F.struct(k.alias("k"), *[c.alias(n) for c, n in zip(_cuts(size, k), ("at", "long"), strict=True)]))).alias("c")
    return names.select("name", "low", size.alias("size"), each).select("name", "size", "c.k", F.substring("low", F.col("c.at") + 1, F.col("c.long")).alias("piece"))


def _probes(names: DataFrame) -> DataFrame:
    """name, size, k, piece: what a name may have in common with the k-th piece of one of that size, its own or larger.

    With ``d`` edits in all there is a piece left whole that has exactly as many edits before it as
    pieces, so it stands at most ``k`` places off, and what follows it at most ``d - k``.
    """
    own = F.length("low")
    sizes = F.explode(F.filter(F.sequence(own, own + F.floor(own / 2).cast("int")), lambda x: x - own <= F.floor(x / 3))).alias("size")
    n = names.select("name", "low", own.alias("own"), sizes)
    n = n.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / 3).cast("int"))).alias("k"))
    at, long = _cuts(F.col("size"), F.col("k"))
    n = n.select("*", at.alias("at"), long.alias("long"), F.floor(F.col("size") / 3).cast("int").alias("d"))
    low = F.greatest(F.lit(0), F.col("at") - F.col("k"), F.col("at") + F.col("own") - F.col("size") - (F.col("d") - F.col("k")))
    high = F.least(F.col("own") - F.col("long"), F.col("at") + F.col("k"), F.col("at") + F.col("own") - F.col("size") + (F.col("d") - F.col("k")))
    places = F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high)))).alias("j")
    return n.select("name", "size", "k", "low", "long", places).select("name", "size", "k", F.substring("low", F.col("j") + 1, F.col("long")).alias("piece"))


def _parts(names: DataFrame) -> DataFrame:
    """name, part: the rarest parts of a name, so many that two names with six tenths of the larger number in common share one."""
    listed = names.select("name", F.explode(F.array_distinct(F.split("low", "[-_]"))).alias("part"), F.size(F.array_distinct(F.split("low", "[-_]"))).alias("size"))
    counts = listed.groupBy("part").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("c", "part"))
    ranked = listed.join(counts, "part").withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * SIMILAR) + 1).select("name", "part")


def similar_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (old, new, score) of names (column ``name`` of each) with a similarity of ``SIMILAR`` or more.

    Names are similar by edits, at most a third of the longer one, or by parts. For the first the longer
    name is cut into one piece more than there may be edits: one of them is in the other name, near the
    same place. Names meet on these pieces and on rare parts, and only those that met are compared.
    """
    named = lambda df: df.select("name").filter("name is not null").distinct().withColumn("low", F.lower("name"))
    a, b = written(named(old)), written(named(new))
    keys, shorter = ["size", "k", "piece"], F.length("old") < F.length("new")
    call = lambda df, name: df.withColumnRenamed("name", name)
    # a table of names is a few small files, each read by one task, but a name meets the more pieces the more names there are
    tasks = min(max(1, -(-a.count() * b.count() // TASK_PAIRS)), TASKS)
    p, q = written(_pieces(a)), written(_pieces(b))
    held = lambda df: F.broadcast(df) if df.count() <= BROADCAST_PIECES else df
    met = call(_probes(b.repartition(tasks)), "new").join(held(call(p, "old")), keys).select("old", "new")
    met = met.unionByName(call(_probes(a.repartition(tasks)), "old").join(held(call(q, "new")), keys).select("old", "new").filter(shorter))
    both = _parts(a.unionByName(b).distinct())
    met = met.unionByName(call(both.join(a, "name", "left_semi"), "old").join(call(both.join(b, "name", "left_semi"), "new"), "part").select("old", "new"))
    return met.distinct().withColumn("score", rename_similarity("old", "new")).filter(F.col("score") >= SIMILAR)


def match_in_order(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs: each old name in order takes the best new name left, of equal ones the first.

    ``pairs``: old, old_at, new, new_at, score; the places are unique. Every old name asks
    for its best; a new name goes to the first that asks, who can only lose it to an
    earlier one; what others wanted of it is struck out. That ends where taking in turn
    does, in rounds that each treat all names at once.
    """
    left = written(pairs.select("old", "old_at", "new", "new_at", "score"))
    while True:
        best = left.groupBy("old").agg(F.max_by(F.struct("old_at", "new"), F.struct("score", -F.col("new_at"))).alias("b"))
        held = written(best.groupBy(F.col("b.new").alias("new")).agg(F.min("b.old_at").alias("holder"), F.count("*").alias("n")))
        if held.filter("n > 1").isEmpty():
            return left.join(held.select("new", F.col("holder").alias("old_at")), ["new", "old_at"]).select("old", "new", "score")
        left = written(left.join(held.select("new", "holder"), "new", "left").filter("holder is null or old_at <= holder").select("old", "old_at", "new", "new_at", "score"))


def detect_renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (renamed, added, removed), old, new of two lists of names (name, at); of equal names the first counts."""
    first = lambda df: df.groupBy("name").agg(F.min("at").alias("at"))
    b, a = first(before), first(after)
    gone, fresh = written(b.join(a, "name", "left_anti")), written(a.join(b, "name", "left_anti"))
    pairs = similar_names(gone, fresh).join(gone.select(F.col("name").alias("old"), F.col("at").alias("old_at")), "old").join(fresh.select(F.col("name").alias("new"), F.col("at").alias("new_at")), "new")
    pairs = match_in_order(pairs)
    none = F.lit(None).cast("string")
    return (
        pairs.select(F.lit("renamed").alias("change"), "old", "new")
        .unionByName(fresh.join(pairs.select(F.col("new").alias("name")), "name", "left_anti").select(F.lit("added").alias("change"), none.alias("old"), F.col("name").alias("new")))
        .unionByName(gone.join(pairs.select(F.col("old").alias("name")), "name", "left_anti").select(F.lit("removed").alias("change"), F.col("name").alias("old"), none.alias("new")))
    )


def diff_project(before: DataFrame, after: DataFrame, keys: tuple[DataFrame, DataFrame], dependencies: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Source changes between two states of a project: kind, symbol, old_name, new_name.

    ``before`` and ``after``: name, at, signature, deprecated, in_favor_of. ``keys`` and
    ``dependencies`` are two tables each, with one column ``name``. A pair of renamed names is one
    change; a name in both may have a new signature, or be deprecated now.
    """
    named = detect_renames(before, after).select(
        F.col("change").alias("kind"), F.coalesce("new", "old").alias("symbol"), F.when(F.col("change") == "renamed", F.col("old")).alias("old_name"), F.when(F.col("change") == "renamed", F.col("new")).alias("new_name"),
    )
    last = lambda df: df.groupBy("name").agg(F.min_by(F.struct("signature", "deprecated", "in_favor_of"), "at").alias("v"))
    both = last(before).withColumnRenamed("v", "b").join(last(after), "name")
    none = F.lit(None).cast("string")
    signed = both.filter(~F.col("b.signature").eqNullSafe(F.col("v.signature"))).select(F.lit("signature-changed").alias("kind"), F.col("name").alias("symbol"), none.alias("old_name"), none.alias("new_name"))
    ended = both.filter(~F.coalesce("b.deprecated", F.lit(False)) & F.coalesce("v.deprecated", F.lit(False)))
    ended = ended.select(F.lit("deprecated").alias("kind"), F.col("name").alias("symbol"), F.col("name").alias("old_name"), F.col("v.in_favor_of").alias("new_name"))
    out = named.unionByName(signed).unionByName(ended)
    # keys are compared as sets, dependencies with repeats
    for kind, (b, a), count in (("configuration-changed", keys, F.max(F.lit(1).cast("long"))), ("dependency-changed", dependencies, F.count("*"))):
        tally = lambda df, count=count: df.groupBy("name").agg(count.alias("one"))
        odd = tally(b).withColumnRenamed("one", "x").join(tally(a), "name", "full").filter("not (x <=> one)")
        one = odd.agg(F.count("*").alias("n")).filter("n > 0")
        out = out.unionByName(one.select(F.lit(kind).alias("kind"), none.alias("symbol"), none.alias("old_name"), none.alias("new_name")))
    return out


# What a change does to the pages that have its symbol (or its old or new name, or are of a kind), and to the plan if none has.
#: (kind of change, what pages are met by, effect on them, what is created where none is met)
IMPACT = (
    ("added", "symbol", "regenerate", "api"), ("removed", "symbol", "regenerate", None), ("modified", "symbol", "regenerate", None), ("signature-changed", "symbol", "regenerate", None),
    ("behavior-changed", "symbol", "regenerate", None), ("renamed", "old", "relink", None), ("renamed", "new", "regenerate", None), ("moved", "old", "relink", None), ("moved", "new", "regenerate", None),
    ("deprecated", "symbol", "deprecate", "migration"), ("configuration-changed", "configuration", "regenerate", None), ("dependency-changed", "guide", "regenerate", None),
    ("dependency-changed", "overview", "regenerate", None), ("architecture-changed", "architecture", "regenerate", None),
)
#: Changes whose files touch pages with a symbol in the path.
BY_FILE = ("modified", "signature-changed", "behavior-changed")


def classify_impact(changes: DataFrame, pages: DataFrame) -> DataFrame:
    """What changes call for: effect (regenerate, relink, deprecate, create, navigation, rename), subject and, of a rename, target.

    ``changes``: kind, symbols (array), files (array), old_name, new_name. ``pages``: slug,
    symbols (array), kinds (array). Symbols that no page has are created (``api:name``), or if they
    are deprecated ask for one ``migration`` page. A deprecated change without symbols is about its
    old name. A file touches a page one of whose symbols, in lower case, stands in its path. Each
    row is given once. Changes of another kind have no effect.
    """
    spark = changes.sparkSession
    rules = spark.createDataFrame(IMPACT, "kind string, by string, effect string, create string")
    none = F.array().cast("array<string>")
    c = changes.select("kind", F.coalesce("symbols", none).alias("symbols"), F.coalesce("files", none).alias("files"), "old_name", "new_name", F.col("symbols").isNull().alias("unnamed"))
    both = F.col("old_name").isNotNull() & F.col("new_name").isNotNull()
    asked = (
        F.when(F.col("by") == "symbol", F.when((F.col("kind") == "deprecated") & F.col("unnamed"), F.array_compact(F.array(F.nullif("old_name", F.lit(""))))).otherwise(F.filter("symbols", lambda s: (s != "") | (F.col("kind") != "deprecated"))))
        .when(F.col("by") == "old", F.when(both, F.array("old_name"))).when(F.col("by") == "new", F.when(both, F.array("new_name")))
    )
    # a few constant rows
    ruled = c.join(F.broadcast(rules), "kind")
    by_symbol = ruled.filter("by in ('symbol', 'old', 'new')").select("effect", "create", F.explode(asked).alias("symbol")).distinct()
    owners = pages.select("slug", F.explode("symbols").alias("symbol")).distinct()
    met = by_symbol.join(owners, "symbol", "left")
    null = F.lit(None).cast("string")
    out = met.filter("slug is not null").select("effect", F.col("slug").alias("subject"), null.alias("target"))
    created = met.filter("slug is null and create is not null").select(F.lit("create").alias("effect"), F.when(F.col("create") == "api", F.concat(F.lit("api:"), "symbol")).otherwise(F.col("create")).alias("subject"), null.alias("target"))
    kinds = ruled.filter("by not in ('symbol', 'old', 'new')").select(F.col("by").alias("page_kind"), "effect").distinct()
    by_kind = pages.select("slug", F.explode("kinds").alias("page_kind")).join(F.broadcast(kinds), "page_kind").select("effect", F.col("slug").alias("subject"), null.alias("target"))
    files = c.filter(F.col("kind").isin(*BY_FILE)).select(F.explode("files").alias("file")).distinct()
    lowered = owners.withColumn("low", F.lower("symbol"))
    touched = contained(files, "file", "file", lowered, "low").select("low").distinct().join(lowered, "low").select(F.lit("regenerate").alias("effect"), F.col("slug").alias("subject"), null.alias("target"))
    moved = c.filter(F.col("kind").isin("renamed", "moved", "deprecated") & both).select(F.lit("rename").alias("effect"), F.col("old_name").alias("subject"), F.col("new_name").alias("target"))
    nav = c.filter("kind = 'architecture-changed'").select(F.lit("navigation").alias("effect"), null.alias("subject"), null.alias("target"))
    for more in (created, by_kind, touched, moved, nav):
        out = out.unionByName(more)
    return out.distinct()
