"""Incremental work: what to compile again, versions committed one after the other, caches kept within bounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.common import written


def dependents(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``file`` of all that depend on the changed files (``file``), directly or not, in rounds; circles end."""
    edges = dependencies.select(F.col("dependency").alias("at"), "file").distinct()
    known = front = written(changed.select("file").distinct())
    while True:
        step = front.select(F.col("file").alias("at")).join(edges, "at").select("file").distinct()
        front = written(step.join(known, "file", "left_anti"))
        if front.isEmpty():
            return known.join(changed.select("file"), "file", "left_anti")
        known = written(known.unionByName(front))


def plan_compile(files: DataFrame, units: DataFrame, dependencies: DataFrame) -> DataFrame:
    """What each file calls for: file, action (compile, cached, skipped, removed), reason, renamed_from.

    ``files``: file, hash, handled (a compiler takes it), in order of ``file``. ``units``: file,
    hash of what was compiled before. ``dependencies``: file, dependency, as they were then. A file
    is compiled if it is new or has another hash (``changed``) or depends on such a one
    (``affected``). A removed file whose hash a changed one has now was renamed: the first such
    file gets it, and of several old names the last. Repeated rows count once.
    """
    now = files.select("file", "hash", "handled").distinct()
    old = units.select("file", F.col("hash").alias("old")).distinct()
    met = written(now.join(old, "file", "full"))
    changed = F.col("handled") & ~F.col("hash").eqNullSafe(F.col("old"))
    news = met.filter(changed)
    touched = dependents(news, dependencies).withColumn("affected", F.lit(True))
    first = news.groupBy("hash").agg(F.min("file").alias("file"))
    gone = met.filter("handled is null").select(F.col("file").alias("was"), F.col("old").alias("hash"))
    renamed = first.join(gone, "hash").groupBy("file").agg(F.max("was").alias("renamed_from"))
    reason = F.when(changed, "changed").when(F.col("handled") & F.col("affected"), "affected")
    action = F.when(F.col("handled").isNull(), "removed").when(~F.col("handled"), "skipped").when(reason.isNotNull(), "compile").otherwise("cached")
    return met.join(touched, "file", "left").join(renamed, "file", "left").select("file", action.alias("action"), reason.alias("reason"), "renamed_from")


class StaleWriter(RuntimeError):
    """Another writer committed the version first."""


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the last committed version, 0 if there is none."""
    place, store = _store(spark, f"{root}/commits")
    if not store.exists(place):
        return 0
    return max((int(s.getPath().getName()) for s in store.listStatus(place) if s.getPath().getName().isdigit()), default=0)


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The table of a committed version."""
    place, store = _store(spark, f"{root}/commits/{version}")
    stream = store.open(place)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{root}/data/{name}")


def commit_version(table: DataFrame, root: str, base: int) -> int:
    """Writes ``table`` as the version after ``base`` and returns its number.

    The data are written under a name of their own; the version exists once a file that names
    them was created under its number, which fails if there is one. So readers never see half
    a version, and a writer that started from an older one raises :class:`StaleWriter`.
    """
    spark, name = table.sparkSession, uuid.uuid4().hex
    table.write.parquet(f"{root}/data/{name}")
    # the name is whole before the number can be seen: written aside, then moved, which never overwrites
    aside, store = _store(spark, f"{root}/commits/.{name}")
    out = store.create(aside, False)
    out.write(bytearray(name.encode()))
    out.close()
    place, _ = _store(spark, f"{root}/commits/{base + 1}")
    if current_version(spark, root) != base or store.exists(place) or not store.rename(aside, place):
        store.delete(aside, False)
        raise StaleWriter(f"version {base + 1} of {root} is there already")
    return base + 1


def update(files: DataFrame, dependencies: DataFrame, root: str, compile_files: Callable[[DataFrame], DataFrame], base: int | None = None) -> tuple[int, DataFrame]:
    """One incremental update as a transaction: the new version and the plan that led to it.

    ``compile_files`` turns the rows of ``files`` (file, hash, handled and more) that must be compiled
    into units (file and columns of its own), and sees no others. A version holds file, hash,
    compiled_in and those columns. Units of files that are still there and not touched are taken
    over. ``dependencies`` are those of the last version. ``base`` is the version that was read,
    the current one if not given.
    """
    spark = files.sparkSession
    base = current_version(spark, root) if base is None else base
    old = read_version(spark, root, base) if base else None
    units = old.select("file", "hash") if old is not None else files.select("file", "hash").limit(0)
    plan = written(plan_compile(files, units, dependencies))
    todo = plan.filter("action = 'compile'").select("file")
    made = compile_files(files.join(todo, "file", "left_semi"))
    fresh = made.join(files.select("file", "hash").distinct(), "file").withColumn("compiled_in", F.lit(base + 1))
    kept = plan.filter("action = 'cached'").select("file")
    result = fresh if old is None else fresh.unionByName(old.join(kept, "file", "left_semi"))
    return commit_version(result, root, base), plan


def running(rows: DataFrame, order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """``rows`` with running totals over all of them in an order: a column for each amount, its own included.

    Rows are sorted by range; each partition adds up its own, and takes what those before it add
    up to from a table of one row a partition.
    """
    tied = rows.withColumns({f"_{n}": a for n, a in amounts.items()} | {"_tie": F.monotonically_increasing_id()})
    keys = [*order, F.col("_tie")]
    placed = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_o", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_o", 33)))
    whole = placed.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in amounts])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in amounts])
    own = Window.partitionBy("_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(offsets), "_part")  # as many rows as partitions
    return joined.select(*rows.columns, *[(F.col(f"_before_{n}") + F.coalesce(F.sum(f"_{n}").over(own), F.lit(0))).alias(n) for n in amounts])


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts, each with its length, so that no two lists of parts meet."""
    text = [F.coalesce(X.col(p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(";", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in text]), 256)


def evict(entries: DataFrame, now: Column, ttl: Column | None = None, max_entries: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Each cache entry's ``fate``: expired, corrupt, evicted or kept.

    ``entries``: key, at (when it was set; of repeated keys the last counts), size, checksum (null:
    none was taken), actual (of what is stored, null if it is gone). What is neither expired nor
    corrupt is kept from the newest on, of equal times by key, as long as number and bytes allow;
    the first entry that does not fit and all older ones are evicted.
    """
    newest = entries.groupBy("key").agg(F.max_by(F.struct("at", "size", "checksum", "actual"), F.struct("at", "checksum", "actual")).alias("e")).select("key", "e.*")
    bad = F.col("actual").isNull() | (F.col("checksum").isNotNull() & (F.col("checksum") != F.col("actual")))
    dead = F.when(now - F.col("at") > ttl, "expired") if ttl is not None else F.lit(None).cast("string")
    state = newest.withColumn("fate", F.coalesce(dead, F.when(bad, "corrupt")))
    held = running(state.filter("fate is null"), [F.desc("at"), F.col("key")], {"_n": F.lit(1).cast("long"), "_bytes": F.coalesce("size", F.lit(0)).cast("long")})
    out = F.lit(False)
    if max_entries is not None:
        out = out | (F.col("_n") > max_entries)
    if max_bytes is not None:
        out = out | (F.col("_bytes") > max_bytes)
    fated = held.withColumn("fate", F.when(out, "evicted").otherwise("kept")).drop("_n", "_bytes")
    return fated.unionByName(state.filter("fate is not null")).select("key", "at", "size", "fate")


def clean_state(namespaces: DataFrame, classes: DataFrame, remove: list[str]) -> DataFrame:
    """Paths to remove: namespaces (name, path, exists) whose retention class (``classes``: name, retention) is asked for."""
    chosen = classes.filter(F.col("retention").isin(*remove)).select("name", "retention").distinct()
    return namespaces.filter("exists").join(chosen, "name").select("name", "path", "retention")
