"""Snapshots, differences and plans: full outer joins and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X


def snapshot(files: DataFrame, path: str, contents: str) -> DataFrame:
    """Snapshot entries: path, content and semantic hash, kind, exports of source files."""
    kind = P.file_kind(path)
    return files.select(
        F.col(path).alias("path"), X.hash16(contents).alias("content_hash"), X.semantic_hash(contents).alias("semantic_hash"), kind.alias("kind"),
        F.when(kind == "source", X.export_names(contents)).otherwise(F.array().cast("array<string>")).alias("exports"),
    )


def detect_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added and modified files of two snapshots: kind, path, old_path, categories, added, removed, confidence.

    A file that is gone shows only where a new one of its name stands in another
    directory: that pair is moved. Each old file takes the first such new one, in
    order of path.
    """
    none = F.array().cast("array<string>")
    b = before.select(*[F.col(c).alias(f"b_{c}") for c in before.columns], F.col("path"))
    joined = b.join(after, "path", "full")
    modified = F.col("b_path").isNotNull() & F.col("content_hash").isNotNull() & (F.col("b_content_hash") != F.col("content_hash"))
    semantic = F.col("b_semantic_hash") != F.col("semantic_hash")
    added, removed = F.array_except("exports", "b_exports"), F.array_except("b_exports", "exports")
    delta = (F.size(added) > 0) | (F.size(removed) > 0)
    by_kind = lambda k: F.when(k == "documentation", "documentation-only").when(k == "config", "configuration").when(k == "manifest", "dependency")
    base = F.array_compact(F.array(F.when(~semantic, "formatting-only"), by_kind(F.col("b_kind"))))
    more = F.array_compact(F.array(F.when(delta, "public-api").when((F.size(base) == 0) & semantic, "internal-implementation")))
    changed = joined.filter(modified).select(
        F.lit("modified").alias("kind"), "path", F.lit(None).cast("string").alias("old_path"), F.concat(base, more).alias("categories"),
        added.alias("added"), removed.alias("removed"), F.when(semantic, 0.9).otherwise(1.0).alias("confidence"),
    )
    gone = joined.filter("content_hash is null").select(F.col("b_path").alias("old_path"), F.col("b_exports").alias("old_exports"))
    new = joined.filter("b_path is null").select("path", F.col("kind").alias("new_kind"), "exports")
    moves = pair_moves(gone.select("old_path"), new.select("path"))
    moved = moves.join(gone, "old_path").join(new, "path")
    m_added, m_removed = F.array_except("exports", "old_exports"), F.array_except("old_exports", "exports")
    moved = moved.select(
        F.lit("moved").alias("kind"), "path", "old_path",
        F.array(F.when((F.size(m_added) > 0) | (F.size(m_removed) > 0), "public-api").otherwise("internal-implementation")).alias("categories"),
        m_added.alias("added"), m_removed.alias("removed"), F.lit(0.85).alias("confidence"),
    )
    fresh = new.join(moves, "path", "left_anti").select(
        F.lit("added").alias("kind"), "path", F.lit(None).cast("string").alias("old_path"),
        F.array(F.coalesce(by_kind(F.col("new_kind")), F.lit("public-api"))).alias("categories"),
        none.alias("added"), none.alias("removed"), F.lit(1.0).alias("confidence"),
    )
    return changed.unionByName(fresh).unionByName(moved)


def pair_moves(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (old_path, path) of one base name: the n-th old with the n-th new of that name."""
    rank = lambda c: F.row_number().over(Window.partitionBy(P.basename(c)).orderBy(c))
    a = gone.select("old_path", P.basename("old_path").alias("base"), rank("old_path").alias("n"))
    b = new.select("path", P.basename("path").alias("base"), rank("path").alias("n"))
    return a.join(b, ["base", "n"]).select("old_path", "path")


def change_weight(kind: Column | str = "kind", categories: Column | str = "categories") -> Column:
    """Weight of a change, 0 to 5."""
    has = lambda c: F.array_contains(X.col(categories), c)
    weight = F.greatest(
        F.lit(1), F.when(has("configuration"), 3).otherwise(1), F.when(has("dependency"), 2).otherwise(1),
        F.when(has("public-api"), 4).otherwise(1), F.when(has("architecture"), 3).otherwise(1),
    )
    weight = F.when(has("documentation-only"), F.least(weight, F.lit(1))).otherwise(weight)
    weight = F.when(has("formatting-only"), 0).otherwise(weight)
    return F.when((X.col(kind) == "removed") & has("public-api"), 5).otherwise(weight)


def impact_level(changes: DataFrame, stale: Column | None = None) -> DataFrame:
    """One row: level of a change set, number of changes and of semantic ones."""
    formatting = F.array_contains("categories", "formatting-only")
    broken = F.array_contains("categories", "public-api") & (F.size("removed") > 0)
    sums = changes.agg(
        F.count("*").alias("changed"), F.count_if(~formatting).alias("semantic"), F.max(change_weight()).alias("weight"),
        F.coalesce(F.bool_or(broken), F.lit(False)).alias("broken"),
    )
    level = (
        F.when(F.col("broken") | (stale if stale is not None else F.lit(False)), "critical").when(F.col("weight") >= 3, "high")
        .when(F.col("semantic") > 0, "medium").when(F.col("changed") > 0, "low").otherwise("none")
    )
    return sums.select(level.alias("level"), "changed", "semantic")


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """API changes between symbol tables: kind, severity, name.

    Columns: name, signature, arity, return_type, deprecated, file.
    """
    b = before.select("name", *[F.col(c).alias(f"b_{c}") for c in before.columns if c != "name"], F.lit(True).alias("b"))
    joined = b.join(after.withColumn("a", F.lit(True)), "name", "full")
    both = F.col("a") & F.col("b")
    breaking = (F.col("b_arity") != F.col("arity")) | ~F.col("b_return_type").eqNullSafe(F.col("return_type"))
    change = lambda when, kind, severity: F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    rules = F.array(
        change(F.col("a").isNull(), "removed", F.lit("breaking")),
        change(both & (F.col("b_signature") != F.col("signature")), "signature-changed", F.when(breaking, "breaking").otherwise("non-breaking")),
        change(both & ~F.col("b_deprecated") & F.col("deprecated"), "deprecated-added", F.lit("non-breaking")),
        change(both & ~F.col("b_file").eqNullSafe(F.col("file")), "moved", F.lit("non-breaking")),
        change(F.col("b").isNull(), "added", F.lit("additive")),
    )
    return joined.select("name", F.explode(F.array_compact(rules)).alias("c")).select("name", "c.kind", "c.severity")


def set_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys added and removed."""
    a, b = after.select(key).distinct(), before.select(key).distinct()
    side = lambda x, y, what: x.join(y, key, "left_anti").select(key, F.lit(what).alias("change"))
    return side(a, b, "added").unionByName(side(b, a, "removed"))


def changed_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages (slug, fingerprint) to regenerate or remove."""
    joined = before.select("slug", F.col("fingerprint").alias("old")).join(after, "slug", "full")
    action = F.when(F.col("fingerprint").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("fingerprint")), "regenerate")
    return joined.select("slug", action.alias("action")).filter("action is not null")


def audit_ownership(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Files that were modified, are missing, or are the user's; manifest (path, owner, content_hash), current (path, hash)."""
    joined = manifest.join(current, "path", "full")
    own = F.col("owner").isin("user-authored", "protected")
    state = (
        F.when(F.col("owner").isNull(), "user-file").when(own, None).when(F.col("hash").isNull(), "missing")
        .when(F.col("hash") != F.col("content_hash"), "modified")
    )
    return joined.select("path", state.alias("state")).filter("state is not null")


def plan_regeneration(manifest: DataFrame, candidates: DataFrame, force: bool = False) -> DataFrame:
    """Action for each slug.

    ``manifest``: path, slug, owner, content_hash, fingerprint. ``candidates``: path,
    slug, desired, disk_hash (null: not on disk), protected, conflicted.
    """
    m = manifest.select("path", F.col("slug").alias("m_slug"), "owner", "content_hash", "fingerprint")
    joined = candidates.withColumn("planned", F.lit(True)).join(m, "path", "full")
    absent, known = F.col("disk_hash").isNull(), F.col("owner").isNotNull()
    edited = known & ~absent & (F.col("disk_hash") != F.col("content_hash"))
    changed = ~F.col("fingerprint").eqNullSafe(F.col("desired"))
    planned = (
        F.when(absent & ~known, "create").when(F.col("protected"), "preserve").when(F.col("conflicted"), "conflict")
        .when(absent, "review").when(edited & F.lit(not force), "review").when(~changed & ~edited, "preserve").otherwise("update")
    )
    orphan = F.when(F.col("owner").isin("generated", "ai-generated"), "delete")
    action = F.when(F.col("planned"), planned).otherwise(orphan)
    return joined.select(F.coalesce("slug", "m_slug", "path").alias("slug"), action.alias("action")).filter("action is not null")


def plan_incremental(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (file, hash) to read again and those whose cached symbols can be reused."""
    old = cached.select("file", F.col("hash").alias("old"))
    return current.join(old, "file", "left").select("file", F.coalesce(F.col("hash") == F.col("old"), F.lit(False)).alias("reusable"))
