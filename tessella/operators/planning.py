"""Planning, coverage and discovery: rules over page and project tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators.similarity import sharing_pairs

# Importance weights of a page.
IMPORTANCE = {
    "public_api": 0.25, "user_frequency": 0.15, "centrality": 0.15, "conceptual": 0.1, "entry_point": 0.1, "framework": 0.05,
    "configuration": 0.05, "learning": 0.1, "change_frequency": 0.05,
}
# Prefixes that group nothing.
STOP_PREFIXES = ("get", "set", "has", "is", "on", "the")
# Classes of files by name and extension, in order.
FILE_RULES = (
    (r"\.map$", "generated"), (r"\.tsbuildinfo$", "cache"), (r"\.snap$", "snapshot"), (r"(?:\.|_)(?:test|spec)\.[^.]+$|(?:^|/)(?:tests?|__tests__)/", "test"),
    (r"\.stories\.[^.]+$|(?:^|/)stories/", "story"), (r"\.bench\.[^.]+$|(?:^|/)(?:bench|benchmarks)/", "benchmark"), (r"\.(?:md|mdx|rst|adoc)$", "documentation"),
    (r"(?:^|/)(?:makefile|dockerfile)$", "script"), (r"\.(?:json|ya?ml|toml|ini)$|(?:^|/)\.[a-z]+rc$|\.config\.[^.]+$", "config"), (r"\.d\.[mc]?ts$", "declaration"),
    (r"\.(?:sh|bash|ps1)$", "script"), (r"\.(?:css|scss|less)$", "style"), (r"\.(?:png|jpe?g|gif|svg|webp|ico|woff2?|ttf|mp4)$", "asset"),
    (r"\.(?:tsx?|jsx?|mjs|cjs|py|rs|go|java|rb)$", "source"), (r"\.(?:txt|csv|xml|rss|atom|ics)$", "asset"), (r"\.(?:tmp|bak|swp)$", "temporary"),
)
# Script buckets in order.
SCRIPT_RULES = (("test|coverage|e2e", "testing"), ("lint|check|typecheck|format", "validation"), ("build|bundle|compile", "build"), ("publish|release|version", "publishing"), ("dev|start|watch|serve", "development"))


def file_class(path: Column | str) -> Column:
    """Category of a file by the first rule that its lower-cased path meets."""
    low = F.lower(X.col(path))
    out = F.when(low.rlike(FILE_RULES[0][0]), FILE_RULES[0][1])
    for pattern, name in FILE_RULES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


def script_class(name: Column | str) -> Column:
    """Bucket of a package script."""
    low = F.lower(X.col(name))
    out = F.when(low.rlike(SCRIPT_RULES[0][0]), SCRIPT_RULES[0][1])
    for pattern, bucket in SCRIPT_RULES[1:]:
        out = out.when(low.rlike(pattern), bucket)
    return out.otherwise("maintenance")


def importance(pages: DataFrame, total_apis: int, framework: bool = False) -> DataFrame:
    """Importance of pages (slug, kinds, symbols, section, canonical, dependents, churn), 0 to 1."""
    w = IMPORTANCE
    has = lambda k: F.array_contains("kinds", k)
    api = F.when(has("api") | has("cli-command"), w["public_api"] * F.least(F.lit(1.0), F.size("symbols") / F.lit(max(total_apis, 1)) + 0.4)).otherwise(0.0)
    frequency = F.when(F.col("slug") == "getting-started", 1.0).when(has("overview"), 0.8).when(has("guide"), 0.5).otherwise(0.0) * w["user_frequency"]
    learning = F.when(has("tutorial"), 1.0).when(has("guide"), 0.6).otherwise(0.0) * w["learning"]
    flag = lambda c, weight: F.when(c, weight).otherwise(0.0)
    score = (
        api + frequency + w["centrality"] * F.least(F.lit(1.0), F.coalesce("dependents", F.lit(0)) / 3) + flag(has("concept"), w["conceptual"])
        + flag(F.col("canonical"), w["conceptual"] * 0.5) + flag(has("overview"), w["entry_point"])
        + flag(F.lit(framework) & (F.col("section") == "core-concepts"), w["framework"]) + flag(has("configuration"), w["configuration"])
        + learning + w["change_frequency"] * F.coalesce("churn", F.lit(0.0))
    )
    return pages.withColumn("importance", X.clamp(score))


def coverage(items: DataFrame) -> DataFrame:
    """Documented share of each area (area, item, documented, excluded); areas with nothing in scope are left out."""
    scope = items.filter(~F.col("excluded"))
    return scope.groupBy("area").agg(F.count_if("documented").alias("documented"), F.count_if(~F.col("documented")).alias("gaps")).withColumn(
        "score", F.col("documented") / (F.col("documented") + F.col("gaps"))
    )


def shared_prefix(name: Column | str) -> Column:
    """First camel- or kebab-case part of three letters or more, null if there is none or it groups nothing."""
    part = F.regexp_extract(X.col(name), r"^([a-z]{3,})(?=[A-Z-])", 1)
    return F.when((part != "") & ~part.isin(*STOP_PREFIXES), part)


def concept_groups(concepts: DataFrame) -> DataFrame:
    """Concepts (ordinal, name) by shared prefix: group name, members in order."""
    prefix = shared_prefix("name")
    keyed = concepts.withColumn("prefix", prefix).withColumn("group", F.coalesce("prefix", "name"))
    grouped = keyed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name"))).alias("m"), F.max("prefix").alias("prefix"))
    name = F.when(F.size("m") > 1, F.col("group")).otherwise(F.get("m", F.lit(0))["name"])
    return grouped.select(name.alias("name"), F.transform("m", lambda x: x["name"]).alias("members"))


def planner_relations(pages: DataFrame) -> DataFrame:
    """Relations of planned pages (slug, ordinal, kinds, symbols, split_from): src, dst, kind."""
    has = lambda k: F.array_contains("kinds", k)
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    start = F.lit("getting-started")
    named = pages.filter("slug is not null")
    known = named.select("slug").distinct()
    # every end is a page's slug but for the start and what a page is split from, which are looked up
    there = known.filter(F.col("slug") == start).select(F.lit(True).alias("there"))
    first = edge(named.filter((F.col("slug") != start) & (has("concept") | has("api"))).join(F.broadcast(there)), start, F.col("slug"), "prerequisite")  # one row
    related = edge(sharing_pairs(named.select(F.col("slug").alias("k"), F.explode("symbols").alias("e"))), F.col("a"), F.col("b"), "related")
    w = Window.partitionBy("split_from").orderBy("ordinal")
    split = pages.filter("split_from is not null").withColumn("before", F.lag("slug").over(w)).filter("slug is not null")
    step = edge(split.filter("before is not null"), F.col("before"), F.col("slug"), "next-step")
    extends = edge(split.join(known.select(F.col("slug").alias("split_from")), "split_from", "left_semi"), F.col("split_from"), F.col("slug"), "extends")
    # pairs of related pages come once
    return first.distinct().unionByName(related).unionByName(step.distinct()).unionByName(extends.distinct())


def breadcrumbs(tree: DataFrame) -> DataFrame:
    """Trails (slug, ordinal, label) without a label that repeats the one before."""
    before = F.lag("label").over(Window.partitionBy("slug").orderBy("ordinal"))
    return tree.withColumn("_b", before).filter("_b is null or _b <> label").drop("_b")


def page_fingerprint(columns: list[str]) -> Column:
    """Fingerprint of what a page is made from."""
    return X.hash16(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]))


def environment_variables(files: DataFrame, path: str, content: str) -> DataFrame:
    """Variables that files read: name, last file in order, whether the name hints at a secret."""
    names = F.regexp_extract_all(F.col(content), F.lit(r"process\.env\.([A-Z][A-Z0-9_]*)"), F.lit(1))
    rows = files.select(F.col(path).alias("file"), F.explode(F.array_distinct(names)).alias("name"))
    return rows.groupBy("name").agg(F.max("file").alias("file")).withColumn("secret", X.is_secret_env_name("name"))


def directory_tree(files: DataFrame, path: str, depth: int = 5) -> DataFrame:
    """Directories of paths as (node, parent, depth), down to ``depth``."""
    parts = F.split(P.dirname(path), "/")
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("node"), k.alias("depth")))
    rows = files.filter(P.dirname(path) != ".").select(F.explode(levels).alias("d")).select("d.*").distinct()
    return rows.select("node", F.when(F.col("depth") == 1, ".").otherwise(P.dirname("node")).alias("parent"), "depth")


def validate_terms(used: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each used term as valid, suggestion or unknown; dictionary (canonical, aliases)."""
    known = dictionary.select(F.lower("canonical").alias("low")).distinct().withColumn("valid", F.lit(True))
    alias = dictionary.select(F.explode("aliases").alias("a"), "canonical").groupBy(F.lower("a").alias("low")).agg(F.min("canonical").alias("suggestion"))
    rows = used.withColumn("low", F.lower("term")).join(known, "low", "left").join(alias, "low", "left")
    status = F.when(F.col("valid"), "valid").when(F.col("suggestion").isNotNull(), "suggestion").otherwise("unknown")
    return rows.select("term", status.alias("status"), F.when(F.col("valid").isNull(), F.col("suggestion")).alias("suggestion"))
