"""Project discovery, summaries, ownership markers and output checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators.common import cut
from tessella.sources.sinks import MARKER


def by_module(symbols: DataFrame, file: str) -> DataFrame:
    """Symbols of each directory of source files: module, n."""
    return symbols.groupBy(P.dirname(file).alias("module")).agg(F.count("*").alias("n"))


def link_summary(resolved: DataFrame) -> DataFrame:
    """Totals of link statuses; the rate of valid ones is 1 where there are none."""
    valid = F.count_if(F.col("status").isin("ok", "alias", "external"))
    return resolved.agg(F.count("*").alias("total"), valid.alias("valid"), F.coalesce(F.try_divide(valid, F.count("*")), F.lit(1.0)).alias("rate"))


def review_summary(reviews: DataFrame) -> DataFrame:
    """Mean number of rounds and mean last score of reviews (scores)."""
    return reviews.filter("size(scores) > 0").agg(F.avg(F.size("scores")).alias("rounds"), F.avg(F.element_at("scores", -1)).alias("last"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Errors, warnings and notes."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "notes"))])


def resolve_dotted(names: DataFrame, members: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``target`` of dotted names (name), member by member through members (owner, member, target); roots have a null owner.

    As many parts are resolved as the longest name has; a name of more than ``max_depth`` has no target.
    """
    state = names.select("name", F.split("name", r"\.").alias("p"), F.lit(None).cast("string").alias("at"), F.lit(True).alias("ok"))
    m = members.select("owner", "member", "target")
    longest = names.agg(F.max(F.size(F.split("name", r"\.")))).first()[0] or 0
    depth = longest if max_depth is None else min(longest, max_depth)
    state = state.withColumn("ok", F.size("p") <= depth)
    for k in range(depth):
        if k % 8 == 7:
            state = cut(state)
        step = F.get("p", F.lit(k))
        left = state.withColumn("step", step)
        joined = left.join(m, left["at"].eqNullSafe(m["owner"]) & (left["step"] == m["member"]), "left")
        moved = F.col("step").isNotNull()
        state = joined.select("name", "p", F.when(moved, F.col("target")).otherwise(F.col("at")).alias("at"), (F.col("ok") & (~moved | F.col("target").isNotNull())).alias("ok"))
    return state.select("name", F.when(F.col("ok"), F.col("at")).alias("target"))


def first_by_precedence(found: DataFrame, group: str, name: str, order: list[str]) -> DataFrame:
    """Of each group's names the one that stands first in ``order``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name))
    return found.withColumn("_r", rank).filter("_r > 0").groupBy(group).agg(F.min_by(name, "_r").alias(name))


def detect_languages(signals: DataFrame) -> DataFrame:
    """Languages of each project by summed signal weight, at most 1, strongest first; signals (project, language, weight)."""
    sums = signals.groupBy("project", "language").agg(F.least(F.lit(1.0), F.sum("weight")).alias("confidence"))
    w = Window.partitionBy("project").orderBy(F.desc("confidence"), "language")
    return sums.withColumn("rank", F.row_number().over(w).cast("long"))


def related_lists(relations: DataFrame) -> DataFrame:
    """Targets of each page in order of name, each once."""
    return relations.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("related"))


def journey(pages: DataFrame, order: list[str]) -> DataFrame:
    """Existing slugs of a fixed reading order, with their position."""
    ordered = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("slug"))
    return pages.select("slug", ordered.alias("position")).filter("position > 0")


def is_generated(content: Column | str) -> Column:
    """Whether a text carries the ownership marker."""
    return F.contains(X.col(content), F.lit(MARKER))


def mark_generated(content: Column | str) -> Column:
    """The text with the marker in front, once."""
    c = X.col(content)
    return F.when(is_generated(c), c).otherwise(F.concat(F.lit(MARKER + "\n"), c))


def strip_marker(content: Column | str) -> Column:
    """The text without the marker and the line end after it."""
    return F.regexp_replace(X.col(content), r"\Q" + MARKER + r"\E\n?", "")


def export_target(packages: DataFrame, specifiers: DataFrame) -> DataFrame:
    """Whether a package exports what a specifier names: packages (name, main, exports map), specifiers (specifier)."""
    rows = specifiers.withColumn("name", X.package_name("specifier")).join(packages, "name", "left")
    inner = F.concat(F.lit("./"), F.regexp_replace(F.substr("specifier", F.length("name") + 1), "^/", ""))
    whole = F.col("specifier") == F.col("name")
    entry = F.try_element_at("exports", inner)
    exported = F.when(whole, True).when(F.col("exports").isNull(), True).otherwise(entry.isNotNull())
    return rows.select("specifier", F.coalesce(exported, F.lit(False)).alias("exported"), F.when(whole, F.col("main")).otherwise(entry).alias("target"))


def doctor(registered: DataFrame, on_disk: DataFrame, tracked: DataFrame) -> DataFrame:
    """Names on disk that are unknown or untracked, and tracked ones that are gone; all (name)."""
    side = lambda a, b, what: a.select("name").distinct().join(b, "name", "left_anti").select("name", F.lit(what).alias("state"))
    known = on_disk.join(registered, "name", "left_semi")
    return side(on_disk, registered, "unknown").unionByName(side(known, tracked, "untracked")).unionByName(side(tracked, on_disk, "orphaned"))


def page_findings(blocks: DataFrame, key: str) -> DataFrame:
    """Pages without any content block, and pages with several titles."""
    sums = blocks.groupBy(key).agg(
        F.count_if((F.col("kind") != "heading") & (X.strip(F.coalesce("text", F.lit(""))) != "")).alias("content"),
        F.count_if((F.col("kind") == "heading") & (F.col("level") == 1)).alias("titles"),
    )
    rules = F.array_compact(F.array(F.when(F.col("content") == 0, "EMPTY_PAGE"), F.when(F.col("titles") > 1, "DUPLICATE_TITLE")))
    return sums.select(key, F.explode(rules).alias("code"))


def component_findings(usages: DataFrame, components: DataFrame) -> DataFrame:
    """Unknown components and missing required props; usages (id, component, props), components (component, required)."""
    rows = usages.join(components.withColumn("known", F.lit(True)), "component", "left")
    missing = F.array_except("required", "props")
    code = F.when(F.col("known").isNull(), "UNKNOWN_COMPONENT").when(F.size(missing) > 0, "MISSING_PROP")
    return rows.select("id", code.alias("code")).filter("code is not null")


def output_findings(planned: DataFrame, written: DataFrame) -> DataFrame:
    """Planned pages that were not written, and files that leave the output directory; both (path)."""
    gone = planned.join(written, "path", "left_anti").select("path", F.lit("MISSING_OUTPUT").alias("code"))
    return gone.unionByName(written.filter(F.col("path").rlike(r"(?:^|/)\.\.(?:/|\z)|^/")).select("path", F.lit("PATH_ESCAPE").alias("code")))
