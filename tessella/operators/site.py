"""Site model: sections, navigation, reading order, link resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators.similarity import closest_names


def sections(pages: DataFrame) -> DataFrame:
    """Pages (path, id, title, route, order) by first directory: id, title, page ids in page order."""
    top = P.top_dir("path")
    grouped = pages.groupBy(top.alias("dir")).agg(F.array_sort(F.collect_list(F.struct("order", "title", "route", "id"))).alias("p"))
    return grouped.select(
        F.when(F.col("dir") == "", "general").otherwise(F.col("dir")).alias("section_id"),
        F.when(F.col("dir") == "", "General").otherwise(X.title_case("dir")).alias("title"),
        F.transform("p", lambda x: x["id"]).alias("page_ids"),
    )


def duplicate_routes(pages: DataFrame) -> DataFrame:
    """Routes that several pages have."""
    return pages.groupBy("route").agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique_routes(pages: DataFrame) -> DataFrame:
    """The pages; reading them fails where a route is taken twice."""
    n = F.count("*").over(Window.partitionBy("route"))
    problem = F.raise_error(F.concat(F.lit("route taken twice: "), F.col("route")))
    return pages.withColumn("route", F.when(n > 1, problem).otherwise(F.col("route")))


def reading_order(pages: DataFrame, partition: list[str], order: list[Column | str], key: str) -> DataFrame:
    """Position, previous and next page of each page."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return pages.select(
        *partition, key, F.row_number().over(w).cast("long").alias("position"), F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next")
    )


def posts(df: DataFrame, date: str, key: str) -> DataFrame:
    """Posts, latest first, undated last, then by key."""
    return df.orderBy(F.desc_nulls_last(date), F.asc(key))


def resolve_links(links: DataFrame, slugs: DataFrame, aliases: DataFrame, anchors: DataFrame) -> DataFrame:
    """Status of each link (target, anchor, internal): external, ok, missing-anchor, alias, renamed or missing-page.

    ``slugs`` (slug), ``aliases`` (alias, slug) and ``anchors`` (slug, anchor).
    Only links that nothing else resolves are compared by edit distance.
    """
    rows = links.withColumn("normal", X.normalize_target("target"))
    known = slugs.select(F.col("slug").alias("normal")).distinct().withColumn("hit", F.lit(True))
    named = aliases.join(slugs, "slug", "left_semi").groupBy(F.col("alias").alias("normal")).agg(F.min("slug").alias("aliased"))
    listed = anchors.groupBy(F.col("slug").alias("normal")).agg(F.collect_set("anchor").alias("listed"))
    joined = rows.join(known, "normal", "left").join(named, "normal", "left").join(listed, "normal", "left")
    open_ = joined.filter("internal and hit is null and aliased is null").select("normal").distinct()
    allowed = F.greatest(F.lit(2), F.floor(F.length("target") / 4))
    near = closest_names(open_, "normal", slugs, "slug", allowed).select(F.col("target").alias("normal"), F.col("name").alias("closest"))
    joined = joined.join(near, "normal", "left")
    anchored = F.col("anchor").isNull() | F.col("listed").isNull() | F.array_contains("listed", F.col("anchor"))
    status = (
        F.when(~F.col("internal"), "external").when(F.col("hit") & anchored, "ok").when(F.col("hit"), "missing-anchor")
        .when(F.col("aliased").isNotNull(), "alias").when(F.col("closest").isNotNull(), "renamed").otherwise("missing-page")
    )
    to = F.when(F.col("internal") & F.col("hit").isNull(), F.coalesce("aliased", "closest"))
    return joined.select(*links.columns, status.alias("status"), to.alias("rewritten_to"))


def link_diagnostics(resolved: DataFrame, source: str) -> DataFrame:
    """Findings of resolved links: code, severity, message, subject."""
    code = F.when(F.col("status") == "missing-anchor", "DOC_MISSING_ANCHOR").otherwise("DOC_BROKEN_LINK")
    severity = F.when(F.col("status") == "missing-page", "error").when(F.col("status") == "missing-anchor", "warning").otherwise("info")
    message = (
        F.when(F.col("status") == "missing-page", F.concat(F.lit('Link to "'), "target", F.lit('" does not resolve.')))
        .when(F.col("status") == "missing-anchor", F.concat(F.lit('Anchor "#'), "anchor", F.lit('" not found on "'), "target", F.lit('".')))
        .otherwise(F.concat(F.lit('Link "'), "target", F.lit('" refers to a renamed page; update to "'), "rewritten_to", F.lit('".')))
    )
    bad = resolved.filter(F.col("status").isin("missing-page", "missing-anchor", "renamed"))
    return bad.select(code.alias("code"), severity.alias("severity"), message.alias("message"), F.col(source).alias("subject"))


def redirects(renames: DataFrame, aliases: DataFrame) -> DataFrame:
    """Redirects of renamed pages (from, to) and of aliases (slug, alias)."""
    slash = lambda c: F.concat(F.lit("/"), F.col(c))
    a = renames.select(slash("from").alias("from"), slash("to").alias("to"))
    return a.unionByName(aliases.select(X.normalize_target("alias").alias("from"), slash("slug").alias("to")))


def first_references(links: DataFrame, known: DataFrame) -> DataFrame:
    """First link of each page to each known target; columns page, ordinal, target."""
    w = Window.partitionBy("page", "target").orderBy("ordinal")
    kept = links.join(known, "target", "left_semi")
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
