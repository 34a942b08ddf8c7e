"""Planned pages of an output, and links between them for each kind of renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths as P


def planned_pages(pages: DataFrame, navigation: DataFrame, sections: DataFrame, base: str = "/docs", extension: str = ".mdx") -> DataFrame:
    """``slug``, ``title``, section title, route, paths and ``nav`` of every page.

    ``navigation`` has slug and position, ``sections`` id and title.
    """
    root = "" if base.strip("/") == "" else f"/{base.strip('/')}"
    first = navigation.groupBy("slug").agg(F.max("position").alias("nav"))
    named = sections.select(F.col("id").alias("section_id"), F.col("title").alias("section_title"))
    return (
        pages.join(first, "slug", "left").join(named, "section_id", "left")
        .select(
            "slug", "title", "section_id", F.coalesce("section_title", "section_id").alias("section_title"),
            F.concat(F.lit(f"{root}/"), "slug").alias("route"), F.concat("slug", F.lit(extension)).alias("md_path"),
            F.concat("slug", F.lit("/index.html")).alias("static_path"), F.col("nav").cast("long").alias("nav"),
        )
    )


def in_plan_order(planned: DataFrame) -> DataFrame:
    """Pages by place in the navigation, those without one last, then by slug."""
    return planned.orderBy(F.col("nav").asc_nulls_last(), "slug")


def routes(planned: DataFrame) -> DataFrame:
    """``slug``, ``route``, ``title`` of every page."""
    return planned.select("slug", "route", "title")


def related_targets(planned: DataFrame, related: DataFrame) -> DataFrame:
    """Related pages (page, target, ordinal) that are planned, each target once, the first place kept."""
    once = related.groupBy("page", "target").agg(F.min("ordinal").alias("ordinal"))
    return once.join(planned.select(F.col("slug").alias("target"), "title", "route"), "target").select("page", "target", "ordinal", "title", "route")


def _between(renderer: str, source: Column, target: Column) -> Column:
    """The link of one planned page to another."""
    if renderer == "next":
        return target["route"]
    if renderer == "plain":
        return F.concat(F.lit("/"), F.when(target["slug"] == "index", "").otherwise(target["slug"]))
    same = source["slug"] == target["slug"]
    if renderer == "markdown":
        return F.when(~same, P.relative_path(P.dirname(source["md_path"]), target["md_path"]))
    return F.when(same, "./").otherwise(F.concat(P.relative_path(source["slug"], target["slug"]), F.lit("/")))


def _ends(links: DataFrame, planned: DataFrame) -> DataFrame:
    page = F.struct("slug", "route", "md_path", "static_path")
    a = planned.select(F.col("slug").alias("source"), page.alias("a"))
    b = planned.select(F.col("slug").alias("target"), page.alias("b"))
    return links.join(a, "source", "left").join(b, "target", "left")


def document_links(links: DataFrame, planned: DataFrame, renderer: str) -> DataFrame:
    """Adds ``href`` to links (source, target slugs); null where an end is not planned."""
    found = _ends(links, planned)
    return found.withColumn("href", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), _between(renderer, F.col("a"), F.col("b")))).drop("a", "b")


def content_links(links: DataFrame, planned: DataFrame, renderer: str, base: str = "/docs") -> DataFrame:
    """Adds ``href`` to authored links (source slug, url); null for what is no link to a planned page."""
    url = F.col("url")
    path, suffix = F.regexp_extract(url, r"^([^#?]*)", 1), F.regexp_extract(url, r"([#?][\s\S]*)$", 1)
    outside = url.rlike(r"(?i)^(?:#|//|[a-z][a-z0-9+.-]*:)") | (path == "")
    trimmed = F.regexp_replace(path, "^/+|/+$", "")
    root = base.strip("/")
    if root:
        trimmed = F.regexp_replace(trimmed, rf"^{root}(?:/+|$)", "")
    relative = F.when(path.rlike(r"(?i)\.mdx?$"), F.regexp_replace(P.normalize_path(F.concat_ws("/", P.dirname(F.concat("source", F.lit(".md"))), path)), r"(?i)\.mdx?$", ""))
    slug = F.regexp_replace(F.when(path.startswith("/"), trimmed).otherwise(relative), "/index$", "")
    found = _ends(links.withColumn("target", F.when(~outside & (slug != ""), slug)).withColumn("_suffix", suffix), planned)
    href = F.concat(_between(renderer, F.col("a"), F.col("b")), F.col("_suffix"))
    return found.withColumn("href", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), href)).drop("a", "b", "_suffix")
