"""Writers of site files, feeds and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessella.functions.text import escape_xml

MARKER = "<!-- generated -->"


def search_index(entries: DataFrame) -> DataFrame:
    """One JSON line for each search entry."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


def sitemap_lines(rows: DataFrame) -> DataFrame:
    """One url element for each sitemap row (url, change_frequency, priority)."""
    return rows.select(
        F.concat(F.lit("<url><loc>"), escape_xml("url"), F.lit("</loc><changefreq>"), "change_frequency", F.lit("</changefreq><priority>"), "priority", F.lit("</priority></url>")).alias("value")
    )


def rss_items(rows: DataFrame) -> DataFrame:
    """One item element for each feed row (title, link, description)."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escape_xml(c), F.lit(f"</{name}>"))
    return rows.select(F.concat(F.lit("<item>"), tag("title", "title"), tag("link", "link"), tag("description", "description"), tag("guid", "link"), F.lit("</item>")).alias("value"))


def robots_txt(base: str) -> str:
    """A robots file that allows all and names the sitemap."""
    return "\n".join(["User-agent: *", "Allow: /", "", f"Sitemap: {base.rstrip('/')}/sitemap.xml"])


def mdx_artifacts(docs: DataFrame) -> DataFrame:
    """Deterministic MDX text of each document (slug, title, body), with the ownership marker."""
    text = F.concat(F.lit(f"---\ntitle: "), F.to_json(F.struct("title")), F.lit(f"\n---\n{MARKER}\n\n"), "body")
    return docs.select("slug", text.alias("content"))


def owned(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned files (path) that overwrite no file of the user: existing (path, content) without the marker stay."""
    users = existing.filter(~F.contains("content", F.lit(MARKER))).select("path")
    return planned.join(users, "path", "left_anti")


def write_snapshot(snapshot: DataFrame, root: str, version: int) -> None:
    """A new version directory; Spark's commit makes it whole or absent."""
    snapshot.write.mode("errorifexists").parquet(f"{root}/version={version}")


def load_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """A version of a snapshot, none if it was never committed."""
    try:
        return spark.read.parquet(f"{root}/version={version}")
    except AnalysisException:
        return None
