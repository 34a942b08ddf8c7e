"""Documents and pages as rows: normalisation, extraction from HTML, search and feed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators.frontmatter import split_frontmatter

# What counts as a heading and as a link.
HEADING = r'<h([1-6])\s+(?:id="([^"]*)")?[^>]*>([\s\S]*?)</h[1-6]>'
ANCHOR = r'<a\s+href="([^"]*)"[^>]*>([\s\S]*?)</a>'


def normalize_documents(docs: DataFrame, path: str, text: str, blog_dir: str = "blog") -> DataFrame:
    """Adds slug, route, kind, title, body, word_count and minutes; titles come from headings, then names."""
    body = X.normalize_body(text)
    heading = F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)
    return (
        docs.withColumn("body", body)
        .withColumn("slug", P.slug_from_path(path))
        .withColumn("route", P.route_of("slug"))
        .withColumn("kind", P.page_kind(path, blog_dir))
        .withColumn("title", F.coalesce(F.nullif(heading, F.lit("")), P.title_from_path(path)))
        .withColumn("word_count", X.word_count("body"))
        .withColumn("minutes", X.reading_minutes("word_count"))
    )


LINK = r"(?<!!)\[([^\[\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)"
FENCED = r"(?m)^(```|~~~)[\s\S]*?(?:^\1[^\n]*$|\z)"


def normalize_pages(docs: DataFrame, path: str, raw: str, blog_dir: str = "blog") -> DataFrame:
    """Documents with all that their leading block and their text say: one row each.

    Adds slug, route, kind, title (the block's, else the first heading of level 1, else the
    file's name), description (the block's, else the first paragraph), body, page_order, date,
    author, protected, aliases, locale, unknown, problem, links (array of text, url, external and
    the slug a relative one names), word_count and minutes. The block may set ``kind``; home is
    for the root index alone. Links in code blocks are none.
    """
    read = split_frontmatter(docs, raw)
    body = X.normalize_body("body")
    plain = F.regexp_replace("body", FENCED, "")
    heading = F.regexp_extract(plain, r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)
    parts = F.transform(F.split(plain, r"\n[ \t]*\n"), lambda x: X.strip(x))
    first = F.get(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^(?:#|>|\||!\[|<|[-*+] |[0-9]+[.)] )")), F.lit(0))
    folder = P.dirname(path)
    texts, urls = (F.regexp_extract_all(plain, F.lit(LINK), F.lit(k)) for k in (1, 2))
    far = lambda u: u.rlike("^(?i)(?:https?:|mailto:|//)")
    links = F.zip_with(
        texts, urls, lambda t, u: F.struct(t.alias("text"), u.alias("url"), far(u).alias("external"), F.when(~far(u) & ~u.startswith("#") & ~u.startswith("/"), P.resolve_target(folder, u)).alias("target"))
    )
    override = F.get_json_object(F.concat(F.lit('{"k":'), F.element_at("unknown", F.lit("kind")), F.lit("}")), "$.k")
    kind = F.when(override.isin("documentation", "blog"), override).otherwise(P.page_kind(path, blog_dir))
    return (
        read.withColumn("body", body).withColumn("slug", P.slug_from_path(path)).withColumn("route", P.route_of("slug")).withColumn("kind", kind)
        .withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif(heading, F.lit("")), P.title_from_path(path)))
        .withColumn("description", F.coalesce("description", X.describe(F.regexp_replace(first, r"\s+", " ")), F.lit("")))
        .withColumn("page_order", F.coalesce("order", F.lit(0.0))).withColumn("links", links)
        .withColumn("word_count", X.word_count("body")).withColumn("minutes", X.reading_minutes("word_count")).drop("order", "sidebar", "custom")
    )


def combined_hash(files: DataFrame, group: str, path: Column, content: Column) -> DataFrame:
    """One hash of each group's files, joined in order of path."""
    parts = F.array_sort(F.collect_list(F.struct(path.alias("path"), content.alias("content"))))
    joined = F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["path"], p["content"])), "\n")
    return files.groupBy(group).agg(X.hash16(joined).alias("combined"))


def _matches(df: DataFrame, key: str, html: str, pattern: str, names: list[str]) -> DataFrame:
    groups = [F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]
    zipped = df.select(key, *groups).select(key, F.posexplode(F.arrays_zip(*names)).alias("at", "m"))
    return zipped.select(key, (F.col("at") + 1).cast("long").alias("ordinal"), *[F.col(f"m.{n}").alias(n) for n in names])


def html_headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each heading with attributes: ordinal, level, id, text."""
    found = _matches(pages, key, html, HEADING, ["level", "id", "text"])
    return found.select(key, "ordinal", F.col("level").cast("int").alias("level"), "id", F.trim(F.regexp_replace("text", "<[^>]+>", "")).alias("text"))


def html_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """A row for each link: ordinal, url, text, is_external."""
    found = _matches(pages, key, html, ANCHOR, ["url", "text"])
    return found.select(
        key, "ordinal", "url", F.trim(F.regexp_replace("text", "<[^>]+>", "")).alias("text"), F.col("url").rlike("^(https?|mailto):").alias("is_external")
    )


def table_of_contents(headings: DataFrame, key: str, depth: int = 3) -> DataFrame:
    """Nested list of each page's headings of level 2 to ``depth``."""
    open_, close = F.lit("<ul>\n"), F.lit("</ul>\n")
    rows = headings.filter(F.col("level").between(2, depth)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "level", "id", "text"))).alias("all")
    )

    def step(state: Column, h: Column) -> Column:
        deeper = F.repeat(open_, F.greatest(h["level"] - state["level"], F.lit(0)))
        higher = F.repeat(close, F.greatest(state["level"] - h["level"], F.lit(0)))
        label = F.replace(F.replace(F.replace(h["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        item = F.concat(F.lit('<li><a href="#'), h["id"], F.lit('">'), label, F.lit("</a></li>\n"))
        return F.struct(h["level"].alias("level"), F.concat(state["html"], deeper, higher, item).alias("html"))

    start = F.lit('<nav class="toc" aria-label="Table of Contents">\n<h2>On This Page</h2>\n<ul>\n')
    html = F.aggregate(
        "all", F.struct(F.lit(2).alias("level"), start.alias("html")), step,
        lambda s: F.concat(s["html"], F.repeat(close, s["level"] - 2), F.lit("</ul>\n</nav>")),
    )
    return rows.select(key, html.alias("toc"))


def search_rows(pages: DataFrame, keep: list[str], html: str, size: int = 500) -> DataFrame:
    """Search entries: plain content of at most ``size`` characters."""
    return pages.select(*keep, X.truncate_words(X.strip_html(html), size).alias("content"))


def sitemap_rows(pages: DataFrame, base: str, keep: list[str]) -> DataFrame:
    """Sitemap entries of pages with ``slug`` and ``category``."""
    priority = F.when(F.col("category") == "guides", 0.8).when(F.col("slug") == "/", 1.0).otherwise(0.6)
    return pages.select(
        *keep, F.concat(F.lit(base.rstrip("/")), "slug").alias("url"), F.lit("weekly").alias("change_frequency"), priority.alias("priority")
    )


def signature() -> Column:
    """Signature of a symbol row with kind, name, parameters and return_type."""
    parameter = lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.when(p["required"], "").otherwise("?"))
    return F.concat(
        "kind", F.lit(":"), "name", F.lit("("), F.array_join(F.transform("parameters", parameter), ","), F.lit("):"),
        F.coalesce("return_type", F.lit("void")),
    )
