"""Path functions as Column expressions; paths use forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import col, title_case

# Kinds of tracked files by name and extension.
CONFIG_FILES = ("docs.config.ts", "docs.config.js", "docs.config.mjs", "tsconfig.json")
DOC_EXTENSIONS = (".md", ".mdx")
ASSET_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff", ".woff2", ".ttf")
# Languages by extension.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".rb": "ruby",
    ".md": "markdown", ".mdx": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".css": "css",
    ".html": "html", ".sh": "shell", ".sql": "sql", ".toml": "toml",
}


def basename(c: Column | str) -> Column:
    """Last segment."""
    return F.element_at(F.split(col(c), "/"), -1)


def dirname(c: Column | str) -> Column:
    """All but the last segment, ``.`` if there is but one."""
    return F.when(F.instr(col(c), "/") == 0, F.lit(".")).otherwise(F.regexp_replace(col(c), r"/[^/]*\z", ""))


def extension(c: Column | str) -> Column:
    """Extension with its dot, in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(basename(c), r".(\.[^.]+)\z", 1))


def language_of(c: Column | str) -> Column:
    """Language by extension, ``unknown`` otherwise."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(c)), F.lit("unknown"))


def file_kind(c: Column | str) -> Column:
    """manifest, config, documentation, asset or source."""
    base = basename(c)
    ends = lambda xs: F.greatest(*[base.endswith(x) for x in xs])
    return (
        F.when(base == "package.json", "manifest").when(base.isin(*CONFIG_FILES), "config")
        .when(ends(DOC_EXTENSIONS), "documentation").when(ends(ASSET_EXTENSIONS), "asset").otherwise("source")
    )


def _resolved(parts: Column) -> Column:
    """Segments without ``.`` and empty ones, each ``..`` taking the one before it."""
    return F.aggregate(
        F.filter(parts, lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )


def normalize_path(c: Column | str) -> Column:
    """The path with ``.``, ``..`` and empty segments resolved."""
    return F.array_join(_resolved(F.split(col(c), "/")), "/")


def resolve_target(directory: Column | str, url: Column | str) -> Column:
    """Slug that a relative link of a page in ``directory`` names."""
    path = F.element_at(F.split(col(url), "#"), 1)
    joined = F.when(col(directory) == ".", path).otherwise(F.concat(col(directory), F.lit("/"), path))
    return F.regexp_replace(F.regexp_replace(normalize_path(joined), r"\.(?:md|mdx)\z", ""), r"/index\z", "")


def relative_path(start: Column | str, to: Column | str) -> Column:
    """Path from the directory ``start`` to ``to``."""
    split = lambda c: F.filter(F.split(col(c), "/"), lambda p: ~p.isin("", "."))
    a, b = split(start), split(to)
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
        lambda s: s["n"],
    )
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.size(b))), "/")


def slug_from_path(c: Column | str) -> Column:
    """Path without Markdown extension and without a final ``/index``."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\.(?:md|mdx)\z", ""), r"/index\z", "")


def route_of(slug: Column | str) -> Column:
    """Route of a slug."""
    return F.when(col(slug) == "index", F.lit("/")).otherwise(F.concat(F.lit("/"), col(slug)))


def page_kind(path: Column | str, blog_dir: str = "blog") -> Column:
    """home for the root index, blog below the blog directory, documentation otherwise."""
    return (
        F.when(slug_from_path(path) == "index", "home")
        .when(F.element_at(F.split(col(path), "/"), 1) == blog_dir, "blog").otherwise("documentation")
    )


def top_dir(path: Column | str) -> Column:
    """First directory, empty at the root."""
    return F.when(F.instr(col(path), "/") == 0, F.lit("")).otherwise(F.element_at(F.split(col(path), "/"), 1))


def title_from_path(path: Column | str) -> Column:
    """Title of a file name; of its directory for an index, ``Home`` at the root."""
    base = F.regexp_replace(basename(path), r"\.(?:md|mdx)\z", "")
    parent = basename(dirname(path))
    return F.when(base != "index", title_case(base)).when(parent == ".", "Home").otherwise(title_case(parent))


def is_within(root: Column | str, path: Column | str) -> Column:
    """Whether ``path`` lies in ``root``, both resolved."""
    a, b = normalize_path(root), normalize_path(path)
    return (a == b) | b.startswith(F.concat(a, F.lit("/"))) | (a == "")


def locale_of(path: Column | str, locales: list[str]) -> Column:
    """First path segment that is a locale, the first locale if none is."""
    found = F.filter(F.split(col(path), "/"), lambda p: p.isin(*locales))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(locales[0]))
