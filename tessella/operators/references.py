"""Imports, names and references between files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators.common import cut

# Endings tried for an import, in order.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".json", "/index.ts", "/index.tsx", "/index.js")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``target`` of relative imports (file, specifier): the first candidate path that exists."""
    base = P.normalize_path(F.when(P.dirname("file") == ".", F.col("specifier")).otherwise(F.concat(P.dirname("file"), F.lit("/"), "specifier")))
    tried = imports.select(
        "file", "specifier", F.posexplode(F.array(*[F.concat(base, F.lit(c)) for c in CANDIDATES])).alias("rank", "candidate")
    )
    found = tried.join(files.select(F.col("path").alias("candidate")), "candidate").groupBy("file", "specifier").agg(F.min_by("candidate", "rank").alias("target"))
    return imports.join(found, ["file", "specifier"], "left")


def resolve_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Package rows of bare specifiers, by the name that each derives."""
    return imports.withColumn("name", X.package_name("specifier")).join(packages, "name", "left")


def exported_names(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """``module``, ``name``, ``origin``: own exports, then those of star re-exports (module, source), nearest first.

    Cycles end because a name that a module has is never taken again.
    """
    known = cut(exports.select("module", "name", F.col("module").alias("origin")).distinct())
    front = known
    while True:
        step = stars.join(front.select(F.col("module").alias("source"), "name", "origin"), "source").groupBy("module", "name").agg(F.min("origin").alias("origin"))
        front = cut(step.join(known, ["module", "name"], "left_anti"))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front.select("module", "name", "origin")))


def resolve_names(uses: DataFrame, local: DataFrame, imported: DataFrame, exported: DataFrame) -> DataFrame:
    """Each use (module, name) with the module that declares it: local, then imported (module, name, source), else none."""
    own = local.select("module", "name", F.col("module").alias("origin"), F.lit(0).alias("rank"))
    through = imported.join(exported.select(F.col("module").alias("source"), "name", "origin"), ["source", "name"]).select("module", "name", "origin", F.lit(1).alias("rank"))
    best = own.unionByName(through).groupBy("module", "name").agg(F.min(F.struct("rank", "origin")).alias("b"))
    return uses.join(best, ["module", "name"], "left").select(*uses.columns, F.col("b.origin").alias("origin"))


def unresolved(references: DataFrame) -> DataFrame:
    """Findings for references without a target: code and severity by kind."""
    code = F.when(F.col("kind") == "import", "REF_UNRESOLVED_IMPORT").when(F.col("kind") == "extends", "REF_UNRESOLVED_BASE").otherwise("REF_UNRESOLVED_NAME")
    severity = F.when(F.col("kind").isin("import", "extends"), "error").otherwise("warning")
    return references.filter("to_id is null and to_file is null").select("id", code.alias("code"), severity.alias("severity"))


def type_edges(symbols: DataFrame) -> DataFrame:
    """Edges (src, dst, kind) of symbols (name, parent, extends, implements, return_type, parameters) to known ones."""
    known = symbols.select(F.col("name").alias("dst")).distinct()
    listed = lambda c, kind: symbols.select(F.col("name").alias("src"), F.explode(c).alias("dst"), F.lit(kind).alias("kind"))
    parts = [
        listed(F.array_compact(F.array("extends")), "extends"), listed("implements", "implements"), listed(X.type_references("return_type"), "returns"),
        listed(F.flatten(F.transform("parameters", X.type_references)), "parameter"), listed(F.array_compact(F.array("parent")), "member-of"),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.filter("src <> dst").distinct().join(known, "dst", "left_semi").select("src", "dst", "kind")


def title_mentions(pages: DataFrame, key: str, title: str, text: str, least: int = 4) -> DataFrame:
    """Pairs (page, mentions) where a page's text has another's title between word boundaries.

    Both sides meet on the title's first word, so not every pair is searched, and
    only texts that hold the title are searched for its boundaries.
    """
    word = r"[A-Za-z0-9_]+"
    titles = pages.filter(F.length(title) >= least).select(F.col(key).alias("mentions"), F.col(title).alias("_t"), F.regexp_extract(title, word, 0).alias("w"))
    words = pages.select(F.col(key).alias("page"), F.col(text).alias("_x"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0)))).alias("w"))
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.col("_t"), F.lit(r"\E(?![A-Za-z0-9_])"))
    other = F.col("page") != F.col("mentions")
    # a plain search first: a pattern of its own for each pair is costly to build and slow over a long text
    holds = F.contains("_x", F.col("_t"))
    return words.join(titles, "w").filter(other & holds & F.regexp_like("_x", quoted)).select("page", "mentions").distinct()


def affected_pages(changes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pages that mention a changed file or symbol, with how many; mentions (page, subject)."""
    return mentions.join(changes.select(F.col("subject")).distinct(), "subject").groupBy("page").agg(F.count_distinct("subject").alias("n"))


def owning_chain(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Distinct (src, dst) edges of some kinds."""
    return edges.filter(F.col("kind").isin(*kinds)).select("src", "dst").distinct()


def undocumented(symbols: DataFrame) -> DataFrame:
    """Findings on symbols (name, doc, parameters, doc_parameters, return_type, doc_returns)."""
    rule = lambda when, code, severity: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    bare = F.coalesce("doc", F.lit("")) == ""
    mismatch = F.size(F.array_except("doc_parameters", "parameters")) > 0
    silent = ~F.col("return_type").isin("void", "undefined", "never") & ~F.col("doc_returns")
    rules = F.array(
        rule(bare, "API_UNDOCUMENTED", "warning"), rule(~bare & mismatch, "API_PARAM_MISMATCH", "warning"), rule(~bare & silent, "API_MISSING_RETURNS", "info")
    )
    return symbols.select("name", F.explode(F.array_compact(rules)).alias("f")).select("name", "f.code", "f.severity")


def overload_index(symbols: DataFrame) -> DataFrame:
    """Number from 0 of each of several symbols of one name in a container."""
    w = Window.partitionBy("parent", "name")
    return symbols.withColumn("overload", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy("ordinal")) - 1))


def has_word(text: Column | str, word: Column | str) -> Column:
    """Whether a text has a word between ASCII word boundaries."""
    return F.regexp_like(X.col(text), F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), X.col(word), F.lit(r"\E(?![A-Za-z0-9_])")))
