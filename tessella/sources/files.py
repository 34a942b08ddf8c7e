"""Corpus scans: files as rows, ignore rules and glob patterns as predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import paths as P

MAX_BYTES = 5 * 1024 * 1024


def expand_braces(pattern: str) -> list[str]:
    """All patterns that alternatives in braces, nested ones too, stand for."""
    start = pattern.find("{")
    depth, parts, last = 0, [], start + 1
    for at in range(max(start, 0), len(pattern)) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(pattern[at], 0)
        if depth == 1 and pattern[at] == "," or depth == 0:
            parts.append(pattern[last:at])
            last = at + 1
        if depth == 0:
            return [x for p in parts for x in expand_braces(pattern[:start] + p + pattern[at + 1 :])]
    return [pattern]


def _segment(segment: str, dot: bool) -> str:
    out = "" if dot or segment[:1] not in "*?" or not segment else r"(?!\.)"
    for part in re.findall(r"\[[!^]?[^\]]*\]|.", segment):
        if part == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif len(part) > 1:
            body = part[1:-1]
            negated = body[:1] in ("!", "^")
            out += "[" + "^" * negated + (body[1:] if negated else body).replace("\\", "\\\\").replace("^", "\\^") + "]"
        else:
            out += re.escape(part)
    return out


def glob_regex(pattern: str, dot: bool = False) -> str:
    """One regular expression for a pattern, over whole relative paths.

    A pattern without a slash matches a segment at any depth, one with a leading
    slash from the root; a trailing slash takes all below along.
    """
    found = []
    for p in expand_braces(pattern):
        below, anchored = p.endswith("/"), p.startswith("/")
        segments = [s for s in p.strip("/").split("/") if s]
        if not segments:
            continue
        if len(segments) == 1 and not anchored and segments != ["**"]:
            found.append(rf"(?:.*/)?{_segment(segments[0], dot)}(?:/.*)?")
            continue
        hidden = "" if dot else r"(?!\.)"
        out = ""
        for k, s in enumerate(segments):
            last = k == len(segments) - 1
            if s == "**":
                out += rf"(?:{hidden}[^/]+(?:/{hidden}[^/]+)*)?" if last else rf"(?:{hidden}[^/]+/)*"
            else:
                out += _segment(s, dot) + ("" if last or segments[k + 1 :] == ["**"] else "/")
                if segments[k + 1 :] == ["**"]:
                    out += "(?:/|$)"
        found.append(out + ("(?:/.*)?" if below else ""))
    return r"^(?:" + "|".join(found) + r")\z" if found else r"(?!)"


def matches(path: Column | str, pattern: str, dot: bool = False) -> Column:
    """Whether a relative path matches a glob pattern."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, "^/+", "").rlike(glob_regex(pattern, dot))


def parse_ignore(content: str, directory: str = ".") -> list[tuple[str, bool]]:
    """Rules (pattern, negated) of an ignore file, in order, put below its directory."""
    rules = []
    for line in map(str.strip, content.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        pattern = line[1:] if negated or line.startswith("\\!") else line
        pattern = pattern[1:] if pattern.startswith(("\\#", "\\ ")) else pattern
        if pattern:
            rules.append((pattern if directory in ("", ".") else f"{directory}/{pattern}", negated))
    return rules


def ignored(path: Column | str, rules: list[tuple[str, bool]], dot: bool = True) -> Column:
    """Whether the last rule that matches a path ignores it; a negated one takes it back."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        verdict = F.when(matches(path, pattern, dot), F.lit(not negated)).otherwise(verdict)
    return verdict


def could_reinclude(directory: str, rules: list[tuple[str, bool]]) -> bool:
    """Whether a negated rule might take back something below an ignored directory."""
    for pattern, negated in rules:
        literal = re.split(r"[*?\[{]", pattern)[0]
        if negated and (not literal or literal.startswith(f"{directory}/")):
            return True
    return False


def included(path: Column | str, size: Column | str, rules: list[tuple[str, bool]], include: list[str] | None = None, max_bytes: int = MAX_BYTES, max_depth: int | None = None) -> Column:
    """Resource filter: depth, size, included patterns and ignore rules."""
    c = F.col(path) if isinstance(path, str) else path
    s = F.col(size) if isinstance(size, str) else size
    keep = (s <= max_bytes) & ~ignored(c, rules)
    if include:
        wanted = F.lit(False)
        for p in include:
            wanted = wanted | matches(c, p)
        keep = keep & wanted
    return keep if max_depth is None else keep & (F.size(F.split(c, "/")) - 1 <= max_depth)


def scan(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files below ``root``: path, relative_path, size, modified, extension, language, kind, content_hash, content.

    Spark's binary reader lists and reads; only files that pass the filters are hashed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.substr(plain, F.length(prefix) + 2)
    rows = files.select("path", rel.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    kept = rows.filter(included("relative_path", "size", rules or [], max_bytes=max_bytes))
    return kept.select(
        "path", "relative_path", "size", "modified", P.extension("relative_path").alias("extension"), P.language_of("relative_path").alias("language"),
        P.file_kind("relative_path").alias("kind"), F.sha1("content").alias("content_hash"), "content",
    )


def scan_statistics(files: DataFrame) -> DataFrame:
    """Counts by category, extension and language, and in all, in one pass over grouping sets."""
    rows = files.select("size", "category", F.coalesce(F.nullif("extension", F.lit("")), F.lit("(none)")).alias("extension"), "language")
    rows.createOrReplaceTempView("_scan_rows")
    return rows.sparkSession.sql(
        "SELECT category, extension, language, count(*) AS files, sum(size) AS bytes FROM _scan_rows "
        "GROUP BY GROUPING SETS ((category), (extension), (language), ())"
    )


def workspace_kind(manifests: DataFrame) -> DataFrame:
    """The workspace tool whose manifest comes first in precedence."""
    # Manifests in order of precedence.
    order = ["pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "rush.json", "moon.yml", "package.json"]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), P.basename("path"))
    return manifests.withColumn("rank", rank).filter("rank > 0").groupBy("root").agg(F.min_by(P.basename("path"), "rank").alias("manifest"))


def yaml_list(content: Column | str, key: str) -> Column:
    """Items of the list below a key in a small YAML text."""
    block = F.regexp_extract(content, rf"(?m)^{re.escape(key)}:[ \t]*\r?\n((?:[ \t]*-[ \t]*.*(?:\r?\n|\z)|[ \t]*(?:\r?\n))*)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*[\"']?([^\"'\r\n]*?)[\"']?[ \t]*$"), F.lit(1))
    return F.filter(items, lambda x: x != "")
