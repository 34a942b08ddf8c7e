"""Composition of generated and authored content: merges, snippets, differences, highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X

#: A comment that includes a snippet, with or without a namespace before the word.
INCLUDE = re.compile(r"<!--\s*@(?:\w+:)?include\s+([\w./-]+)\s*-->")
MAX_DEPTH = 16


def semantic_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Heading and content changes of documents (key, ordinal, kind, level, text).

    A new heading and one that is gone are a rename where they share document,
    level and rank among the unmatched.
    """
    from pyspark.sql import Window

    heads = lambda df: df.filter("kind = 'heading'").groupBy(key, F.lower("text").alias("k")).agg(F.max_by(F.struct("level", "text", "ordinal"), "ordinal").alias("h"))
    rank = lambda df: df.select(key, "h.level", "h.text", F.row_number().over(Window.partitionBy(key, "h.level").orderBy("h.ordinal")).alias("n"))
    b, a = heads(before), heads(after)
    new, gone = rank(a.join(b, [key, "k"], "left_anti")), rank(b.join(a, [key, "k"], "left_anti"))
    pairs = new.alias("n").join(gone.withColumnRenamed("text", "was"), [key, "level", "n"], "full")
    kind = F.when(F.col("was").isNull(), "heading-added").when(F.col("text").isNull(), "section-removed").otherwise("heading-renamed")
    headings = pairs.select(key, kind.alias("change"), F.coalesce("was", "text").alias("subject"))
    digest = lambda df: df.select(key, "kind", "text", X.hash16(F.concat_ws("|", "kind", "level", "text")).alias("_digest"))
    x, y = digest(before), digest(after)
    added = y.join(x, [key, "_digest"], "left_anti").select(key, F.when(F.col("kind") == "code", "example-updated").otherwise("content-added").alias("change"), F.col("text").alias("subject"))
    removed = x.join(y, [key, "_digest"], "left_anti").select(key, F.lit("content-removed").alias("change"), F.col("text").alias("subject"))
    return headings.unionByName(added).unionByName(removed)


MERGED = T.StructType(
    [T.StructField("page", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("text", T.StringType()), T.StructField("owner", T.StringType()), T.StructField("conflict", T.BooleanType())]
)


def merge_blocks(previous: list[str], generated: list[str], user: list[str]) -> list[tuple[str, str, bool]]:
    """Three-way merge of block texts: (text, owner, conflict).

    Blocks that the user left as they were follow the new generated version; what
    the user changed stays, and is a conflict where the generated side lost the
    replaced blocks too.
    """
    out: list[tuple[str, str, bool]] = []
    fresh, p, g = set(generated), 0, 0
    remaining = list(user)
    while remaining:
        if p < len(previous) and remaining[0] == previous[p]:
            out.append((generated[g] if g < len(generated) else remaining[0], "generated", False))
            g, p = g + 1, p + 1
            remaining.pop(0)
            continue
        own = []
        while remaining and not (p < len(previous) and remaining[0] == previous[p]):
            own.append(remaining.pop(0))
        replaced = []
        while p < len(previous) and (not remaining or previous[p] != remaining[0]):
            replaced.append(previous[p])
            p += 1
        diverged = any(block not in fresh for block in replaced)
        for block in replaced:
            if block in generated[g:]:
                g = generated.index(block, g) + 1
        out += [(block, "user-authored", diverged and k == 0) for k, block in enumerate(own)]
    out += [(block, "generated", False) for block in generated[g:]]
    return out


def three_way_merge(previous: DataFrame, generated: DataFrame, user: DataFrame) -> DataFrame:
    """Merged blocks of each page; inputs (page, ordinal, text). A page's blocks fit one task by nature."""
    tagged = [df.select("page", "ordinal", "text", F.lit(side).alias("side")) for side, df in enumerate((previous, generated, user))]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == k].sort_values("ordinal").text.tolist() for k in range(3)]
        merged = merge_blocks(*sides)
        return pd.DataFrame([(pdf.page.iloc[0], k, *m) for k, m in enumerate(merged)], columns=MERGED.fieldNames())

    return rows.groupBy("page").applyInPandas(merge, MERGED)


def expand_includes(docs: DataFrame, key: str, text: str, snippets: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Texts with include comments replaced by snippets (name, body), in rounds; unknown names become empty.

    Each round joins the names that are left with the snippets. What is still
    there after ``max_depth`` rounds is a cycle: it is emptied and ``cyclic`` is set.
    """
    from tessella.operators.common import cut

    pattern = INCLUDE.pattern
    current = docs.select(key, F.col(text).alias("t"))
    for _ in range(max_depth):
        parts = current.select(key, F.regexp_extract_all("t", F.lit(pattern), F.lit(1)).alias("names"), F.split("t", pattern, -1).alias("gaps"))
        if parts.filter("size(names) > 0").isEmpty():
            break
        rows = parts.select(key, F.posexplode("names").alias("at", "name")).join(snippets, "name", "left")
        bodies = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("body", F.lit("")).alias("body")))).alias("b"))
        joined = parts.join(bodies, key, "left")
        whole = F.array_join(F.zip_with("gaps", F.coalesce(F.col("b.body"), F.array().cast("array<string>")), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
        current = cut(joined.select(key, whole.alias("t")))
    return current.select(key, F.regexp_replace("t", pattern, "").alias(text), F.col("t").rlike(pattern).alias("cyclic"))


# Words that languages reserve.
KEYWORDS = {
    "ts": "const let var function return if else for while class extends import export from new async await type interface true false null".split(),
    "python": "def return if elif else for while class import from as with try except lambda yield True False None".split(),
    "sh": "if then else fi for do done while case esac function echo export".split(),
    "json": ["true", "false", "null"], "css": [], "html": [],
}
MAX_CODE = 20_000


def highlight(code: str | None, language: str) -> str:
    """Code as HTML with token classes; an unknown language or oversized code is only escaped."""
    import html

    code = code or ""
    if language not in KEYWORDS or len(code) > MAX_CODE:
        return html.escape(code, quote=False)
    comment = r"#[^\n]*" if language in ("python", "sh") else r"//[^\n]*|/\*[\s\S]*?\*/"
    token = re.compile(rf"(?P<comment>{comment})|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<number>\b\d+(?:\.\d+)?\b)|(?P<word>[A-Za-z_$][\w$]*)")
    words, out, at = set(KEYWORDS[language]), [], 0
    for m in token.finditer(code):
        kind = m.lastgroup if m.lastgroup != "word" else "keyword" if m[0] in words else None
        out.append(html.escape(code[at : m.start()], quote=False))
        body = html.escape(m[0], quote=False)
        out.append(f'<span class="tok-{kind}">{body}</span>' if kind else body)
        at = m.end()
    return "".join(out) + html.escape(code[at:], quote=False)


def highlighted(code: Column | str, language: str) -> Column:
    """``highlight`` in Arrow batches."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: highlight(t, language))

    return run(X.col(code))


def test_cases(source: Column | str) -> Column:
    """Titles of test cases in a source text."""
    return F.regexp_extract_all(X.col(source), F.lit(r"(?:^|[^\w.])(?:it|test)\(\s*[\"'`]([^\"'`]+)[\"'`]"), F.lit(1))


def doc_examples(source: Column | str) -> Column:
    """Bodies of ``@example`` tags in doc comments."""
    return F.regexp_extract_all(X.col(source), F.lit(r"@example\s*\n((?:\s*\*(?!\s*@|/)[^\n]*\n)+)"), F.lit(1))


def doc_tags(comment: Column | str) -> Column:
    """(tag, text) pairs of a doc comment."""
    tags = F.regexp_extract_all(X.col(comment), F.lit(r"@(\w+)[ \t]*([^\n@]*)"), F.lit(1))
    texts = F.transform(F.regexp_extract_all(X.col(comment), F.lit(r"@(\w+)[ \t]*([^\n@]*)"), F.lit(2)), lambda t: F.trim(F.regexp_replace(t, r"\s*\*/\s*$", "")))
    return F.arrays_zip(tags.alias("tag"), texts.alias("text"))


def configuration_keys(source: Column | str, keys: list[str]) -> Column:
    """Which of the known keys a source sets."""
    return F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.regexp_like(X.col(source), F.concat(F.lit(r"(?<![A-Za-z0-9_])"), k, F.lit(r"[\"']?\s*:"))))
