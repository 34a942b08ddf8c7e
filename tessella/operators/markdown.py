"""Markdown as typed blocks.

The block parser handles a subset of CommonMark with tables: ATX headings, fenced
code, ordered and unordered lists, block quotes (as callouts), pipe tables, images
on a line of their own, rules and paragraphs. It runs in Arrow batches; all that
follows from blocks is expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*$")
_FENCE = re.compile(r"^(`{3,}|~{3,})[ \t]*(.*)$")
_RULE = re.compile(r"^(?:-[ \t]*){3,}$|^(?:\*[ \t]*){3,}$|^(?:_[ \t]*){3,}$")
_ITEM = re.compile(r"^([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_IMAGE = re.compile(r'^!\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)$')
_TABLE_RULE = re.compile(r"^\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?$")

BLOCK = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("headers", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("src", T.StringType()),
    ]
)
_ARROW = pa.list_(
    pa.struct(
        [
            ("ordinal", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("language", pa.string()),
            ("start_line", pa.int32()), ("ordered", pa.bool_()), ("items", pa.list_(pa.string())), ("headers", pa.list_(pa.string())),
            ("rows", pa.list_(pa.list_(pa.string()))), ("src", pa.string()),
        ]
    )
)


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def parse_blocks(text: str) -> list[dict]:
    """The blocks of one Markdown text, with the line (from 1) each begins on."""
    lines, out, at = text.split("\n"), [], 0

    def add(kind: str, line: int, **fields) -> None:
        out.append({"ordinal": len(out), "kind": kind, "start_line": line + 1, **fields})

    while at < len(lines):
        line = lines[at].rstrip("\r")
        begin = at
        at += 1
        if not line.strip():
            continue
        if m := _FENCE.match(line):
            body = []
            end = re.compile(rf"^{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while at < len(lines) and not end.match(lines[at]):
                body.append(lines[at])
                at += 1
            at += 1
            add("code", begin, text="\n".join(body), language=(m[2].strip().split() or ["text"])[0].lower())
        elif m := _HEADING.match(line):
            add("heading", begin, level=len(m[1]), text=m[2].strip())
        elif _RULE.match(line.strip()):
            add("horizontal-rule", begin)
        elif m := _IMAGE.match(line.strip()):
            add("image", begin, text=m[1], src=m[2])
        elif line.lstrip().startswith(">"):
            quoted = [line]
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                quoted.append(lines[at])
                at += 1
            add("callout", begin, text=" ".join(q.lstrip()[1:].strip() for q in quoted).strip())
        elif m := _ITEM.match(line.lstrip()):
            ordered, items = m[1][0].isdigit(), [m[2]]
            while at < len(lines) and lines[at].strip():
                m = _ITEM.match(lines[at].lstrip())
                if m:
                    items.append(m[2])
                else:
                    items[-1] += " " + lines[at].strip()
                at += 1
            add("list", begin, ordered=ordered, items=items)
        elif "|" in line and at < len(lines) and _TABLE_RULE.match(lines[at].strip()) and "-" in lines[at]:
            at += 1
            rows = []
            while at < len(lines) and "|" in lines[at]:
                rows.append(_cells(lines[at]))
                at += 1
            add("table", begin, headers=_cells(line), rows=rows)
        else:
            body = [line.strip()]
            while at < len(lines) and lines[at].strip() and not _HEADING.match(lines[at]) and not _FENCE.match(lines[at]):
                body.append(lines[at].strip())
                at += 1
            add("paragraph", begin, text=" ".join(body))
    return out


def blocks(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """A row for each block of each document, with the columns of ``keep``."""
    packed = docs.select(F.struct(*keep).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([packed.schema["k"], T.StructField("b", T.ArrayType(BLOCK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_blocks(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], names=["k", "b"])

    return packed.mapInArrow(run, schema).select("k.*", F.explode("b").alias("b")).select(*keep, "b.*")


def headings(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Headings with their anchors; repeats of an anchor within a document get a number."""
    from pyspark.sql import Window

    base = X.slugify_heading("text")
    rows = parsed.filter("kind = 'heading' and text <> ''").select(*keep, "ordinal", "level", "text", base.alias("slug"))
    again = F.row_number().over(Window.partitionBy(*keep, "slug").orderBy("ordinal")) - 1
    return rows.select(*keep, "ordinal", "level", "text", F.when(again > 0, F.concat_ws("-", "slug", again)).otherwise(F.col("slug")).alias("id"))


def search_text(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """Plain text of each document's blocks, a line for each part."""
    plain = lambda c: F.transform(c, X.strip_markdown)
    cells = F.concat(F.coalesce("headers", F.array().cast("array<string>")), F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))))
    parts = (
        F.when(F.col("kind").isin("heading", "paragraph", "callout"), F.array(X.strip_markdown("text")))
        .when(F.col("kind") == "code", F.array("text")).when(F.col("kind") == "list", plain(F.col("items")))
        .when(F.col("kind") == "table", plain(cells)).otherwise(F.array().cast("array<string>"))
    )
    own = parsed.select(*keep, F.struct("ordinal", F.filter(F.transform(parts, X.strip), lambda x: x != "").alias("parts")).alias("p"))
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["parts"]))
    return own.groupBy(*keep).agg(F.array_join(all_, "\n").alias("content"))


def rewrite_links(docs: DataFrame, keep: list[str], text: str, targets: DataFrame) -> DataFrame:
    """Texts with the urls of their links replaced by ``targets`` (url, to); code spans and images stay.

    The links of each text are joined with the targets, then all that found one are
    replaced where they stand.
    """
    token = r"`[^`]*`|!?\[[^\]]*\]\([^)]*\)"
    link = r"^\[([^\]]*)\]\(([^)\s]*)([^)]*)\)$"
    parts = docs.select(
        *keep, F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)).alias("tokens"), F.split(F.col(text), token, -1).alias("gaps")
    )
    rows = parts.select(*keep, F.posexplode_outer("tokens").alias("at", "token"))
    url = F.when(F.col("token").rlike(link), F.regexp_extract("token", link, 2))
    joined = rows.withColumn("url", url).join(targets, "url", "left")
    new = F.when(F.col("to").isNotNull(), F.concat(F.lit("["), F.regexp_extract("token", link, 1), F.lit("]("), "to", F.regexp_extract("token", link, 3), F.lit(")"))).otherwise(F.col("token"))
    ordered = joined.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("new"))
    whole = F.zip_with("gaps", F.col("new.new"), lambda g, t: F.concat(g, F.coalesce(t, F.lit(""))))
    return parts.join(ordered, keep).select(*keep, F.array_join(whole, "").alias(text))


def cli_parts(line: Column | str) -> Column:
    """Command, arguments and flags of a shell line; quotes keep an argument together."""
    text = F.regexp_replace(X.strip(line), r"^[$>]\s*", "")
    words = F.transform(
        F.regexp_extract_all(text, F.lit(r"\"[^\"]*\"|'[^']*'|\S+"), F.lit(0)), lambda w: F.regexp_replace(w, "^[\"']|[\"']$", "")
    )
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    flag = lambda w: w.startswith("-")
    return F.struct(
        F.get(words, F.lit(0)).alias("command"), F.filter(rest, lambda w: ~flag(w)).alias("arguments"), F.filter(rest, flag).alias("flags")
    )
