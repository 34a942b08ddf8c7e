"""Components written as tags in Markdown, and changes of all text that blocks hold.

A reader finds the tags of a document outside code fences and code spans: names that begin
with a capital letter, attributes with or without a value, expressions in braces, spread
attributes. Nothing is evaluated: an expression is its text. Tags nest; a tag that is not
closed ends where the tag around it does, and a closing one without an opening is left out,
and both are named in ``problem``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIP = re.compile(r"(?m)^[ \t]{0,3}(`{3,}|~{3,})[^\n]*\n[\s\S]*?(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)|(`+)(?!`)[\s\S]*?(?<!`)\2(?!`)|<!--[\s\S]*?(?:-->|\Z)")
_TAG = re.compile(r"<(/?)([A-Z][\w.]*)(?=[\s/>{])")
_NAME = re.compile(r"[A-Za-z_$][\w$:.-]*")

FOUND = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("parent", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("flow", T.BooleanType()), T.StructField("properties", T.StringType()), T.StructField("content", T.StringType()), T.StructField("problem", T.StringType()),
    ]
)


def _braced(text: str, at: int) -> int:
    """The place behind the braces that open at ``at``, strings inside them whole; -1 if they do not close."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "\"'`":
            end = at + 1
            while end < len(text) and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            at = end
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return -1


def attributes(text: str, at: int) -> tuple[dict, int, bool] | None:
    """Properties, the place behind the tag, and whether it closes itself; none if the text is no tag."""
    out: dict = {}
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
        elif c == ">":
            return out, at + 1, False
        elif text.startswith("/>", at):
            return out, at + 2, True
        elif c == "{":  # spread attributes have no name of their own
            at = _braced(text, at)
            if at < 0:
                return None
        elif m := _NAME.match(text, at):
            at = m.end()
            value: object = True
            if text[at : at + 1] == "=":
                mark = text[at + 1 : at + 2]
                if mark == "{":
                    end = _braced(text, at + 1)
                    value = "{" + text[at + 2 : end - 1].strip() + "}" if end > 0 else None
                else:
                    end = text.find(mark, at + 2) + 1 if mark in ('"', "'") and mark else 0
                    value = text[at + 2 : end - 1] if end else None
                if value is None:
                    return None
                at = end
            out.setdefault(m[0], value)
        else:
            return None
    return None


def read_components(text: str) -> list[dict]:
    """The components of one text in order of their tags."""
    out: list[dict] = []
    open_: list[tuple[dict, int]] = []
    code = {m.start(): m.end() for m in _SKIP.finditer(text)}
    spots = sorted([*((a, b) for a, b in code.items()), *((m.start(), None) for m in _TAG.finditer(text))])
    past = line_at = 0
    line = 1

    def close(row: dict, begin: int, end: int, after: int) -> None:
        row["content"], row["end"] = text[begin:end].strip(), after

    for at, skip in spots:
        if at < past:
            continue
        if skip is not None:
            past = skip
            continue
        m = _TAG.match(text, at)
        if m[1]:
            end = text.find(">", at)
            k = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0]["name"] == m[2]), None)
            if end < 0 or k is None:
                out.append({"ordinal": len(out), "name": m[2], "problem": "not opened", "start": at, "end": at})
                continue
            for row, begin in reversed(open_[k + 1 :]):
                row["problem"] = "not closed"
                close(row, begin, at, at)
            close(*open_[k], at, end + 1)
            del open_[k:]
            past = end + 1
            continue
        read = attributes(text, m.end())
        if read is None:
            continue
        properties, past, alone = read
        line, line_at = line + text.count("\n", line_at, at), at
        parent = open_[-1][0] if open_ else None
        before = text[text.rfind("\n", 0, at) + 1 : at]
        row = {
            "ordinal": len(out), "name": m[2], "parent": parent["ordinal"] if parent else None, "depth": len(open_), "start": at, "end": past, "line": line, "flow": not before.strip(),
            "properties": json.dumps(properties, ensure_ascii=False, sort_keys=True), "content": "", "problem": None,
        }
        out.append(row)
        if not alone:
            open_.append((row, past))
    for row, begin in reversed(open_):
        row["problem"] = "not closed"
        close(row, begin, len(text), len(text))
    return out


_KINDS = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}


def components(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """A row for each component of each document, with the columns of ``keep``.

    Columns: ordinal, name, parent (an ordinal), depth, start and end (places in the text), line, flow
    (it begins its line), properties (VARIANT: true without a value, a string, or an expression in braces),
    content and problem. A closing tag without an opening has a row with nothing but name and place.
    """
    packed = docs.select(F.struct(*keep).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([packed.schema["k"], T.StructField("c", T.ArrayType(FOUND))])
    arrow = pa.list_(pa.struct([(f.name, _KINDS[f.dataType]) for f in FOUND.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_components(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["k", "c"])

    rows = packed.mapInArrow(run, schema).select("k.*", F.explode("c").alias("c")).select(*keep, "c.*")
    return rows.withColumn("properties", F.try_parse_json("properties"))


def property_rows(found: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each property of each component: ordinal, name, property, value (text), type (flag, text or expression)."""
    pairs = F.explode(F.map_entries(F.from_json(F.to_json("properties"), T.MapType(T.StringType(), T.StringType())))).alias("p")
    rows = found.filter("properties is not null").select(*keep, "ordinal", "name", pairs)
    kind = F.when(F.col("p.value").rlike(r"^\{[\s\S]*\}$"), "expression").when(F.col("p.value") == "true", "flag").otherwise("text")
    return rows.select(*keep, "ordinal", "name", F.col("p.key").alias("property"), F.col("p.value").alias("value"), kind.alias("type"))


def check_components(found: DataFrame, keep: list[str], registered: DataFrame) -> DataFrame:
    """Findings on components: code, name and, of a missing one, the property.

    ``registered``: name, required (array of properties). What was not opened or not closed is found too.
    """
    known = registered.select("name", F.col("required").alias("_required"), F.lit(True).alias("_known"))
    met = found.filter("properties is not null").join(F.broadcast(known), "name", "left")  # a registry is written by hand
    given = F.coalesce(F.map_keys(F.from_json(F.to_json("properties"), T.MapType(T.StringType(), T.StringType()))), F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    unknown = met.filter("_known is null").select(*keep, "ordinal", "name", F.lit("DOC_UNKNOWN_COMPONENT").alias("code"), none.alias("property"))
    missing = met.filter("_known").select(*keep, "ordinal", "name", F.lit("DOC_MISSING_REQUIRED_PROP").alias("code"), F.explode(F.array_except("_required", given)).alias("property"))
    broken = found.filter("problem is not null").select(*keep, "ordinal", "name", F.when(F.col("problem") == "not closed", "DOC_UNCLOSED_COMPONENT").otherwise("DOC_STRAY_CLOSING_TAG").alias("code"), none.alias("property"))
    return unknown.unionByName(missing).unionByName(broken)


def map_block_text(parsed: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """Blocks with every field of inline text changed: headings, paragraphs, callouts, items, headers and cells.

    Code, images and other blocks stay as they are, and so do nulls.
    """
    each = lambda values: F.transform(values, change)
    table = F.col("kind") == "table"
    return parsed.withColumns(
        {
            "text": F.when(F.col("kind").isin("heading", "paragraph", "callout"), change(F.col("text"))).otherwise(F.col("text")),
            "items": F.when(F.col("kind") == "list", each(F.col("items"))).otherwise(F.col("items")),
            "headers": F.when(table, each(F.col("headers"))).otherwise(F.col("headers")),
            "rows": F.when(table, F.transform("rows", each)).otherwise(F.col("rows")),
        }
    )
