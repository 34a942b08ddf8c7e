"""The leading block of keys of a document: split, typed fields, order, date, author, locked regions.

A small reader takes the block, and nothing but the block, in Arrow batches; the text
stays where it is. A quoted value is a string; an unquoted one is a number, a truth
value, a day or a string by its form, so a title ``42`` is no title.

Defined cases: of a repeated key the first value counts, and ``problem`` names it, as it
does lines that were not understood; a block that is no map has no keys; a document
without a block, an empty or a null one has null fields and itself as body.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X
from tessella.functions.yaml_block import Day, as_json, read_block

# The keys that have fields of their own, and the form of the block.
KNOWN = ("title", "description", "sidebar", "protected", "aliases", "locale", "custom")
FENCE = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)"
BLANKS = " \t\n\r\x0b\x0c"

_FIELDS = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("locale", T.StringType()), T.StructField("protected", T.BooleanType()),
        T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("sidebar", T.MapType(T.StringType(), T.StringType())), T.StructField("custom", T.MapType(T.StringType(), T.StringType())),
        T.StructField("unknown", T.MapType(T.StringType(), T.StringType())), T.StructField("order", T.DoubleType()), T.StructField("date", T.StringType()), T.StructField("author", T.StringType()),
        T.StructField("problem", T.StringType()),
    ]
)


def _number(value: object) -> float | None:
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    try:
        return float(value) if abs(float(value)) < float("inf") else None
    except OverflowError:
        return None


def fields(block: str) -> dict:
    """The typed fields of a block; ``sidebar``, ``custom`` and ``unknown`` hold JSON by key."""
    data, problems = read_block(block)
    text = lambda k: data[k] if type(data.get(k)) is str else None
    record = lambda k: data[k] if isinstance(data.get(k), dict) else None
    packed = lambda d: None if d is None else {k: as_json(v) for k, v in d.items()}
    unknown = {k: v for k, v in data.items() if k not in KNOWN}
    side = record("sidebar") or {}
    # the sidebar's order comes first; a value that is no number is no order, and hides the other
    order = _number(side["order"] if side.get("order") is not None else unknown.get("order"))
    day, author = unknown.get("date"), unknown.get("author")
    return {
        "title": text("title"), "description": text("description"), "locale": text("locale"), "protected": data.get("protected") is True,
        "aliases": [a for a in data["aliases"] if type(a) is str] if isinstance(data.get("aliases"), list) else None,
        "sidebar": packed(record("sidebar")), "custom": packed(record("custom")), "unknown": packed(unknown), "order": order,
        "date": str(day) if isinstance(day, str | Day) else None, "author": author.strip() or None if type(author) is str else None, "problem": "; ".join(problems) or None,
    }


def split_frontmatter(docs: DataFrame, raw: str) -> DataFrame:
    """Adds the fields of a document's leading block, what was not understood (``problem``), and ``body``.

    Fields: title, description, locale, protected, aliases, sidebar, custom and unknown (maps from
    key to JSON), order, date (a day of the calendar as it is written) and author.
    """
    @F.pandas_udf(_FIELDS)
    def read(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fields(b or "") for b in blocks], columns=_FIELDS.fieldNames(), dtype=object)

    found = docs.withColumn("_f", read(F.coalesce(F.regexp_extract(F.col(raw), FENCE, 1), F.lit(""))))
    day = F.substring("_f.date", 1, 10)
    own = {n: F.col(f"_f.{n}") for n in _FIELDS.fieldNames()} | {"date": F.when(X.is_calendar_date(day), day)}
    body = F.trim(F.regexp_replace(F.col(raw), FENCE, ""), F.lit(BLANKS))
    return found.withColumns(own | {"body": body}).drop("_f")


def page_order() -> Column:
    """The page's number: of the sidebar, else its own; 0 where neither is a finite number."""
    return F.coalesce(F.col("order"), F.lit(0.0))


def page_date() -> Column:
    """The publication day, null unless it is written as a day of the calendar."""
    return F.col("date")


def page_author() -> Column:
    """The author, null unless it is a string with something in it."""
    return F.col("author")


def locked_regions(docs: DataFrame, key: str, raw: str, mark: str = "lock") -> DataFrame:
    """A row for each region between ``<!-- mark -->`` and ``<!-- /mark -->``: ordinal, start, end; open ones are none."""
    begin, end = f"<!-- {mark} -->", f"<!-- /{mark} -->"
    pattern = rf"\Q{begin}\E[\s\S]*?\Q{end}\E"
    found = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(raw, pattern, -1), F.length)
    rows = docs.select(key, F.posexplode(F.arrays_zip(found.alias("match"), gaps.alias("gap"))).alias("at", "m"), gaps.alias("gaps"), found.alias("all"))
    ahead = F.aggregate(F.slice("all", F.lit(1), F.col("at")), F.lit(0), lambda n, m: n + F.length(m))
    start = ahead + F.aggregate(F.slice("gaps", F.lit(1), F.col("at") + 1), F.lit(0), lambda n, g: n + g)
    return rows.filter("m.match is not null").select(
        key, (F.col("at") + 1).cast("long").alias("ordinal"), start.cast("long").alias("start"), (start + F.length("m.match")).cast("long").alias("end")
    )
