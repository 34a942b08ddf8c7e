"""Composition of pages from layers of blocks, and overrides applied on top.

A layer is rows (slug, layer, ordinal, kind, level, text) of one of the layers in
``LAYERS``. Blocks are compared by fingerprint; only fingerprints of a page meet in
one row, texts are joined to the result afterwards. What a page is made of, by rule:

* a protected page with a user layer is that layer;
* without a user layer it is the generated one and then the AI's;
* without a generated layer it is the user's, then what the AI has besides;
* else both are aligned over the previous generated version: its blocks are looked
  up in the user's from the first on, each after the one before, until one is not
  found. A block found is the user's untouched one and gives way to the generated
  block of the same rank; blocks of the user between and after are the user's. The
  previous blocks that were not found are what the user replaced: if one of them is
  nowhere in the generated version, both sides changed and that is a conflict. The
  generated blocks that are left follow, then what the AI has besides.

A layer without rows is no layer. Nulls in kind, level and text are values like others.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import text as X
from tessella.operators.common import bound_batches

LAYERS = ("generated", "previous", "user", "ai")
_COLUMNS = ("slug", "layer", "ordinal", "kind", "level", "text")
#: Owner of the blocks of a layer.
OWNERS = {"generated": "generated", "user": "user-authored", "ai": "ai-generated"}


def fingerprint(kind: Column | str = "kind", level: Column | str = "level", text: Column | str = "text") -> Column:
    """Sixteen hex digits of a block: equal for equal kind, level and text only."""
    part = lambda c: F.coalesce(X.col(c).cast("string"), F.lit("\x01"))
    return X.hash16(F.concat_ws("\x00", part(kind), part(level), part(text)))


def align(previous: Sequence[str], user: Sequence[str]) -> list[int]:
    """Places in ``user`` of the first blocks of ``previous``, ascending, up to the first that is not found."""
    places: dict[str, list[int]] = {}
    for k in range(len(user) - 1, -1, -1):
        places.setdefault(user[k], []).append(k)  # the last entry is the first place not passed
    found, at = [], -1
    for block in previous:
        open_places = places.get(block, [])
        while open_places and open_places[-1] <= at:
            open_places.pop()
        if not open_places:
            break
        at = open_places[-1]
        found.append(at)
    return found


def merge(generated: Sequence[str], previous: Sequence[str], user: Sequence[str]) -> tuple[list[tuple[str, int, str]], int | None]:
    """Entries (layer, rank, owner) of a page with both layers, and the rank of the previous block that a conflict starts at."""
    anchors = align(previous, user)
    out: list[tuple[str, int, str]] = []
    taken = {at: rank for rank, at in enumerate(anchors)}
    ends = anchors[-1] + 1 if anchors else 0
    for k in range(len(user)):
        rank = taken.get(k)
        if rank is None:
            out.append(("user", k, OWNERS["user"]))
        elif rank < len(generated):
            out.append(("generated", rank, OWNERS["generated"]))
        else:
            out.append(("user", k, OWNERS["generated"]))
    after, conflict = min(len(anchors), len(generated)), None
    replaced = previous[len(anchors) :]
    if ends < len(user) and replaced:  # the user put something where these stood
        later: dict[str, list[int]] = {}
        for k, block in enumerate(generated):
            later.setdefault(block, []).append(k)
        for block in replaced:
            places = later.get(block)
            if places is None:
                conflict = len(anchors)
                break
            after = next((k + 1 for k in places if k >= after), after)
    out += [("generated", k, OWNERS["generated"]) for k in range(after, len(generated))]
    return out, conflict


def compose_blocks(
    protected: bool, generated: Sequence[str], previous: Sequence[str], user: Sequence[str], ai: Sequence[str]
) -> tuple[list[tuple[str, int, str]], int | None]:
    """Entries (layer, rank in it, owner) of one page from the fingerprints of its layers, and where a conflict starts."""
    whole = lambda layer, blocks: [(layer, k, OWNERS[layer]) for k in range(len(blocks))]
    if protected and len(user):
        return whole("user", user), None
    if not len(user):
        return whole("generated", generated) + whole("ai", ai), None
    conflict = None
    if not len(generated):
        out = whole("user", user)
    else:
        out, conflict = merge(generated, previous if len(previous) else generated, user)
    of = {"generated": generated, "user": user}
    known = {of[layer][rank] for layer, rank, _ in out}
    return out + [e for e in whole("ai", ai) if ai[e[1]] not in known], conflict


_ENTRY = T.StructType([T.StructField("layer", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("ownership", T.StringType())])
_PLAN = T.StructType([T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("conflict", T.IntegerType())])


def _planned(layers: DataFrame, pages: DataFrame) -> DataFrame:
    """slug, title, ordinals of each layer in order, and the plan of its entries."""
    bound_batches(layers.sparkSession)
    block = F.struct("ordinal", fingerprint().alias("fp"))
    packed = layers.groupBy("slug").agg(*[F.array_sort(F.collect_list(F.when(F.col("layer") == n, block))).alias(n) for n in LAYERS])

    @F.pandas_udf(_PLAN)
    def plan(protected: pd.Series, generated: pd.Series, previous: pd.Series, user: pd.Series, ai: pd.Series) -> pd.DataFrame:
        made = [compose_blocks(bool(p), list(g), list(v), list(u), list(a)) for p, g, v, u, a in zip(protected, generated, previous, user, ai, strict=True)]
        entries = [[{"layer": layer, "rank": k, "ownership": own} for layer, k, own in e] for e, _ in made]
        return pd.DataFrame({"entries": entries, "conflict": pd.array([c for _, c in made], dtype="Int32")})

    plan = plan.asNondeterministic()  # else Spark runs it once more, to drop empty plans before they are exploded
    of = lambda n, part: F.transform(F.coalesce(n, F.array().cast("array<struct<ordinal:bigint,fp:string>>")), lambda b: b[part])
    met = pages.select("slug", "protected", "user_title", "generated_title").join(packed, "slug", "left")
    title = F.coalesce(F.when(F.size("user") > 0, F.col("user_title")), F.when((F.size("generated") > 0) & ~(F.col("protected") & (F.size("user") > 0)), F.col("generated_title")), F.col("slug").cast("string"))
    return met.select(
        "slug", title.alias("title"), (F.col("protected") & (F.size("user") > 0)).alias("locked"), *[of(F.col(n), "ordinal").alias(n) for n in LAYERS],
        plan(F.coalesce("protected", F.lit(False)), *[of(F.col(n), "fp") for n in LAYERS]).alias("plan"),
    )


def compose(layers: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of composed pages: slug, index, layer, ordinal, ownership, kind, level, text.

    ``pages``: slug, protected, user_title, generated_title. ``layers``: slug, layer,
    ordinal (bigint, unique in a layer of a page), kind, level, text.
    """
    planned = _planned(layers, pages)
    ordinal = F.coalesce(*[F.when(F.col("e.layer") == n, F.get(F.col(n), F.col("e.rank"))) for n in OWNERS])
    entries = planned.select("slug", *OWNERS, F.posexplode("plan.entries").alias("index", "e"))
    placed = entries.select("slug", "index", F.col("e.layer").alias("layer"), ordinal.alias("ordinal"), F.col("e.ownership").alias("ownership"))
    return placed.join(layers.select(*_COLUMNS), ["slug", "layer", "ordinal"]).select("slug", "index", "layer", "ordinal", "ownership", "kind", "level", "text")


def composed_pages(layers: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: slug, title, n_blocks, source (user, ai or compiler)."""
    planned = _planned(layers, pages)
    owners = F.transform("plan.entries", lambda e: e["ownership"])
    source = (
        F.when(F.col("locked"), "user").when(F.array_contains(owners, "ai-generated"), "ai")
        .when(F.forall(owners, lambda o: o == "user-authored"), "user").otherwise("compiler")
    )
    return planned.select("slug", "title", F.size("plan.entries").alias("n_blocks"), source.alias("source"))


def conflicts(layers: DataFrame, pages: DataFrame) -> DataFrame:
    """Findings on pages where user and generator both changed a block: slug, code, severity, ordinal and near (the previous block)."""
    met = _planned(layers, pages).filter("plan.conflict is not null").withColumn("_source", F.when(F.size("previous") > 0, "previous").otherwise("generated"))
    at = met.select("slug", F.col("_source").alias("layer"), F.get(F.when(F.col("_source") == "previous", F.col("previous")).otherwise(F.col("generated")), F.col("plan.conflict")).alias("ordinal"))
    near = F.when(F.col("kind") == "heading", F.col("text")).when(F.col("kind") == "paragraph", F.substring("text", 1, 60)).otherwise(F.col("kind"))
    return at.join(layers.select(*_COLUMNS), ["slug", "layer", "ordinal"]).select(
        "slug", F.lit("DOC_CONTENT_CONFLICT").alias("code"), F.lit("warning").alias("severity"), "ordinal", near.alias("near")
    )


_BLOCK = "struct<kind:string,level:int,text:string,ownership:string>"


def _hidden(blocks: Column, names: Column) -> Column:
    """The blocks outside sections of these headings; a section ends at a heading of its level or higher."""
    low = F.transform(names, F.lower)

    def step(state: Column, b: Column) -> Column:
        head = b["kind"] == "heading"
        level = F.when((state["level"] > 0) & ~(head & (b["level"] <= state["level"])), state["level"]).otherwise(0)
        level = F.when((level == 0) & head & F.array_contains(low, F.lower(b["text"])), b["level"]).otherwise(level)
        kept = F.when(level == 0, F.concat(state["kept"], F.array(b))).otherwise(state["kept"])
        return F.struct(level.alias("level"), kept.alias("kept"))

    none = F.array().cast(f"array<{_BLOCK}>")
    return F.aggregate(blocks, F.struct(F.lit(0).alias("level"), none.alias("kept")), step, lambda s: s["kept"])


def _replaced(blocks: Column, replacements: Column) -> Column:
    """The blocks after each replacement (key, kind, level, text) in turn took the place of the first block that it names."""

    def step(all_blocks: Column, r: Column) -> Column:
        called = lambda b: F.concat(b["kind"], F.lit(":"), F.when(b["kind"].isin("heading", "paragraph", "callout"), b["text"]).otherwise(""))
        meets = F.transform(all_blocks, lambda b: fingerprint(b["kind"], b["level"], b["text"]).startswith(r["key"]) | (called(b) == r["key"]))
        at = F.array_position(meets, True)
        fresh = lambda b: F.struct(r["kind"].alias("kind"), r["level"].alias("level"), r["text"].alias("text"), b["ownership"].alias("ownership"))
        # an array of one element, so that the place is found once and not for each block
        return F.flatten(F.transform(F.array(at), lambda p: F.transform(all_blocks, lambda b, k: F.when(k + 1 == p, fresh(b)).otherwise(b))))

    return F.aggregate(replacements, blocks, step)


def apply_overrides(blocks: DataFrame, titles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Blocks (slug, index, ownership, kind, level, text) of pages after their overrides, with title and description.

    ``titles``: slug, title. ``overrides``, at most one row a page: slug, title,
    description, hide (names of sections), replacements (array of key, kind, level,
    text; a key is the beginning of a fingerprint, or kind and text with a colon),
    before, after (arrays of kind, level, text). In that order: the first heading of
    level 1 follows a new title, sections are hidden, each replacement in turn takes
    the first block that its key names, and blocks of the user's are put around.
    """
    block = F.struct("kind", "level", "text", "ownership").cast(_BLOCK)
    packed = blocks.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("index", block.alias("b")))).alias("p"))
    none = F.array().cast(f"array<{_BLOCK}>")
    bodies = F.coalesce(F.transform("p", lambda x: x["b"]), none).alias("blocks")
    ops = overrides.select("slug", F.struct("title", "description", "hide", "replacements", "before", "after").alias("op"))
    pages = titles.join(packed, "slug", "left").join(ops, "slug", "left").select("slug", "title", bodies, "op")
    renamed = F.col("op.title").isNotNull() & (F.col("op.title") != F.col("title"))
    first = F.array_position(F.transform("blocks", lambda b: F.coalesce((b["kind"] == "heading") & (b["level"] == 1), F.lit(False))), True)
    pages = pages.withColumn("top", F.when(renamed, first).otherwise(0))
    headed = F.transform("blocks", lambda b, k: F.when(k + 1 == F.col("top"), b.withField("text", F.col("op.title"))).otherwise(b))
    pages = pages.select("slug", F.coalesce("op.title", "title").alias("title"), F.col("op.description").alias("description"), headed.alias("blocks"), "op")
    hide = F.coalesce("op.hide", F.array().cast("array<string>"))
    pages = pages.withColumn("blocks", F.when(F.size(hide) > 0, _hidden(F.col("blocks"), hide)).otherwise(F.col("blocks")))
    swaps = F.coalesce("op.replacements", F.array().cast("array<struct<key:string,kind:string,level:int,text:string>>"))
    pages = pages.withColumn("blocks", F.when(F.size(swaps) > 0, _replaced(F.col("blocks"), swaps)).otherwise(F.col("blocks")))
    own = lambda c: F.transform(
        F.coalesce(c, F.array().cast("array<struct<kind:string,level:int,text:string>>")),
        lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), b["text"].alias("text"), F.lit("user-authored").alias("ownership")),
    )
    return pages.select(
        "slug", "title", "description", F.posexplode(F.concat(own(F.col("op.before")), "blocks", own(F.col("op.after")))).alias("index", "b")
    ).select("slug", "title", "description", "index", "b.ownership", "b.kind", "b.level", "b.text")
