"""Composition of pages against a plain walk, and overrides on small pages."""

import random

from pyspark.sql import functions as F

from tessella.operators import composition as C


def walk(generated, previous, user):
    """A plain walk over the three versions with one cursor each: entries (text, owner), conflict."""
    out, conflict, p, u, g = [], None, 0, 0, 0
    while u < len(user):
        if p < len(previous) and previous[p] == user[u]:
            out.append((generated[g] if g < len(generated) else user[u], "generated"))
            g, p, u = min(g + 1, len(generated)), p + 1, u + 1
            continue
        while u < len(user) and not (p < len(previous) and user[u] == previous[p]):
            out.append((user[u], "user-authored"))
            u += 1
        if u == len(user):
            for k in range(p, len(previous)):
                if previous[k] not in generated:
                    conflict = p
                    break
                if previous[k] in generated[g:]:
                    g = generated.index(previous[k], g) + 1
            p = len(previous)
    return out + [(b, "generated") for b in generated[g:]], conflict


def test_merge_equals_a_plain_walk():
    rng = random.Random(2)
    for _ in range(3000):
        one, two, three = ([rng.choice("abcdef") for _ in range(rng.randrange(1, 8))] for _ in range(3))
        entries, conflict = C.merge(one, two, three)
        of = {"generated": one, "user": three}
        assert ([(of[layer][k], own) for layer, k, own in entries], conflict) == walk(one, two, three)


def test_layers_decide_what_a_page_is_made_of():
    owners = lambda *a: [e[2] for e in C.compose_blocks(*a)[0]]
    g, u, ai = ["a", "b"], ["x"], ["a", "x", "new"]
    assert C.compose_blocks(True, g, g, u, ai) == ([("user", 0, "user-authored")], None)
    assert owners(True, g, [], [], ai) == ["generated"] * 2 + ["ai-generated"] * 3
    assert C.compose_blocks(False, [], g, u, ai)[0] == [("user", 0, "user-authored"), ("ai", 0, "ai-generated"), ("ai", 2, "ai-generated")]
    assert C.compose_blocks(False, g, [], ["a", "b"], ai)[0][-2:] == [("ai", 1, "ai-generated"), ("ai", 2, "ai-generated")]
    assert C.compose_blocks(False, [], [], [], []) == ([], None)


def layers(spark, rows):
    return spark.createDataFrame(rows, "slug string, layer string, ordinal long, kind string, level int, text string").withColumn("index", F.lit("clash"))


def pages(spark, rows):
    return spark.createDataFrame(rows, "slug string, protected boolean, user_title string, generated_title string")


def test_pages_with_nulls_repeats_and_without_blocks(spark):
    rows = [
        ("p", "generated", 5, None, None, None), ("p", "generated", 9, "paragraph", None, "same"), ("p", "previous", 1, None, None, None), ("p", "user", 1, None, None, None),
        ("p", "user", 2, "paragraph", None, "same"), ("p", "user", 3, "paragraph", None, "same"), ("p", "ai", 1, "paragraph", None, "same"),
    ]
    known = pages(spark, [("p", None, "T", None), ("empty", True, None, "G")])
    got = C.compose(layers(spark, rows), known).orderBy("index").collect()
    assert [(r.slug, r["index"], r.layer, r.ordinal, r.ownership, r.text) for r in got] == [
        ("p", 0, "generated", 5, "generated", None), ("p", 1, "user", 2, "user-authored", "same"), ("p", 2, "user", 3, "user-authored", "same"), ("p", 3, "generated", 9, "generated", "same"),
    ]
    summary = {r.slug: (r.title, r.n_blocks, r.source) for r in C.composed_pages(layers(spark, rows), known).collect()}
    assert summary == {"p": ("T", 4, "compiler"), "empty": ("empty", 0, "user")}
    assert C.compose(layers(spark, []), pages(spark, [])).count() == 0


def test_conflicts_name_the_replaced_block(spark):
    rows = [("c", layer, 0, "heading", 1, text) for layer, text in (("previous", "Old"), ("generated", "New"), ("user", "Mine"))]
    rows += [("d", "generated", 0, "code", None, "2"), ("d", "previous", 0, "code", None, "1"), ("d", "user", 0, "code", None, "3")]
    rows += [("e", layer, 0, "paragraph", None, text) for layer, text in (("previous", "Old"), ("generated", "Old"), ("user", "Mine"))]
    found = C.conflicts(layers(spark, rows), pages(spark, [(s, False, None, None) for s in "cde"])).collect()
    assert sorted((r.slug, r.near) for r in found) == [("c", "Old"), ("d", "code")]


def test_overrides_apply_in_order(spark):
    blocks = spark.createDataFrame(
        [("p", k, "generated", kind, level, text) for k, (kind, level, text) in enumerate([("heading", 1, "Top"), ("heading", 2, "Gone"), ("paragraph", None, "x"), ("heading", 3, "deep"), ("heading", 2, "Stay"), ("paragraph", None, "x"), ("code", None, "c")])],
        "slug string, index int, ownership string, kind string, level int, text string",
    )
    titles = spark.createDataFrame([("p", "Top"), ("q", "Q")], "slug string, title string")
    swap = "array<struct<key:string,kind:string,level:int,text:string>>"
    block = "array<struct<kind:string,level:int,text:string>>"
    schema = f"slug string, title string, description string, hide array<string>, replacements {swap}, before {block}, after {block}"
    ops = [
        ("p", "New", "about", ["gone"], [("paragraph:x", "paragraph", None, "y"), ("paragraph:y", "code", None, "z"), ("code:", "code", None, "first"), ("paragraph:nothing", "code", None, "!")], [("paragraph", None, "b")], None),
        ("q", None, None, None, None, None, [("paragraph", None, "only")]),
    ]
    got = C.apply_overrides(blocks, titles, spark.createDataFrame(ops, schema)).orderBy("slug", "index").collect()
    assert [(r.slug, r.title, r["index"], r.kind, r.text) for r in got] == [
        ("p", "New", 0, "paragraph", "b"), ("p", "New", 1, "heading", "New"), ("p", "New", 2, "heading", "Stay"), ("p", "New", 3, "code", "first"), ("p", "New", 4, "code", "c"), ("q", "Q", 0, "paragraph", "only"),
    ]


def test_pages_are_planned_in_bounded_batches(spark):
    rows = spark.range(0, 1300, 1, 1).selectExpr("cast(id as string) slug", "'user' layer", "id ordinal", "'code' kind", "cast(null as int) level", "'x' text")
    known = rows.selectExpr("slug", "false protected", "cast(null as string) user_title", "cast(null as string) generated_title")
    keys = [f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "10000")
        spark.conf.set(keys[1], str(1 << 30))
        assert C.composed_pages(rows, known).count() == 1300
        seen = [int(str(spark.conf.get(k)).rstrip("b")) for k in keys]
    finally:
        for k, v in before.items():
            spark.conf.set(k, str(v).rstrip("b"))
    assert seen[0] <= 500 and seen[1] <= 4 << 20
    assert C.compose(rows, known)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
