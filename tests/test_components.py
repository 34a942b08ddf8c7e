"""Components in texts and changed block text, on hard inputs."""

import json
import random

from pyspark.sql import functions as F

from tessella.operators import components as C


def names(text):
    return [(r["name"], r.get("depth"), r["problem"]) for r in C.read_components(text)]


def test_tags_nest_and_what_is_broken_is_named():
    assert names("<A><B/><C>x</C></A>") == [("A", 0, None), ("B", 1, None), ("C", 1, None)]
    assert names("<A><B></A>") == [("A", 0, None), ("B", 1, "not closed")]
    assert names("<A>") == [("A", 0, "not closed")]
    assert names("</A> text") == [("A", None, "not opened")]
    assert names("`<A>` ``<B> ` `` <!-- <C> --> <d> a < B x<") == []
    assert names("```\n<A>\n```\n<B/>\n~~~\n<C/>") == [("B", 0, None)]
    assert names("<A x=\">\" y='</A>' z={f(\"}\", `}`)}>t</A>") == [("A", 0, None)]
    assert names("<A x=> <B y={> <C/>") == [("C", 0, None)]


def test_properties():
    (row,) = C.read_components("<A.b one two=\"a 'b'\" three={ [1, {x: \"}\"}] } {...rest} data-x='1' one='again' />")
    assert json.loads(row["properties"]) == {"one": True, "two": "a 'b'", "three": '{[1, {x: "}"}]}', "data-x": "1"}
    assert (row["flow"], row["line"], row["content"]) == (True, 1, "")


def test_nothing_raises_and_places_are_right():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["<A", ">", "/>", "</A>", "<B x=", "{", "}", '"', "'", "`", "```\n", "\n", " ", "y", "<!--", "-->"]) for _ in range(rng.randrange(25)))
        for r in C.read_components(text):
            assert text[r["start"]] == "<"
            assert r["start"] <= r["end"] <= len(text)
    long = "<A>" * 20_000 + "x" * 1_000_000
    assert len(C.read_components(long)) == 20_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<A n={2}/>\n\ntext <B/>"), (2, None), (3, ""), (4, "none")], "id int, t string").withColumn("name", F.lit("clash"))
    got = C.components(df, ["id"], "t").orderBy("id", "ordinal")
    assert [(r.id, r.name, r.line, r.flow) for r in got.collect()] == [(1, "A", 1, True), (1, "B", 3, False)]
    assert got.select(F.try_variant_get("properties", "$.n", "string").alias("n")).collect()[0].n == "{2}"
    assert C.components(df.limit(0), ["id"], "t").count() == 0


def test_map_block_text_reaches_every_field_and_leaves_code(spark):
    schema = "kind string, text string, items array<string>, headers array<string>, rows array<array<string>>"
    rows = [("paragraph", "a", None, None, None), ("heading", None, None, None, None), ("list", None, ["b", None], None, None), ("table", None, None, ["h"], [["c", "d"], []]), ("code", "e", None, None, None), ("image", "f", None, None, None)]
    got = [tuple(r) for r in C.map_block_text(spark.createDataFrame(rows, schema), F.upper).collect()]
    assert got == [("paragraph", "A", None, None, None), ("heading", None, None, None, None), ("list", None, ["B", None], None, None), ("table", None, None, ["H"], [["C", "D"], []]), ("code", "e", None, None, None), ("image", "f", None, None, None)]
