"""Knowledge graphs and relations: order, provenance, edges that lead nowhere."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import knowledge as K

SYMBOL = "id string, kind string, name string, file string, qualified string, parent string"
REFERENCE = "kind string, from_id string, to_id string, name string, specifier string"


def test_contributors_run_after_those_they_need():
    c = lambda i, *needs: K.Contributor(i, lambda inputs, needed: K.Graph(None, None), needs)
    assert [x.id for x in K.in_order([c("a", "c"), c("b"), c("c", "b"), c("d")])] == ["b", "c", "a", "d"]
    for bad in ([c("a", "b"), c("b", "a")], [c("a", "missing")], [c("a"), c("a")]):
        with pytest.raises(ValueError, match="contributor"):
            K.in_order(bad)


def test_graph_of_symbols_and_references(spark):
    symbols = [("m", "module", "M", "f", "p.M", None), ("c", "class", "C", "f", None, "m"), ("x", "class", "X", None, None, "gone"), ("c", "class", "other", "f", None, "m")]
    refs = [("import", "c", "m", None, "./m"), ("import", "c", "m", None, "./m"), ("heritage", "c", "x", "X", "s"), ("alias", "c", "x", "X", None), ("export", "c", None, "y", None), ("export", "c", "nowhere", "y", None)]
    tables = {"symbols": spark.createDataFrame(symbols, SYMBOL), "references": spark.createDataFrame(refs, REFERENCE)}
    again = K.Contributor("again", lambda inputs, needed: K.Graph(None, needed["references"].edges.filter("kind = 'imports'")), ("references",))
    got = K.build_graph([again, K.STRUCTURAL, K.REFERENCES], tables)
    assert {(r.id, r.kind, r.label, *r.sources) for r in got.nodes.collect()} == {("m", "module", "M", "structural"), ("c", "symbol", "C", "structural"), ("x", "symbol", "X", "structural")}
    edges = {(r.src, r.dst, r.kind, r.label): r.sources for r in got.edges.collect()}
    assert edges == {
        ("m", "c", "owns", ""): ["structural"], ("c", "m", "declared-in", ""): ["structural"], ("c", "m", "imports", "./m"): ["again", "references"], ("c", "x", "references", "X"): ["references"],
    }
    assert got.edges.select("id").distinct().count() == 4
    none = {k: t.limit(0) for k, t in tables.items()}
    assert K.build_graph([K.STRUCTURAL, K.REFERENCES], none).edges.count() == 0


def test_relations_keep_the_first_and_name_all(spark):
    pages = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "slug string")
    shape = "src string, dst string, kind string, label string, weight double, confidence double"
    make = lambda *rows: lambda p: spark.createDataFrame(rows, shape)
    one = K.Resolver("one", make(("a", "b", "uses", "x", 0.5, 1.0), ("a", "a", "uses", "x", 0.5, 1.0), ("a", "zz", "uses", "x", 0.5, 1.0), ("c", "b", "nextStep", "n", 0.4, 0.5)))
    two = K.Resolver("two", make(("a", "b", "uses", "y", 0.9, 1.0), ("b", "c", "prerequisite", "p", 1.0, 1.0), ("b", "c", "previousStep", "q", 1.0, 1.0)))
    derived = K.derive_relations(pages, [one, two])
    got = {(r.src, r.dst, r.kind): (r.label, round(r.weight, 3), *r.sources) for r in derived.collect()}
    assert got == {
        ("a", "b", "uses"): ("x", 0.5, "one", "two"), ("b", "a", "usedBy"): ("x", 0.45, "mirror"), ("c", "b", "nextStep"): ("n", 0.4, "one"), ("b", "c", "prerequisite"): ("p", 1.0, "two"), ("b", "c", "previousStep"): ("q", 1.0, "two"),
    }
    assert K.derive_relations(pages, [one, two], mirror=False).count() == 4
    found = K.examine(pages, derived, ["prerequisite"])
    assert {tuple(r) for r in found.actions.collect()} == {("d", "link-page", "orphan")}
    assert found.counts.first()["relations"] == 5
    assert derived.filter(F.size("sources") > 1).count() == 1
