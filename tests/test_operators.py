"""Operators on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import diff, graph, markdown, pages, quality, similarity, site
from tessella.sources import files, sinks
from tessella.streaming import events as ev


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


def test_blocks_headings_and_search_text(spark):
    text = "# Title\n\nA para\nof two.\n\n## Part\n\n- one\n- two\n\n```py x\ncode\n```\n\n> Warning: hot\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n![alt](i.png)\n\n---\n\n## Part"
    df = spark.createDataFrame([(1, text)], "id long, t string")
    b = markdown.blocks(df, ["id"], "t")
    kinds = [r.kind for r in b.orderBy("ordinal").collect()]
    assert kinds == ["heading", "paragraph", "heading", "list", "code", "callout", "table", "image", "horizontal-rule", "heading"]
    assert [r.id for r in markdown.headings(b.withColumnRenamed("id", "doc"), ["doc"]).orderBy("ordinal").collect()] == ["title", "part", "part-1"]
    assert "a\nb\n1\n2" in markdown.search_text(b, ["id"]).first().content
    assert markdown.blocks(df.limit(0), ["id"], "t").count() == 0


@pytest.mark.parametrize(
    "text, expected",
    [
        ("see [a](x.md)", "see [a](/x)"),
        ('[a](x.md "T")', '[a](/x "T")'),
        ("[`c`](x.md)", "[`c`](/x)"),
        ("`[a](x.md)`", "`[a](x.md)`"),
        ("[a](y.md)", "[a](y.md)"),
        ("![a](x.md)", "![a](x.md)"),
    ],
)
def test_rewrite_links(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    to = spark.createDataFrame([("x.md", "/x")], "url string, to string")
    assert markdown.rewrite_links(df, ["id"], "t", to).first().t == expected


def test_reachability_excludes_seeds_unless_reached(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(e, seeds)) == [(2, 1), (3, 2)]
    assert rows(graph.reachable(e, seeds, include_seeds=True)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.reachable(e, seeds.limit(0))) == []


def test_topological_levels_leave_cycles_out(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcxy"], "node string")
    levels = graph.topological_levels(n, e)
    assert rows(levels.filter("level is not null")) == [("a", 0), ("b", 1), ("c", 2)]
    assert [r.node for r in graph.topological_order(levels).collect()] == ["a", "b", "c", "x", "y"]
    assert [list(r.path) for r in graph.elementary_cycles(e).collect()] == [["x", "y"]]


def test_mirror_and_gaps(spark):
    r = spark.createDataFrame([("a", "b", "uses", 1.0), ("b", "a", "usedBy", 1.0), ("a", "c", "explains", 0.5)], "src string, dst string, kind string, weight double")
    assert rows(graph.mirror_inverse(r)) == [("c", "a", "deepens", 0.45)]
    n = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(graph.relation_gaps(n, r)) == [("z", 0, 0, "orphan")]


def test_link_statuses(spark):
    links = spark.createDataFrame(
        [(1, "guide", True, None), (2, "gude", True, None), (3, "old", True, None), (4, "/guide.md", True, "nope"), (5, "http://x", False, None), (6, "zzzzzzzz", True, None)],
        "id long, target string, internal boolean, anchor string",
    )
    slugs = spark.createDataFrame([("guide",), ("api",)], "slug string")
    aliases = spark.createDataFrame([("old", "api")], "alias string, slug string")
    anchors = spark.createDataFrame([("guide", "top")], "slug string, anchor string")
    found = {r.id: (r.status, r.rewritten_to) for r in site.resolve_links(links, slugs, aliases, anchors).collect()}
    assert found == {1: ("ok", None), 2: ("renamed", "guide"), 3: ("alias", "api"), 4: ("missing-anchor", None), 5: ("external", None), 6: ("missing-page", None)}


def test_unique_routes(spark):
    p = spark.createDataFrame([("/a",), ("/a",)], "route string")
    with pytest.raises(Exception, match="route taken twice"):
        site.assert_unique_routes(p).collect()


def test_changes_and_moves(spark):
    before = spark.createDataFrame([("a.ts", "export const x = 1;"), ("b.ts", "f();"), ("d/c.ts", "g();"), ("e.ts", "same")], "p string, t string")
    after = spark.createDataFrame([("a.ts", "export const y = 1;"), ("b.ts", "  f();  "), ("n/c.ts", "g();"), ("e.ts", "same"), ("f.md", "new")], "p string, t string")
    c = diff.detect_changes(diff.snapshot(before, "p", "t"), diff.snapshot(after, "p", "t"))
    found = {r.path: (r.kind, list(r.categories), r.old_path) for r in c.collect()}
    assert found == {
        "a.ts": ("modified", ["public-api"], None), "b.ts": ("modified", ["formatting-only"], None),
        "n/c.ts": ("moved", ["internal-implementation"], "d/c.ts"), "f.md": ("added", ["documentation-only"], None),
    }
    assert diff.impact_level(c).first().level == "critical"


def test_budget_skips_what_does_not_fit(spark):
    t = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 4)], "g long, k long, n long")
    assert rows(quality.trim_to_budget(t, "g", "k", F.col("n"), 10).select("k")) == [(1,), (3,)]


@pytest.mark.parametrize("text, ok", [("f(a[1]{})", True), ("(]", False), ("'(' // (\n", True), ("{", False), ('"\\"("', True), ("", True)])
def test_balanced_braces(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(quality.balanced_braces("t").alias("b")).first().b is ok


def test_hide_sections(spark):
    b = spark.createDataFrame(
        [(1, 1, "heading", 1, "A"), (1, 2, "heading", 2, "Secret"), (1, 3, "paragraph", None, "x"), (1, 4, "heading", 3, "deep"), (1, 5, "heading", 2, "B"), (1, 6, "paragraph", None, "y")],
        "d long, ordinal long, kind string, level int, text string",
    )
    assert [r.ordinal for r in quality.hide_sections(b, "d", ["secret"]).orderBy("ordinal").collect()] == [1, 5, 6]


def test_table_of_contents(spark):
    h = spark.createDataFrame([(1, 1, 2, "a", "A"), (1, 2, 3, "b", "B & C"), (1, 3, 2, "d", "D")], "p long, ordinal long, level int, id string, text string")
    toc = pages.table_of_contents(h, "p").first().toc
    assert toc.count("<ul>") == toc.count("</ul>") == 2 and "B &amp; C" in toc


def test_globs_and_ignore(spark):
    df = spark.createDataFrame([(p,) for p in ("a.ts", "src/b.ts", "src/.c/d.ts", "node_modules/x/y.js", "doc/a/b.md")], "p string")
    def match(pattern, dot=False):
        return {r.p for r in df.filter(files.matches("p", pattern, dot)).collect()}
    assert match("*.ts") == {"a.ts", "src/b.ts", "src/.c/d.ts"}
    assert match("/*.ts") == {"a.ts"}
    assert match("src/**/*.ts") == {"src/b.ts"}
    assert match("src/**", dot=True) == {"src/b.ts", "src/.c/d.ts"}
    assert match("doc/{a,z}/[a-c].md") == {"doc/a/b.md"}
    rules = files.parse_ignore("# c\nnode_modules\n*.md\n!doc/a/*.md\n")
    assert {r.p for r in df.filter(files.ignored("p", rules)).collect()} == {"node_modules/x/y.js"}
    assert files.could_reinclude("doc", rules) and not files.could_reinclude("x", rules)
    assert files.expand_braces("a{b,c{d,e}}") == ["ab", "acd", "ace"]


def test_scan_and_snapshots(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("x")
    (tmp_path / "in/d/b.ts").write_text("y")
    (tmp_path / "in/d/c.log").write_text("z")
    found = files.scan(spark, str(tmp_path / "in"), [("*.log", False)])
    assert rows(found.select("relative_path", "kind")) == [("a.md", "documentation"), ("d/b.ts", "source")]
    sinks.write_snapshot(found.select("relative_path", "content_hash"), str(tmp_path / "s"), 1)
    assert sinks.load_snapshot(spark, str(tmp_path / "s"), 1).count() == 2
    assert sinks.load_snapshot(spark, str(tmp_path / "s"), 2) is None
    assert sinks.robots_txt("https://x/").endswith("Sitemap: https://x/sitemap.xml")


def test_shared_pairs_and_prefixes(spark):
    i = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "z")], "k long, e string")
    assert rows(similarity.shared_entity_pairs(i, "k", "e")) == [(1, 2, 2, 0.8, 0.5)]
    f = spark.createDataFrame([("pkg/a/x.ts",), ("top.ts",)], "p string")
    o = spark.createDataFrame([(".",), ("pkg",), ("pkg/a",)], "o string")
    assert rows(similarity.longest_prefix(f, "p", o, "o")) == [("pkg/a/x.ts", "pkg/a"), ("top.ts", ".")]


def test_stream_classifies_and_windows(spark, tmp_path):
    data = spark.createDataFrame([(1, "click", "2024-01-01 00:00:01"), (2, "error", "2024-01-01 00:30:00"), (3, "click", "2024-01-01 02:00:00")], "event_id long, event_type string, ts string")
    data = data.withColumn("ts", F.col("ts").cast("timestamp"))
    data.write.parquet(str(tmp_path / "in"))
    stream = ev.read_events(spark, str(tmp_path / "in"), data).withColumn("class", ev.classify("event_type"))
    ev.write_changes(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("event_id", "class")) == [(1, "file-modified"), (2, "file-removed"), (3, "file-modified")]
    assert ev.windowed_counts(data, "ts", "event_type").count() == 3
    assert rows(ev.debounce(data.withColumn("u", F.lit(1)), "u", "ts", "40 minutes").select("n")) == [(1,), (2,)]


def test_sharing_pairs_come_once_and_are_not_gathered(spark):
    given = {"a": "pqr", "b": "pqrst", "c": "q", "d": "xyz", "e": "", "f": "uvwxyz", "g": "p"}
    r = spark.createDataFrame([(k, e) for k, es in given.items() for e in es] + [("a", "p"), ("g", None), (None, "p")], "k string, e string")
    n = {k: len(es) + (k == "g") for k, es in given.items()}
    expected = sorted((a, b, n[a], n[b], len(set(given[a]) & set(given[b]))) for a in given for b in given if a < b and set(given[a]) & set(given[b]))
    for listed in (0, 1, 3, 5, 256):  # all, some and none of the keys without a list
        assert rows(similarity.sharing_pairs(r, listed)) == expected
    lists = r.filter("k is not null").groupBy("k").agg(F.collect_set("e").alias("s")).select("k", F.size("s").alias("n"), "s", F.explode("s").alias("e"))
    plan = similarity._listed_pairs(lists)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_contained_sets(spark):
    i = spark.createDataFrame([(1, ["p", "q"]), (2, ["q", "p", "p"]), (3, ["q"]), (4, ["q", "z"]), (5, []), (6, [None, "q"])], "k long, s array<string>")
    assert rows(similarity.containment_pairs(i, "k", "s")) == [(1, 2, 2), (1, 3, 1), (2, 3, 1), (3, 4, 1), (3, 6, 1)]


def test_subject_classes_do_not_expand_copies(spark):
    given = [(k, "x", ["p", "q"] if k % 2 else ["q", "p", "p"]) for k in range(100)] + [(100, "x", ["p", "r"]), (101, "y", ["p"]), (102, "x", []), (103, "x", None), (104, None, ["p"])]
    found = similarity.subject_classes(spark.createDataFrame(given, "k long, g string, t array<string>"), "k", ["g"], "t").collect()
    pairs = {(r.a, r.b): r.similarity for r in found if not r.member}
    assert pairs == {(0, 100): 0.5, (0, 102): 0.0, (0, 103): None, (100, 102): 0.0, (100, 103): None, (102, 103): None}
    assert sorted((r.b, r.a) for r in found if r.member) == [(k, 0) for k in range(100)] + [(k, k) for k in range(100, 104)]
    assert {r.similarity for r in found if r.member and r.b <= 101} == {1.0}


def test_graph_rounds_broadcast_no_table(spark, monkeypatch):
    from tessella.operators import structure

    plans, cut = [], graph.cut
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(graph, "cut", lambda df: cut(see(df)))
    monkeypatch.setattr(graph, "SMALL", 0)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    n = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    assert rows(see(graph.walked_edges(e, n.filter("node = 2")))) == [(1, 2), (2, 3), (3, 1), (3, 4)]
    needs = see(graph.dependency_edges(n, e.withColumn("kind", F.lit("extends"))))
    assert rows(see(graph.topological_levels(n, needs.filter("dst <> 1"))).filter("node < 5")) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    kinds = e.withColumn("kind", F.lit("k")).withColumn("resolved", F.col("src") < 3)
    assert rows(see(structure.typed_cycles(kinds))) == [("k", [1, 2, 3], False)]
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
