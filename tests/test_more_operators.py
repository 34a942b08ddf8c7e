"""References, composition, search and planning on small inputs."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import compose, graph, planning, project, references, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_keeps_user_text_and_reports_conflicts():
    assert compose.merge_blocks(["a", "b", "c"], ["a", "b2", "c"], ["a", "mine", "c"]) == [
        ("a", "generated", False), ("mine", "user-authored", True), ("c", "user-authored", False)
    ]
    assert compose.merge_blocks(["a"], ["a2", "new"], ["a"]) == [("a2", "generated", False), ("new", "generated", False)]
    assert compose.merge_blocks([], [], ["x"]) == [("x", "user-authored", False)]


def test_merge_per_page(spark):
    make = lambda *t: spark.createDataFrame([("p", k, x) for k, x in enumerate(t)], "page string, ordinal long, text string")
    out = compose.three_way_merge(make("a", "b"), make("a", "b", "c"), make("a", "b", "z"))
    assert [r.text for r in out.orderBy("ordinal").collect()] == ["a", "b", "z", "c"]


def test_includes_nest_and_cycles_end(spark):
    docs = spark.createDataFrame([(1, "x <!-- @docs:include a --> y"), (2, "<!-- @include loop -->"), (3, "plain")], "id long, t string")
    snippets = spark.createDataFrame([("a", "[<!-- @include b -->]"), ("b", "B"), ("loop", "<!-- @include loop -->")], "name string, body string")
    assert rows(compose.expand_includes(docs, "id", "t", snippets)) == [(1, "x [B] y", False), (2, "", True), (3, "plain", False)]


def test_highlight():
    out = compose.highlight("const a = '<b>'; // c", "ts")
    assert '<span class="tok-keyword">const</span>' in out and '<span class="tok-string">\'&lt;b&gt;\'</span>' in out and '<span class="tok-comment">// c</span>' in out
    assert compose.highlight("a < b", "klingon") == "a &lt; b" and compose.highlight(None, "ts") == ""
    assert "tok-" not in compose.highlight("const " * 4000, "ts")


def test_semantic_diff(spark):
    b = spark.createDataFrame([(1, 1, "heading", 2, "Old"), (1, 2, "paragraph", None, "same"), (1, 3, "code", None, "x")], "d long, ordinal long, kind string, level int, text string")
    a = spark.createDataFrame([(1, 1, "heading", 2, "New"), (1, 2, "paragraph", None, "same"), (1, 3, "code", None, "y")], b.schema)
    assert {(r.change, r.subject) for r in compose.semantic_diff(b, a, "d").collect()} == {
        ("heading-renamed", "Old"), ("content-added", "New"), ("content-removed", "Old"), ("example-updated", "y"), ("content-removed", "x")
    }


def test_imports_take_the_first_candidate(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("lib/index.ts",)], "path string")
    uses = spark.createDataFrame([("src/x.ts", "./a"), ("src/x.ts", "../lib"), ("x.ts", "./none")], "file string, specifier string")
    assert {(r.specifier, r.target) for r in references.resolve_imports(uses, files).collect()} == {("./a", "src/a.ts"), ("../lib", "lib/index.ts"), ("./none", None)}


def test_names_go_through_star_exports(spark):
    exports = spark.createDataFrame([("c", "f"), ("b", "g")], "module string, name string")
    stars = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "module string, source string")
    known = references.exported_names(exports, stars)
    assert rows(known.filter("module = 'a'").select("name", "origin")) == [("f", "c"), ("g", "b")]
    uses = spark.createDataFrame([("m", "f"), ("m", "own"), ("m", "no")], "module string, name string")
    local = spark.createDataFrame([("m", "own")], "module string, name string")
    imported = spark.createDataFrame([("m", "f", "a")], "module string, name string, source string")
    assert {(r.name, r.origin) for r in references.resolve_names(uses, local, imported, known).collect()} == {("f", "c"), ("own", "m"), ("no", None)}


def test_search_ranks_titles_first_and_forgives(spark):
    docs = spark.createDataFrame([(1, "Install guide", "how to"), (2, "Other", "install it"), (3, "None", "nothing")], "id long, title string, content string")
    index = search.inverted_index(docs, "id", {"title": "title", "content": "content"})
    found = search.search(index, "id", spark.createDataFrame([("install",), ("instal",), ("insta",)], "query string"), 3)
    for q in ("install", "instal", "insta"):
        assert [r.id for r in found.filter(F.col("query") == q).orderBy(F.desc("score")).collect()] == [1, 2]


def test_concepts_and_trees(spark):
    c = spark.createDataFrame([(1, "routerLink"), (2, "routerView"), (3, "getThing"), (4, "cache-key")], "ordinal long, name string")
    assert rows(planning.concept_groups(c).select("name", F.size("members"))) == [("cache-key", 1), ("getThing", 1), ("router", 2)]
    t = planning.directory_tree(spark.createDataFrame([("a/b/c.ts",), ("top.ts",)], "p string"), "p")
    assert rows(t) == [("a", ".", 1), ("a/b", "a", 2)]


def test_depth_is_not_capped(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 12) for k in range(12)], "src long, dst long")
    assert [list(r.path) for r in graph.elementary_cycles(ring).collect()] == [list(range(12))]
    exports = spark.createDataFrame([("m20", "f")], "module string, name string")
    stars = spark.createDataFrame([(f"m{k}", f"m{k + 1}") for k in range(20)], "module string, source string")
    assert references.exported_names(exports, stars).count() == 21
    members = spark.createDataFrame([(f"t{k - 1}" if k else None, f"p{k}", f"t{k}") for k in range(10)], "owner string, member string, target string")
    names = spark.createDataFrame([(".".join(f"p{k}" for k in range(n)),) for n in (1, 9, 10)] + [("p0." * 8 + "x",)], "name string")
    assert {len(r.name.split(".")): r.target for r in project.resolve_dotted(names.filter("name not like '%x'"), members).collect()} == {1: "t0", 9: "t8", 10: "t9"}
    assert project.resolve_dotted(names.filter("name like '%x'"), members).first().target is None


def test_alphabetical_order(spark):
    import random

    from tessella.operators import relations

    random.seed(3)
    names = [f"p{k}" for k in range(60)]
    edges = {(random.choice(names[:30]), random.choice(names[20:])) for _ in range(80)} | {("p50", "p51"), ("p51", "p50"), ("b", "c"), ("b", "z")}
    edges = {(a, b) for a, b in edges if a != b}
    every = [*names, "z", "c", "b"]
    placed = []
    while ready := sorted(n for n in every if n not in placed and all(a in placed for a, b in edges if b == n)):
        placed.append(ready[0])
    placed += [n for n in every if n not in placed]
    nodes = spark.createDataFrame([(n, k) for k, n in enumerate(every)], "node string, ordinal long")
    found = relations.alphabetical_order(nodes, spark.createDataFrame(list(edges), "src string, dst string"))
    assert [r.node for r in found.orderBy("position").collect()] == placed
    with pytest.raises(ValueError):
        relations.alphabetical_order(nodes, spark.createDataFrame(list(edges), "src string, dst string"), most=5)


def test_hash_of_utf16_units(spark):
    from tessella.functions import text as X

    def plain(s):
        h, raw = 0x811C9DC5, s.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "little")) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "abc", "é日本", "a😀b𝒳", "\U0010ffff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.fnv1a32("t")).collect()] == [plain(t) for t in texts]


def test_structure(spark):
    from tessella.operators import structure

    edges = [("a", "b", "x", True), ("b", "a", "x", True), ("b", "a", "x", False), ("b", "c", "x", True), ("c", "b", "x", False), ("a", "b", "y", True), ("c", "a", "y", True)]
    found = structure.typed_cycles(spark.createDataFrame(edges, "src string, dst string, kind string, resolved boolean"))
    assert rows(found.select("kind", F.array_join("nodes", ">"), "resolved")) == [("x", "a>b", True), ("x", "b>c", False)]
    none = spark.createDataFrame([], "src string, dst string, kind string, resolved boolean")
    assert structure.typed_cycles(none).collect() == []
    symbols = spark.createDataFrame([("r", None), ("k", "r"), ("j", "r"), ("lost", "gone")], "id string, parent string")
    assert {r.id: (r.position, r.n_children, r.root) for r in structure.ownership_tree(symbols).collect()} == {
        "r": (None, 2, True), "k": (2, 0, False), "j": (1, 0, False), "lost": (None, 0, False),
    }
    page = lambda *x: spark.createDataFrame(list(x), "slug string, fingerprint string")
    changes = structure.diff_architecture(page(("a", "1"), ("b", None), ("c", "1")), page(("a", "1"), ("b", "2"), ("d", None)))
    assert rows(changes.select("slug", "change")) == [("b", "updated"), ("c", "removed"), ("d", "added")]
    quiet = structure.summarize_architecture(changes.limit(0), F.lit(False), F.lit(False)).first()
    assert quiet.is_empty and not structure.summarize_architecture(changes.limit(0), F.lit(True), F.lit(False)).first().is_empty
    links = spark.createDataFrame([("page", "p"), ("page", "q"), ("api", None), ("anchor", "#x"), (None, "p")], "kind string, target string")
    model = spark.createDataFrame([("page", "p"), ("page", "p"), ("api", "q")], "kind string, name string")
    valid = structure.validate_generated_links(links, model)
    assert [(r.kind, r.target, r.valid, r.finding) for r in valid.orderBy("kind", "target").collect()] == [
        (None, "p", False, "unknown-kind"), ("anchor", "#x", True, None), ("api", None, False, "missing-api"), ("page", "p", True, None), ("page", "q", False, "missing-page"),
    ]


def test_planner_relations_join_no_pairs_again(spark):
    rows = [("getting-started", 0, ["overview"], ["s"], None), ("a", 1, ["api"], ["s", "t"], "g"), ("b", 2, ["api"], ["s", "t"], "g"), ("c", 3, ["x"], ["t"], "a"), (None, 4, ["api"], ["t"], "a")]
    schema = "slug string, ordinal long, kinds array<string>, symbols array<string>, split_from string"
    found = planning.planner_relations(spark.createDataFrame(rows + rows[1:2], schema))
    related = [("a", "b", "related"), ("a", "c", "related"), ("a", "getting-started", "related"), ("b", "c", "related"), ("b", "getting-started", "related")]
    assert sorted(map(tuple, found.collect())) == sorted([*related, ("getting-started", "a", "prerequisite"), ("getting-started", "b", "prerequisite"), ("a", "a", "next-step"), ("a", "b", "next-step"), ("a", "c", "extends")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # nothing gathers or joins the pairs again
    assert planning.planner_relations(spark.createDataFrame(rows[1:], schema)).filter("kind = 'prerequisite'").count() == 0


def test_title_mentions_look_for_the_title_before_its_boundaries(spark):
    p = spark.createDataFrame([(1, "Big red", "a Big red-1 one"), (2, "Big blue", "Big redder and xBig blue"), (3, None, "Big blue (Big red)"), (4, "Big", None)], "id long, title string, text string")
    found = references.title_mentions(p, "id", "title", "text")
    assert sorted(map(tuple, found.collect())) == [(3, 1), (3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Contains(") < plan.find("RLIKE")
