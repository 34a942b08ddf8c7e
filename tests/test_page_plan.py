"""Page plans of small projects."""

from tessella.operators import page_plan as P


def test_sections_first_wins_gate_and_overrides(spark):
    c = spark.createDataFrame([("p", 1, 0, "api", "Late", None), ("p", 0, 1, "api", "API", "code"), ("p", 0, 0, "intro", "Intro", None), ("p", 0, 2, "faq", "FAQ", "faq"), ("p", 0, 3, "ops", "Ops", "server"), ("q", 0, 0, "api", "API", "code")], "project string, rank int, at int, id string, title string, needs string")
    e = spark.createDataFrame([("p", "code"), ("p", "faq"), ("p", "code")], "project string, kind string")
    o = spark.createDataFrame([("p", "faq", False, None), ("p", "ops", True, "Operations"), ("q", "nothing", True, None)], "project string, id string, enabled boolean, title string")
    got = [tuple(r) for r in P.plan_sections(c, e, o).orderBy("project", "position").collect()]
    assert got == [("p", "intro", "Intro", 1, False), ("p", "api", "API", 2, False), ("p", "ops", "Operations", 3, True)]
    assert P.plan_sections(c.limit(0), e, o).count() == 0


def test_large_groups_are_split(spark):
    shape = "project string, group string, shared boolean, at int, name string, apis array<string>"
    rows = [("p", "big", True, k, f"big {k}", [f"a{k}", None][: k % 2]) for k in range(14)] + [("p", "loose", False, k, f"l{k}", ["x"]) for k in range(7)] + [("p", "one", True, 0, "One", None)]
    got = {r.slug: r for r in P.concept_pages(spark.createDataFrame(rows, shape)).collect()}
    assert len(got) == 1 + 12 + 1 + 1
    assert (got["big"].importance, got["big"].depth, got["big/big-11"].split_from, got["big/big-3"].symbols) == (0.8, "summary", "big", ["a3"])
    assert (got["loose"].consolidated_from, got["loose"].symbols, got["loose"].importance) == ([f"l{k}" for k in range(7)], ["x"], 0.75)
    assert (got["one"].consolidated_from, got["one"].importance, got["one"].split_from) == (None, 0.65, None)


def test_navigation(spark):
    s = spark.createDataFrame([("p", "c", "Concepts", 2), ("p", "e", "Examples", 1)], "project string, id string, title string, position int")
    pages = [("p", "c", "Concepts", "c", 0, None), ("p", "c/b", "B", "c", 3, "c"), ("p", "c/a", "A", "c", 1, "c"), ("p", "x", "X", "c", 2, "gone"), ("p", "y", "Y", "c", 4, None), ("p", "e", "Examples", "e", 5, "c"), ("p", "z", "Z", "unknown", 6, None)]
    got = {r.slug: (r.parent, r.place, r.breadcrumbs) for r in P.organize(s, spark.createDataFrame(pages, "project string, slug string, title string, section string, at int, split_from string")).collect()}
    assert got == {
        "c": (None, [2, 1], ["Documentation", "Concepts"]), "y": (None, [2, 2], ["Documentation", "Concepts", "Y"]), "x": (None, [2, 3], ["Documentation", "Concepts", "gone", "X"]),
        "c/a": ("c", [2, 1, 1], ["Documentation", "Concepts", "A"]), "c/b": ("c", [2, 1, 2], ["Documentation", "Concepts", "B"]), "e": (None, [1, 1], ["Documentation", "Examples", "Concepts", "Examples"]),
    }


def test_paths(spark):
    pages = spark.createDataFrame([("p", s) for s in ("api", "introduction", "getting-started", "setup", "api")] + [("q", "other")], "project string, slug string")
    who = spark.createDataFrame([("p", "developer", 5), ("p", "operator", 4), ("p", "contributor", 3), ("p", "end-user", 2), ("p", "api-consumer", 1)], "project string, persona string, priority int")
    got = [tuple(r) for r in P.learning_paths(pages, who).orderBy("path", "step").collect()]
    assert got == [
        ("p", "End User Path", "end-user", 1, "getting-started"), ("p", "Operator Path", "operator", 1, "setup"),
        ("p", "Primary Journey", "developer", 1, "introduction"), ("p", "Primary Journey", "developer", 2, "getting-started"), ("p", "Primary Journey", "developer", 3, "api"),
    ]
