"""Nesting, symbols and names in scope on small sources, against brute force."""

import random

from tessella.operators import symbols as S

NODE = "file string, node long, start long, end long, kind string, name string, modifiers array<string>, doc string, property string, specifier string"


def nodes(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (10 - len(r))) for r in rows], NODE)


def test_nesting_of_random_trees(spark):
    rng, rows = random.Random(7), []

    def grow(file, low, high):
        k = len(rows)
        rows.append((file, k, low, high, "x"))
        at = low
        while at < high and rng.random() < 0.8:
            end = rng.randrange(at, high + 1)
            grow(file, at, end) if (at, end) != (low, high) else None
            at = end + 1

    for f in "abc":
        for k in range(4):
            grow(f, k * 1000, k * 1000 + rng.randrange(60))
    found = {r.node: (r.parent, r.depth, r.crossing) for r in S.nest(nodes(spark, rows)).collect()}
    for f, k, low, high, _ in rows:
        around = [r for r in rows if r[0] == f and r[1] != k and r[2] <= low and r[3] >= high and ((r[2], r[3]) != (low, high) or r[1] < k)]
        parent = min(around, key=lambda r: (r[3] - r[2], -r[1]))[1] if around else None
        assert found[k] == (parent, len(around), False)


def test_crossing_nodes_are_marked(spark):
    found = {r.node: (r.parent, r.crossing) for r in S.nest(nodes(spark, [("f", 1, 0, 10, "x"), ("f", 2, 5, 15, "x"), ("g", 1, 0, 1, "x")])).collect()}
    assert found[2] == (None, True)
    assert S.nest(nodes(spark, [])).count() == 0


def test_symbols_of_a_file(spark):
    rows = [
        ("f", 1, 0, 100, "class", "A", ["export", "private"], "@deprecated use B"), ("f", 2, 5, 20, "method", "m"), ("f", 3, 6, 6, "parameter", "x"), ("f", 4, 7, 7, "parameter", "y"), ("f", 5, 8, 18, "class", "hidden"),
        ("f", 6, 30, 40, "method", "m", ["protected"]), ("f", 7, 45, 46, "method", "other"), ("f", 8, 50, 60, "class", "not a member"), ("f", 9, 70, 71, "heritage", "Base"), ("f", 10, 72, 73, "heritage", "Base"),
        ("f", 11, 200, 220, "enum", "E"), ("f", 12, 201, 202, "enum-member", "one"), ("f", 13, 203, 204, "enum-member", "two"), ("f", 14, 300, 310, "function", None, ["default"]), ("f", 15, 400, 410, "function", None), ("f", 16, 500, 501, "type-alias", "T"),
    ]
    named = spark.createDataFrame([("f", "E"), ("f", "m")], "file string, name string")
    modules = spark.createDataFrame([("f", "p", "mod")], "file string, package string, module string")
    got = {r.node: r for r in S.symbol_tree(nodes(spark, rows), named, modules).collect()}
    assert sorted(got) == [1, 2, 6, 7, 11, 12, 13, 14, 15, 16]
    assert (got[1].exported, got[1].deprecated, got[1].heritage, got[1].visibility) == (True, True, ["Base"], "private")
    assert (got[2].overload, got[6].overload, got[7].overload) == (0, 1, None)
    assert (got[2].signature, got[2].n_parameters, got[6].signature) == ("(x, y)", 2, "()")
    assert (got[6].visibility, got[6].effective, got[2].effective, got[6].path) == ("protected", "private", "private", ["A", "m"])
    assert (got[11].exported, got[11].members, got[2].exported) == (True, ["one", "two"], False)
    assert (got[14].name, got[15].qualified, got[16].type_name) == ("default", "p.mod.__anonymous_function", None)
    assert len({r.hash for r in got.values()}) == len(got)


def test_bindings(spark):
    rows = [
        ("f", 1, 0, 9, "import", None, None, None, None, "./a"), ("f", 2, 1, 1, "import-specifier", "x", None, None, "y"), ("f", 3, 2, 2, "import-specifier", "x"), ("f", 4, 3, 3, "import-default", "d"), ("f", 5, 4, 4, "import-namespace", "ns"),
        ("f", 6, 10, 19, "export"), ("f", 7, 11, 11, "export-specifier", "out", None, None, "in"), ("f", 8, 20, 29, "export", None, None, None, None, "./b"), ("f", 9, 30, 39, "export", None, None, None, None, "./c"), ("f", 10, 31, 31, "export-namespace", "all"),
        ("f", 11, 40, 49, "import", None, None, None, None, "./bare"), ("f", 12, 50, 59, "export"),
    ]
    got = [tuple(r)[2:] for r in S.bindings(nodes(spark, rows)).orderBy("place").collect()]
    assert got == [
        ("import", "./a", "x", "y"), ("import", "./a", "d", "default"), ("import", "./a", "ns", "*"), ("alias", None, "out", "in"), ("star", "./b", "", None), ("re-export", "./c", "all", "*"),
    ] or got[4][:2] == ("star", "./b")
    assert [g[0] for g in got] == ["import", "import", "import", "alias", "star", "re-export"]


def tables(spark, exports, renames, stars):
    return (
        spark.createDataFrame(exports, "module string, name string, id string, ordinal int"), spark.createDataFrame(renames, "module string, name string, ordinal int, target string, target_name string"),
        spark.createDataFrame(stars, "module string, ordinal int, target string"),
    )


def first_path(module, name, own, renames, stars, seen=()):
    """The end of the first path without repetition, depth first."""
    if name == "*":
        return module
    if (module, name) in own:
        return own[module, name]
    if name == "default":
        return None
    ways = [(t, n) for m, x, _, t, n in sorted(renames, key=lambda r: r[2]) if (m, x) == (module, name)]
    ways += [(t, name) for m, _, t in sorted(stars, key=lambda r: r[1]) if m == module]
    for t, n in ways:
        if (t, n) not in {*seen, (module, name)}:
            if found := first_path(t, n, own, renames, stars, (*seen, (module, name))):
                return found
    return None


def test_names_over_random_re_exports_with_circles(spark):
    rng = random.Random(9)
    for _ in range(3):
        modules, names = [f"m{k}" for k in range(9)], ["a", "b", "c", "default"]
        exports = [(m, n, f"{m}#{n}", 0) for m in modules for n in names if rng.random() < 0.13]
        renames = [(rng.choice(modules), rng.choice(names), k, rng.choice(modules), rng.choice([*names, "*"])) for k in range(14)]
        stars = [(rng.choice(modules), k, rng.choice(modules)) for k in range(9)]
        own = {(m, n): i for m, n, i, _ in exports}
        wanted = spark.createDataFrame([(m, n) for m in modules for n in names], "module string, name string")
        got = {(r.module, r.name): r.id for r in S.resolve_exports(wanted, *tables(spark, exports, renames, stars)).collect()}
        want = {(m, n): first_path(m, n, own, renames, stars) for m in modules for n in names}
        assert got == {k: v for k, v in want.items() if v}


def test_scope_comes_before_exports(spark):
    exports, renames, stars = tables(spark, [("b", "x", "b#x", 0), ("c", "y", "c#y", 0)], [("a", "z", 0, "c", "y")], [("a", 0, "b")])
    local = spark.createDataFrame([("a", "l", "a#l", 0), ("b", "secret", "b#secret", 0), ("b", "x", "b#x", 0)], "module string, name string, id string, ordinal int")
    imports = spark.createDataFrame([("a", "l", 0, "b", "x"), ("a", "i", 1, "b", "x"), ("a", "ns", 2, "c", "*"), ("a", "none", 3, "b", "secret"), ("a", "none", 4, None, "x")], "module string, name string, ordinal int, target string, target_name string")
    uses = spark.createDataFrame([("a", n) for n in ("l", "i", "ns", "none", "z", "x", "secret", "nothing")], "module string, name string")
    got = {r.name: r.id for r in S.resolve_scope(uses, local, imports, exports, renames, stars).collect()}
    assert got == {"l": "a#l", "i": "b#x", "ns": "c", "none": None, "z": "c#y", "x": "b#x", "secret": "b#secret", "nothing": None}


def test_rounds_of_a_chain_write_no_name_twice(spark, monkeypatch):
    made = []

    class Seen(S.Parts):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(S, "Parts", Seen)
    known = tables(spark, [("m0", "a", "m0#a", 0)], [(f"m{k}", "a", 0, f"m{k - 1}", "a") for k in range(1, 4)], [("m9", 0, "m8")])
    wanted = spark.createDataFrame([("m3", "a"), ("m9", "a")], "module string, name string")
    assert [tuple(r) for r in S.resolve_exports(wanted, *known).collect()] == [("m3", "a", "m0#a")]
    keys, steps, lead = made
    assert [p.all().count() for p in made] == [p.all().distinct().count() for p in made] == [6, 4, 4]


def test_rounds_of_scopes_write_no_name_twice(spark, monkeypatch):
    made = []

    class Seen(S.Parts):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(S, "Parts", Seen)
    exports, renames, stars = tables(spark, [("m0", "a", "m0#a", 0)], [(f"m{k}", "a", 0, f"m{k - 1}", "a") for k in (1, 2)], [("m9", 0, "m8")])
    local = spark.createDataFrame([("m9", "own", "m9#own", 0)], "module string, name string, id string, ordinal int")
    imports = spark.createDataFrame([("m9", "i", 0, "m2", "a")], "module string, name string, ordinal int, target string, target_name string")
    uses = spark.createDataFrame([("m9", n) for n in ("i", "own", "lost")], "module string, name string")
    got = {r.name: r.id for r in S.resolve_scope(uses, local, imports, exports, renames, stars).collect()}
    assert got == {"i": "m0#a", "own": "m9#own", "lost": None} and len(made) == 3
    assert all(p.all().count() == p.all().distinct().count() for p in made)


def test_names_that_have_ended_are_not_written_again(spark, monkeypatch):
    sizes, write = [], S.written

    def seen(df):
        out = write(df)
        if len(out.columns) == 5 and "id" in out.columns:  # names with their ids or where they have got to
            sizes.append(out.count())
        return out

    monkeypatch.setattr(S, "written", seen)
    known = tables(spark, [("m0", "a", "m0#a", 0)], [(f"m{k}", "a", 0, f"m{k - 1}", "a") for k in range(1, 5)], [("m9", 0, "m8")])
    wanted = spark.createDataFrame([("m4", "a")], "module string, name string")
    assert [tuple(r) for r in S.resolve_exports(wanted, *known).collect()] == [("m4", "a", "m0#a")]
    assert sizes == [5, 4, 3, 1]
