"""Symbols, bindings and scopes from rows of parsed source.

Nodes come as flat rows (file, node, start, end, kind, name, modifiers, doc); ``start``
and ``end`` are the first and last place that a node covers. Nesting is containment of
intervals, found by a sweep: a running sum of opened and closed intervals gives the
depth, and the parent is the last node opened one level up. All windows run over one
shuffle by file and stream its sorted nodes, spilling where they do not fit.

Exported names are resolved on demand: from the names that are asked for, the names
they lead to are collected round by round; those that lead to nothing are pruned; each
then follows its first open way, by pointer doubling. A way that leads in a circle is
searched path by path: the answer is the end of the first path, in order of the ways,
that visits no name twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators.common import Parts, written

# Kinds of symbols, by what they may contain.
CALLABLE = ("function", "method", "constructor", "getter", "setter")
MEMBERS = ("method", "constructor", "getter", "setter", "property")
DECLARATIONS = ("class", "interface", "enum", "namespace", "function", "type-alias", "variable", "constant")
CONTAINERS = {"class": MEMBERS, "interface": MEMBERS, "enum": ("enum-member",), "namespace": DECLARATIONS}
VISIBILITY = ("public", "protected", "private")
STAR = "*"


def nest(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent`` (null at the top), ``depth`` and ``crossing``.

    Equal intervals nest in order of ``node``. Intervals should nest or lie apart; a node
    that crosses the interval open before it is marked and has no parent.
    """
    own = F.struct(*nodes.columns).alias("n")
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("closing"), (-F.col("end")).alias("wide"), F.col("node").alias("by"))
    events = nodes.select("file", own, F.explode(F.array(event(2 * F.col("start"), 0), event(2 * F.col("end") + 1, 1))).alias("e"))
    so_far = Window.partitionBy("file").orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    opened = events.withColumn("open", F.sum(1 - 2 * F.col("e.closing")).over(so_far)).filter("e.closing = 0")
    leveled = opened.select("file", "n", "e", (F.col("open") - 1).alias("depth"))
    # each node stands on its own level, to be found, and on the one above, to look
    roles = F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("asks")), F.struct((F.col("depth") - 1).alias("level"), F.lit(True).alias("asks")))).alias("r")
    level = Window.partitionBy("file", "r.level").orderBy("e", "r.asks").rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(~F.col("r.asks"), F.struct(F.col("n.node").alias("node"), F.col("n.end").alias("end")))
    met = leveled.withColumn("r", roles).withColumn("p", F.last(found, ignorenulls=True).over(level)).filter("r.asks")
    crossing = F.coalesce((F.col("depth") > 0) & (F.col("p.end") < F.col("n.end")), F.lit(False))
    return met.select("n.*", F.when((F.col("depth") > 0) & ~crossing, F.col("p.node")).alias("parent"), "depth", crossing.alias("crossing"))


def symbol_tree(nodes: DataFrame, exported_names: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols among nested nodes.

    ``exported_names`` (file, name) are named by export clauses; ``modules``: file, package,
    module. A node is a symbol if all nodes around it are containers that may hold what
    they hold. Columns: file, node, parent, kind, name, qualified, path (names from the
    outermost on), overload (place among callables of a name in a container, null if it
    is the only one), visibility, effective (the strictest around), exported, internal,
    deprecated, n_parameters, signature, heritage, type_name, members, hash.
    """
    kinds = nest(nodes).withColumn("modifiers", F.coalesce("modifiers", F.array().cast("array<string>")))
    around = kinds.select("file", F.col("node").alias("parent"), F.col("kind").alias("around"))
    placed = kinds.join(around, ["file", "parent"], "left")
    may = F.when(F.col("parent").isNull(), F.col("kind").isin(*DECLARATIONS))
    for kind, held in CONTAINERS.items():
        may = may.when(F.col("around") == kind, F.col("kind").isin(*held))
    placed = written(placed.withColumn("fits", F.coalesce(may.otherwise(False), F.lit(False))))
    inside = placed.join(_chains(placed), ["file", "node"])
    parts = placed.filter("not fits").groupBy("file", F.col("parent").alias("node")).agg(
        _ordered("parameter").alias("parameters"), F.array_distinct(_ordered("heritage")).alias("heritage"), F.get(_ordered("type-ref"), F.lit(0)).alias("type_name")
    )
    members = placed.filter("kind = 'enum-member'").groupBy("file", F.col("parent").alias("node")).agg(_ordered("enum-member").alias("members"))
    named = exported_names.select("file", "name").distinct().withColumn("listed", F.lit(True))
    met = inside.join(parts, ["file", "node"], "left").join(members, ["file", "node"], "left").join(named, ["file", "name"], "left").join(modules.select("file", "package", "module"), "file", "left")
    callable_ = F.col("kind").isin(*CALLABLE)
    twins = Window.partitionBy("file", "parent", callable_, F.coalesce("name", F.lit("")))
    overload = F.when(callable_ & (F.count("*").over(twins) > 1), F.row_number().over(twins.orderBy("start", F.desc("end"), "node")) - 1)
    has = lambda m: F.array_contains("modifiers", m)
    own_name = F.coalesce("name", F.when(has("default"), "default").otherwise(""))
    qualified = F.concat_ws(".", "package", "module", F.when(own_name == "", F.concat(F.lit("__anonymous_"), "kind")).otherwise(own_name))
    tag = lambda t: F.coalesce(F.regexp_like("doc", F.lit(rf"@{t}\b")), F.lit(False))
    none = F.array().cast("array<string>")
    signed = F.when(callable_, F.concat(F.lit("("), F.array_join(F.coalesce("parameters", none), ", "), F.lit(")")))
    made = met.select(
        "file", "node", "parent", "kind", own_name.alias("name"), qualified.alias("qualified"), "path", overload.alias("overload"),
        _visibility().alias("visibility"), F.element_at(F.array(*[F.lit(v) for v in VISIBILITY]), F.col("strict") + 1).alias("effective"),
        (has("export") | (F.col("parent").isNull() & F.coalesce("listed", F.lit(False)))).alias("exported"), tag("internal").alias("internal"), tag("deprecated").alias("deprecated"),
        F.when(callable_, F.size(F.coalesce("parameters", none))).alias("n_parameters"), signed.alias("signature"),
        F.when(F.col("kind").isin("class", "interface"), F.coalesce("heritage", none)).alias("heritage"),
        F.when(F.col("kind") == "type-alias", F.col("type_name")).alias("type_name"), F.when(F.col("kind") == "enum", F.coalesce("members", none)).alias("members"),
    )
    return made.withColumn("hash", X.hash16(F.concat_ws("|", "file", "qualified", "kind", F.coalesce("overload", F.lit(0)))))


def _visibility() -> Column:
    has = lambda m: F.array_contains("modifiers", m)
    return F.when(has("private"), "private").when(has("protected"), "protected").otherwise("public")


def _ordered(kind: str) -> Column:
    """Names of the child nodes of a kind, in order of place; unnamed ones are left out."""
    one = F.when((F.col("kind") == kind) & (F.coalesce("name", F.lit("")) != ""), F.struct("start", "node", "name"))
    return F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"])


def _chains(placed: DataFrame) -> DataFrame:
    """file, node, path and strict (the strictest visibility) of nodes around which all fit, by pointer doubling."""
    rank = F.when(_visibility() == "private", 2).when(_visibility() == "protected", 1).otherwise(0)
    front = written(placed.filter("fits").select("file", "node", F.col("parent").alias("up"), F.array(F.coalesce("name", F.lit(""))).alias("path"), rank.alias("strict")))
    done = None
    while True:
        ended = front.filter("up is null")
        done = ended if done is None else written(done.unionByName(ended))
        left = front.filter("up is not null")
        if left.isEmpty():
            return done.drop("up")
        above = done.unionByName(left).select("file", F.col("node").alias("up"), F.struct("up", "path", "strict").alias("a"))
        # a node inside one that does not fit meets nothing and goes
        front = written(left.join(above, ["file", "up"]).select("file", "node", F.col("a.up").alias("up"), F.concat("a.path", "path").alias("path"), F.greatest("strict", "a.strict").alias("strict")))


def bindings(nodes: DataFrame) -> DataFrame:
    """Import and export bindings of nested nodes: file, place, form, specifier, local_name, other_name.

    Nodes of kinds ``import`` and ``export`` carry ``specifier``; their children are
    ``import-specifier``, ``import-default``, ``import-namespace``, ``export-specifier``
    (name, and ``property``, the name on the other side) and ``export-namespace``. Forms:
    import (other_name is what is imported), alias (an export without a specifier), re-export,
    star (an export of everything). Of equal names in one statement the first counts.
    """
    n = nest(nodes)
    heads = n.filter("kind in ('import', 'export')").select("file", F.col("node").alias("parent"), F.col("kind").alias("statement"), F.col("specifier").alias("of"), F.col("start").alias("at"))
    shown = F.coalesce("name", "property", F.lit(""))
    other = F.coalesce("property", "name", F.lit(""))
    child = n.filter("kind in ('import-specifier', 'import-default', 'import-namespace', 'export-specifier', 'export-namespace')")
    met = heads.join(child.select("file", "parent", "start", "node", "kind", shown.alias("local_name"), other.alias("far")), ["file", "parent"], "left")
    form = (
        F.when((F.col("statement") == "import") & F.col("kind").startswith("import-"), "import").when(F.col("statement") == "import", None)
        .when(F.col("kind").isNull(), F.when(F.col("of").isNotNull(), "star")).when(F.col("kind").startswith("export-"), F.when(F.col("of").isNull(), "alias").otherwise("re-export"))
    )
    far = F.when(F.col("kind").isin("import-namespace", "export-namespace"), STAR).when(F.col("kind") == "import-default", "default").otherwise(F.col("far"))
    rows = met.select("file", "parent", "at", "start", "node", form.alias("form"), F.col("of").alias("specifier"), "local_name", F.when(F.col("kind").isNotNull(), far).alias("other_name"))
    rows = rows.filter("form is not null and (form = 'star' or local_name <> '') and not (form = 'import' and specifier is null)")
    first = F.row_number().over(Window.partitionBy("file", "parent", "local_name").orderBy("start", "node"))
    kept = rows.withColumn("k", first).filter("k = 1")
    place = F.row_number().over(Window.partitionBy("file").orderBy("at", "start", "node"))
    return kept.select("file", place.alias("place"), "form", "specifier", "local_name", "other_name")


def resolve_exports(wanted: DataFrame, exports: DataFrame, renames: DataFrame, stars: DataFrame) -> DataFrame:
    """``wanted`` (module, name) that lead to a symbol, with its ``id``.

    ``exports``: module, name, id, ordinal; the first id of a name counts. ``renames``: module,
    name, ordinal, target, target_name; the name ``*`` stands for the target module itself, whose
    id is its name. ``stars``: module, ordinal, target. A module's own export comes before named
    re-exports, these before stars, each in order. ``default`` is only ever a module's own.
    """
    named = renames.filter("name <> 'default'").select("module", "name", F.lit(0).alias("rank"), "ordinal", "target", "target_name")
    passed = lambda keys: keys.filter("name <> 'default'").select("module", "name", F.lit(1).alias("rank"))
    return _resolve(wanted, exports, named, stars, passed)


def _resolve(wanted: DataFrame, terminal: DataFrame, named: DataFrame, stars: DataFrame, passed: Callable[[DataFrame], DataFrame], own_ways: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Follows names to the first terminal (module, name, id, ordinal) that their ways in order lead to.

    ``named``: ways of names (module, name, rank, ordinal, target, target_name). Names that go on
    over ``stars`` (module, ordinal, target) are ``passed`` of names, with a rank; ``own_ways`` gives
    the ways that names have by themselves.

    Each name is kept with its own id if it has one, so ends are not looked for again. Names known
    before are told by a left join: Spark moves an anti join below the join that finds names, where
    it would shuffle all ways once more a round.
    """
    name, aim = ["module", "name"], ["target", "target_name"]
    own = written(terminal.groupBy(*name).agg(F.min_by("id", "ordinal").alias("id")))
    named, stars = written(named.filter("target is not null")), stars.filter("target is not null")
    fresh = lambda df, known: df.join(known.all().select(*name, F.lit(True).alias("known")), name, "left").filter("known is null").drop("known")
    keys, steps = Parts(), Parts()
    asked = front = keys.add(wanted.select(*name).distinct().join(own, name, "left"))
    while True:  # the names that names lead to, and the ways there
        front = front.filter("id is null").select(*name)
        step = front.join(named, name).select(*named.columns)
        step = step.unionByName(passed(front).join(stars, "module").select("module", "name", "rank", "ordinal", "target", F.col("name").alias("target_name")))
        if own_ways:
            step = step.unionByName(own_ways(front))
        step = steps.add(step)
        led = step.filter(F.col("target_name") != STAR).select(F.col("target").alias("module"), F.col("target_name").alias("name")).distinct()
        front = keys.add(fresh(led, keys).join(own, name, "left"))
        if front.isEmpty():
            break
    ways = steps.all()
    ends = keys.all().filter("id is not null")
    # names that lead somewhere, from the ends back
    lead = Parts()
    front = lead.add(ends.select(*name).unionByName(ways.filter(F.col("target_name") == STAR).select(*name)).distinct())
    while True:
        back = front.select(F.col("module").alias("target"), F.col("name").alias("target_name"))
        front = lead.add(fresh(ways.join(back, aim).select(*name).distinct(), lead))
        if front.isEmpty():
            break
    lives = lead.all().select(F.col("module").alias("target"), F.col("name").alias("target_name"), F.lit(True).alias("lives"))
    live = ways.join(lives, aim, "left").filter((F.col("target_name") == STAR) | F.col("lives"))
    order = Window.partitionBy(*name).orderBy("rank", "ordinal", *aim)
    live = written(live.select(*name, *aim, F.row_number().over(order).alias("way")))
    first = live.filter("way = 1")
    star = F.col("target_name") == STAR
    state = first.select(*name, F.when(star, F.col("target")).alias("id"), F.when(~star, F.col("target")).alias("to_module"), F.when(~star, F.col("target_name")).alias("to_name"))
    none = F.lit(None).cast("string")
    state = written(state.unionByName(ends.select(*name, "id", none.alias("to_module"), none.alias("to_name"))))
    # chains are halved a round; what has ended is not written again
    done, chains = state.filter("id is not null").select(*name, "id"), state.filter("id is null").select(*name, "to_module", "to_name")
    left, before = chains.count(), None
    while left and left != before:  # a round that ends no chain leaves only circles and what leads into them
        ahead = done.select(*name, "id", none.alias("m2"), none.alias("n2")).unionByName(chains.select(*name, none.alias("id"), F.col("to_module").alias("m2"), F.col("to_name").alias("n2")))
        ahead = ahead.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), "id", "m2", "n2")
        met = written(chains.join(ahead, ["to_module", "to_name"]).select(*name, "id", "m2", "n2"))
        done = done.unionByName(met.filter("id is not null").select(*name, "id"))
        chains = met.filter("id is null").select(*name, F.col("m2").alias("to_module"), F.col("n2").alias("to_name"))
        left, before = chains.count(), left
    found = done
    if left:
        circling = written(asked.select(*name).join(chains.select(*name), name, "left_semi"))
        if not circling.isEmpty():
            found = found.unionByName(_first_paths(circling, live.join(chains.select(*name), name, "left_semi"), found))
    return asked.select(*name).join(found, name)


def _first_paths(starts: DataFrame, live: DataFrame, ends: DataFrame) -> DataFrame:
    """Ends of the first path from each start that visits no name twice.

    ``live``: the ways of names that are in circles or lead into them; ``ends``: the names they
    lead to outside, each with where its own first ways end, for these meet no name in a circle.
    """
    key = F.concat_ws("\x00", "module", "name")
    paths = starts.select(F.struct("module", "name").alias("s"), "module", "name", F.array(key).alias("seen"), F.array().cast("array<int>").alias("turns"))
    stops = ends.select(F.col("module").alias("target"), F.col("name").alias("target_name"), F.col("id").alias("end"))
    ways = live.join(stops, ["target", "target_name"], "left")
    ways = written(ways.withColumn("end", F.when(F.col("target_name") == STAR, F.col("target")).otherwise(F.col("end"))))
    best = None
    while True:
        step = paths.join(ways, ["module", "name"]).select("s", F.col("target").alias("module"), F.col("target_name").alias("name"), "seen", F.concat("turns", F.array("way")).alias("turns"), "end")
        met = written(step.filter(~F.array_contains("seen", key)).withColumn("seen", F.concat("seen", F.array(key))))
        if best is not None and met.isEmpty():
            return best.select("s.module", "s.name", F.col("best.end").alias("id"))
        hits = met.filter("end is not null").groupBy("s").agg(F.min(F.struct("turns", "end")).alias("best"))
        best = written(hits if best is None else best.unionByName(hits).groupBy("s").agg(F.min("best").alias("best")))
        # a path that parts from the best one on a later way cannot come first
        paths = met.filter("end is null").drop("end").join(best, "s", "left").filter("best is null or turns < best.turns").drop("best")


def resolve_scope(uses: DataFrame, local: DataFrame, imports: DataFrame, exports: DataFrame, renames: DataFrame, stars: DataFrame) -> DataFrame:
    """Each use (module, name) with the ``id`` that it has in its module's scope, null if none.

    ``local``: module, name, id, ordinal. ``imports``: module, name, ordinal, target, target_name,
    where ``*`` is the target itself; the other tables are those of :func:`resolve_exports`. Local
    names come first, then imports in order, then what the module exports or re-exports by name,
    then the scopes of the modules that it passes on whole.
    """
    got = _resolve_marked(uses.select("module", F.concat(F.lit("s:"), "name").alias("name")), local, imports, exports, renames, stars)
    return uses.join(got.select("module", F.substring("name", 3, 1 << 20).alias("name"), "id"), ["module", "name"], "left")


def _resolve_marked(asked: DataFrame, local: DataFrame, imports: DataFrame, exports: DataFrame, renames: DataFrame, stars: DataFrame) -> DataFrame:
    """Names (module, name) with a mark before them that lead to a symbol, and its ``id``.

    Marks: ``s:`` in scope; ``x:`` as exported; ``e:`` as exported, but not over stars.
    """
    marked = lambda df, mark: df.select("module", F.concat(F.lit(mark), "name").alias("name"), "id", "ordinal")
    ends = marked(local, "s:").unionByName(marked(exports, "e:")).unionByName(marked(exports, "x:"))
    far = lambda c: F.when(F.col(c) == STAR, F.col(c)).otherwise(F.concat(F.lit("x:"), c)).alias("target_name")

    way = lambda df, mark, rank: df.select("module", F.concat(F.lit(mark), "name").alias("name"), F.lit(rank).alias("rank"), "ordinal", "target", far("target_name"))
    renamed = renames.filter("name <> 'default'")
    named = way(imports, "s:", 0).unionByName(way(renamed, "e:", 0)).unionByName(way(renamed, "x:", 0))
    scope = lambda keys: keys.filter(F.col("name").startswith("s:"))
    passed = lambda keys: keys.filter("substring(name, 1, 2) <> 'e:' and name <> 'x:default'").select("module", "name", F.lit(2).alias("rank"))
    own = lambda keys: scope(keys).select("module", "name", F.lit(1).alias("rank"), F.lit(0).alias("ordinal"), F.col("module").alias("target"), F.concat(F.lit("e:"), F.substring("name", 3, 1 << 20)).alias("target_name"))
    return _resolve(asked, ends, named, stars, passed, own)


def resolve_dotted_scope(uses: DataFrame, symbols: DataFrame, **scope: DataFrame) -> DataFrame:
    """Each use (module, name) of a dotted name with its ``id``: the first part by scope, then member by member.

    ``symbols``: id, parent (a symbol or a module), name, ordinal; the first member of a name counts.
    ``scope``: the tables of :func:`resolve_scope`.
    """
    heads = uses.select("module", _part("name", 0).alias("name")).distinct()
    found = resolve_scope(heads, **scope).select("module", F.col("name").alias("head"), "id")
    return uses.join(_members(uses, found, symbols), ["module", "name"], "left")


def _part(name: str, k: int) -> Column:
    return F.get(F.split(name, r"\."), F.lit(k))


def _members(uses: DataFrame, heads: DataFrame, symbols: DataFrame) -> DataFrame:
    """module, name, id of dotted names from the symbols of their first parts (module, head, id)."""
    u = uses.select("module", "name").distinct().select("module", "name", F.split("name", r"\.").alias("parts"), _part("name", 0).alias("head"))
    state = written(u.join(heads, ["module", "head"], "left").select("module", "name", "parts", "id"))
    members = symbols.groupBy("parent", F.col("name").alias("part")).agg(F.min_by("id", "ordinal").alias("member"))
    longest = state.agg(F.max(F.size("parts"))).first()[0] or 0
    for k in range(1, longest):
        deep = state.filter(F.size("parts") > k).withColumns({"part": F.get("parts", F.lit(k)), "parent": F.col("id")}).join(members, ["parent", "part"], "left")
        state = written(state.filter(F.size("parts") <= k).unionByName(deep.select("module", "name", "parts", F.col("member").alias("id"))))
    return state.select("module", "name", "id")


#: What a class or interface takes from a target of a kind.
HERITAGE = {"class": "extends", "interface": "implements"}


def reference_edges(
    symbols: DataFrame, imports: DataFrame, import_names: DataFrame, exported: DataFrame, aliases: DataFrame, reexports: DataFrame,
    packages: DataFrame, dependencies: DataFrame, defaults: DataFrame,
) -> DataFrame:
    """References between symbols: id, kind, from_id, name, specifier, to_id, to_file.

    A module's id is its name. ``symbols``: module, id, parent (a symbol or the module), kind, name,
    ordinal, exported, heritage, type_name. ``imports``: module, specifier, target (null: not of the
    project), target_file. ``import_names``: module, ordinal, local_name, other_name, specifier, target.
    ``exported``: module, name. ``aliases``: module, exported_name, local_name. ``reexports``: module,
    ordinal, specifier, name (null: everything), other_name, target, target_file. ``packages``: name,
    main, workspace. ``dependencies``: package, dependency, type. ``defaults``: module, id, ordinal.

    Kinds: import, import-name, workspace or package, export, alias, re-export, heritage and with it
    extends or implements, type-use, ownership, containment, dependency. Names are resolved over
    re-exports, in one pass for all edges that need it.
    """
    top = symbols.filter(F.col("parent") == F.col("module"))
    local = top.select("module", "name", "id", "ordinal")
    by_alias = aliases.join(local.select("module", F.col("name").alias("local_name"), "id", "ordinal"), ["module", "local_name"])
    own = top.filter("exported").select("module", "name", "id", "ordinal").unionByName(by_alias.select("module", F.col("exported_name").alias("name"), "id", (F.col("ordinal") + (1 << 30)).alias("ordinal")))
    own = written(own.unionByName(defaults.select("module", F.lit("default").alias("name"), "id", "ordinal")))
    renames = reexports.filter("name is not null").select("module", "name", "ordinal", "target", F.col("other_name").alias("target_name"))
    stars = reexports.filter("name is null and target is not null").select("module", "ordinal", "target")
    wanted = [
        import_names.filter("target is not null").select(F.col("target").alias("module"), F.col("other_name").alias("name")), exported.select("module", "name"),
        aliases.select("module", F.col("local_name").alias("name")), renames.filter("target is not null").select(F.col("target").alias("module"), F.col("target_name").alias("name")),
    ]
    uses = top.filter("kind in ('class', 'interface')").select("module", "id", "kind", F.explode("heritage").alias("name"), F.lit("heritage").alias("use"))
    uses = written(uses.unionByName(top.filter("kind = 'type-alias' and type_name is not null").select("module", "id", "kind", F.col("type_name").alias("name"), F.lit("type-use").alias("use"))))
    asked = uses.select("module", F.concat(F.lit("s:"), _part("name", 0)).alias("name"))
    for w in wanted:
        asked = asked.unionByName(w.filter(F.col("name") != STAR).select("module", F.concat(F.lit("x:"), "name").alias("name")))
    scope_imports = import_names.select("module", F.col("local_name").alias("name"), "ordinal", "target", F.col("other_name").alias("target_name"))
    found = written(_resolve_marked(asked, local, scope_imports, own, renames, stars))
    bare_name = F.substring("name", 3, 1 << 20)
    got = found.filter(F.col("name").startswith("x:")).select("module", bare_name.alias("name"), "id")
    heads = found.filter(F.col("name").startswith("s:")).select("module", bare_name.alias("head"), "id")
    at = lambda module, name: got.select(F.col("module").alias(module), F.col("name").alias(name), F.col("id").alias("to_id"))
    none = F.lit(None).cast("string")

    def edge(df: DataFrame, kind: Column | str, from_id: str, **given: Column | str) -> DataFrame:
        cols = {c: given.get(c, none) for c in ("name", "specifier", "to_id", "to_file")}
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(kind.alias("kind"), F.col(from_id).alias("from_id"), *[X.col(v).alias(c) for c, v in cols.items()])

    whole = lambda df, name: F.when(F.col(name) == STAR, F.col("target")).otherwise(F.col("to_id"))
    bare = imports.select("module", "specifier").distinct().filter(~F.col("specifier").rlike(r"^[./]")).withColumn("package", X.package_name("specifier"))
    known = bare.join(packages.select(F.col("name").alias("package"), "main", "workspace"), "package", "left")
    led = _members(uses, heads, symbols)
    met = written(uses.join(led.select("module", "name", F.col("id").alias("to_id")), ["module", "name"], "left").join(symbols.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind")), "to_id", "left"))
    special = F.coalesce(*[F.when(F.col("to_kind") == k, v) for k, v in HERITAGE.items()])
    edges = [
        edge(imports.select("module", "specifier", "target", "target_file").distinct(), "import", "module", specifier="specifier", to_id="target", to_file="target_file"),
        edge(import_names.join(at("target", "other_name"), ["target", "other_name"], "left").withColumn("to_id", whole(import_names, "other_name")), "import-name", "module", name="local_name", specifier="specifier", to_id="to_id"),
        edge(known, F.when(F.coalesce("workspace", F.lit(False)), "workspace").otherwise("package"), "module", specifier="specifier", to_file=F.when(~F.col("workspace"), F.col("main"))),
        edge(exported.join(at("module", "name"), ["module", "name"], "left"), "export", "module", name="name", to_id="to_id"),
        edge(aliases.join(at("module", "local_name"), ["module", "local_name"], "left"), "alias", "module", name="exported_name", to_id="to_id"),
        edge(reexports.filter("name is null"), "re-export", "module", specifier="specifier", to_id="target", to_file="target_file"),
        edge(reexports.filter("name is not null").join(at("target", "other_name"), ["target", "other_name"], "left").withColumn("to_id", whole(reexports, "other_name")), "re-export", "module", name="name", specifier="specifier", to_id="to_id"),
        edge(met, F.col("use"), "id", name="name", to_id="to_id"),
        edge(met.filter((F.col("use") == "heritage") & special.isNotNull()), special, "id", name="name", to_id="to_id"),
        edge(symbols, "ownership", "parent", to_id="id"),
        edge(symbols, "containment", "parent", to_id="id"),
        edge(dependencies.join(packages.select(F.col("name").alias("dependency"), F.lit(True).alias("known")), "dependency", "left"), "dependency", "package", name="dependency", specifier="type", to_file=F.when(F.col("known"), F.col("dependency"))),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    key = F.concat_ws("\x00", "kind", "from_id", F.coalesce("name", F.lit("")), F.coalesce("specifier", F.lit("")), F.when(F.col("kind").isin("ownership", "containment"), F.col("to_id")))
    return out.withColumn("id", F.concat("kind", F.lit(":"), X.hash16(key)))


def symbol_graph(symbols: DataFrame, imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Relations of symbols: from_id, kind, to_id.

    Every symbol is declared-in its module and, where it has a parent symbol, nested-inside that; a
    parent owns its children; an exported top symbol is exported-by its module; modules import and
    re-export modules of the project. The same relation is given once.
    """
    inner = symbols.filter(F.col("parent") != F.col("module"))
    rows = lambda df, a, kind, b: df.select(F.col(a).alias("from_id"), F.lit(kind).alias("kind"), F.col(b).alias("to_id"))
    out = rows(symbols, "id", "declared-in", "module").unionByName(rows(symbols, "parent", "owns", "id")).unionByName(rows(inner, "id", "nested-inside", "parent"))
    out = out.unionByName(rows(symbols.filter((F.col("parent") == F.col("module")) & F.col("exported")), "id", "exported-by", "module"))
    for df, kind in ((imports, "imports"), (reexports, "re-exports")):
        out = out.unionByName(rows(df.filter("target is not null"), "module", kind, "target"))
    return out.distinct()
