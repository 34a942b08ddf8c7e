"""Plans of a project's pages: sections that have evidence, concepts split or merged, navigation and paths.

All tables have a ``project`` column, so that many projects are planned at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as X

# Sizes, weights, orders of pages.
#: Members from which a group with a common beginning becomes a page with children, and most children of one.
SPLIT, CHILDREN = 6, 12
IMPORTANCE = {"overview": 0.8, "child": 0.55, "merged": 0.75, "single": 0.65}
JOURNEY = ("introduction", "overview", "getting-started", "core-concepts", "concepts", "guides", "common-tasks", "configuration", "api", "api-reference", "commands-reference", "advanced", "migration", "troubleshooting")
PERSONAS = {
    "end-user": ("getting-started", "troubleshooting"), "api-consumer": ("api", "api-reference", "configuration"), "plugin-author": ("core-concepts", "concepts", "api-reference"),
    "operator": ("setup", "configuration", "operations", "troubleshooting"), "maintainer": ("architecture", "development", "publishing"), "contributor": ("architecture", "development", "publishing"),
}
OTHERS = ("getting-started", "guides", "common-tasks", "api")


def plan_sections(candidates: DataFrame, evidence: DataFrame, overrides: DataFrame) -> DataFrame:
    """Sections of each project: project, id, title, position, overridden.

    ``candidates``: project, rank (of the archetype), at, id, title, needs (a kind of evidence, null for
    none). Of equal ids the first counts, by rank and place. A section stays if its evidence
    (``evidence``: project, kind) is there or ``overrides`` (project, id, enabled, title) asks for it,
    and goes if they forbid it.
    """
    first = candidates.groupBy("project", "id").agg(F.min(F.struct("rank", "at", "title", "needs")).alias("c")).select("project", "id", "c.*")
    there = evidence.select("project", F.col("kind").alias("needs")).distinct().withColumn("met", F.lit(True))
    own = overrides.groupBy("project", "id").agg(F.max(F.struct("enabled", "title")).alias("o"))
    met = first.join(there, ["project", "needs"], "left").join(own, ["project", "id"], "left")
    kept = met.filter(F.coalesce("o.enabled", F.coalesce("met", F.lit(False)) | F.col("needs").isNull()))
    place = F.row_number().over(Window.partitionBy("project").orderBy("rank", "at", "id"))
    return kept.select("project", "id", F.coalesce("o.title", "title").alias("title"), place.alias("position"), F.col("o").isNotNull().alias("overridden"))


def concept_pages(concepts: DataFrame) -> DataFrame:
    """Pages of concept groups: project, slug, title, importance, depth, split_from, consolidated_from, symbols.

    ``concepts``: project, group, shared (its members begin alike), at, name, apis (array). A shared group
    of ``SPLIT`` members or more is an overview and a page for each of the first ``CHILDREN`` members;
    any other is one page that names its members.
    """
    order = Window.partitionBy("project", "group").orderBy("at", "name")
    whole = Window.partitionBy("project", "group")
    none = F.array().cast("array<string>")
    c = concepts.select("*", F.row_number().over(order).alias("k"), F.count("*").over(whole).alias("n"))
    c = c.withColumn("split", (F.col("n") >= SPLIT) & F.col("shared"))
    page = lambda df, slug, title, weight, depth, parent, merged, symbols: df.select(
        "project", slug.alias("slug"), title.alias("title"), weight.cast("double").alias("importance"), F.lit(depth).alias("depth"), parent.alias("split_from"), merged.alias("consolidated_from"), symbols.alias("symbols")
    )
    null, nulls, parent = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), X.slugify_page("group")
    child = F.concat(parent, F.lit("/"), X.slugify_page("name"))
    children = page(c.filter(F.col("split") & (F.col("k") <= CHILDREN)), child, X.titleize("name"), F.lit(IMPORTANCE["child"]), "standard", parent, nulls, F.coalesce("apis", none))
    heads = page(c.filter("split and k = 1"), parent, X.titleize("group"), F.lit(IMPORTANCE["overview"]), "summary", null, nulls, none)
    names = F.transform(F.array_sort(F.collect_list(F.struct("k", "name", "apis"))), lambda x: x["name"])
    apis = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("apis", none).alias("apis")))), lambda x: x["apis"])))
    merged = c.filter("not split").groupBy("project", "group", "n").agg(names.alias("names"), apis.alias("all_apis"))
    many = F.col("n") > 1
    ones = page(merged, parent, X.titleize("group"), F.when(many, IMPORTANCE["merged"]).otherwise(IMPORTANCE["single"]), "standard", null, F.when(many, F.col("names")), F.col("all_apis"))
    return heads.unionByName(children).unionByName(ones)


def organize(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page's place in the navigation: project, section, slug, parent, place (array of positions) and breadcrumbs.

    ``sections``: project, id, title, position. ``pages``: project, slug, title, section, at, split_from.
    A page split from another of its section that is itself no child hangs below it; if there is none
    it comes after the section's own pages. Breadcrumbs lead from the root over section and parent, neighbours of one
    name collapsed. Pages of unknown sections are in no navigation.
    """
    p = pages.select("project", "slug", "title", "section", "at", "split_from")
    heads = p.filter("split_from is null").select("project", "section", F.col("slug").alias("split_from"), F.lit(True).alias("hangs"))
    p = p.join(heads, ["project", "section", "split_from"], "left").withColumn("hangs", F.coalesce("hangs", F.lit(False)))
    titles = p.groupBy("project", F.col("slug").alias("split_from")).agg(F.min_by("title", "at").alias("parent_title"))
    p = p.join(titles, ["project", "split_from"], "left").join(sections.select("project", F.col("id").alias("section"), F.col("title").alias("section_title"), "position"), ["project", "section"])
    top = F.row_number().over(Window.partitionBy("project", "section", "hangs").orderBy(F.col("split_from").isNotNull(), "at", "slug"))
    below = F.row_number().over(Window.partitionBy("project", "section", "split_from").orderBy("at", "slug"))
    own = p.select("*", F.when(~F.col("hangs"), top).alias("top"), below.alias("below"))
    up = own.filter("split_from is null").select("project", "section", F.col("slug").alias("split_from"), F.col("top").alias("up"))
    own = own.join(up, ["project", "section", "split_from"], "left")
    place = F.when(F.col("hangs"), F.array("position", "up", "below")).otherwise(F.array("position", "top"))
    trail = F.filter(F.array(F.lit("Documentation"), "section_title", F.when(F.col("split_from").isNotNull(), F.coalesce("parent_title", "split_from")), "title"), lambda x: x.isNotNull())
    once = F.filter(trail, lambda x, k: (k == 0) | (x != F.get(trail, k - 1)))
    return own.select("project", "section", "slug", F.when(F.col("hangs"), F.col("split_from")).alias("parent"), place.alias("place"), once.alias("breadcrumbs"))


def learning_paths(pages: DataFrame, personas: DataFrame) -> DataFrame:
    """Steps of learning paths: project, path, persona, step, slug.

    The primary journey, for the first persona (``personas``: project, persona, priority; developer if
    there is none), follows ``JOURNEY`` through the pages (project, slug) that exist; the next three
    personas have paths of their own, which are left out where they have no step.
    """
    known = pages.select("project", "slug").distinct()
    ranked = personas.select("project", "persona", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("priority"), "persona")).alias("rank"))
    journey = F.array(*[F.lit(s) for s in JOURNEY])
    lists = [(F.col("persona") == n, F.array(*[F.lit(s) for s in steps])) for n, steps in PERSONAS.items()]
    wanted = F.when(*lists[0])
    for rule in lists[1:]:
        wanted = wanted.when(*rule)
    wanted = wanted.otherwise(F.array(*[F.lit(s) for s in OTHERS]))
    first = known.select("project").distinct().join(ranked.filter("rank = 1"), "project", "left")
    paths = first.select("project", F.lit("Primary Journey").alias("path"), F.coalesce("persona", F.lit("developer")).alias("persona"), journey.alias("steps"))
    named = F.concat(F.initcap(F.replace("persona", F.lit("-"), F.lit(" "))), F.lit(" Path"))
    paths = paths.unionByName(ranked.filter("rank between 2 and 4").select("project", named.alias("path"), "persona", wanted.alias("steps")))
    steps = paths.select("project", "path", "persona", F.posexplode("steps").alias("at", "slug")).join(known, ["project", "slug"])
    step = F.row_number().over(Window.partitionBy("project", "path", "persona").orderBy("at"))
    return steps.select("project", "path", "persona", step.alias("step"), "slug")
