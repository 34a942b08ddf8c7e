"""Queries of structure over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import structure
from tessella.plans.registry import query, table


@query("gr15_typed_cycles", """WITH RECURSIVE x AS (SELECT kind, p_partkey AS src, p_partkey//10*10+(p_partkey*k+p_size)%10 AS dst, p_size%4>0 AS resolved FROM part, (VALUES (3,'imports'),(7,'inheritance'),(3,'aliases'),(7,'aliases')) v(k,kind)),
 e AS (SELECT kind, src, dst, bool_or(resolved) AS resolved FROM x WHERE src<>dst GROUP BY ALL),
 p AS (SELECT kind, src AS s, dst AS t, [src,dst] AS path, resolved FROM e WHERE src<dst UNION ALL SELECT p.kind, p.s, e.dst, list_append(p.path,e.dst), p.resolved AND e.resolved FROM p JOIN e ON e.kind=p.kind AND e.src=p.t WHERE e.dst>p.s AND NOT list_contains(p.path,e.dst))
 SELECT p.kind, array_to_string(path,'>') AS cycle, p.resolved AND e.resolved AS resolved FROM p JOIN e ON e.kind=p.kind AND e.src=p.t AND e.dst=p.s""")
def _typed_cycles(spark, d):
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("kind")) for k, n in ((3, "imports"), (7, "inheritance"), (3, "aliases"), (7, "aliases"))]))
    p = table(spark, d, "part").select("p_partkey", "p_size", kinds.alias("v"))
    dst = F.floor(F.col("p_partkey") / 10) * 10 + (F.col("p_partkey") * F.col("v.k") + F.col("p_size")) % 10
    e = p.select(F.col("p_partkey").cast("long").alias("src"), dst.cast("long").alias("dst"), "v.kind", (F.col("p_size") % 4 > 0).alias("resolved"))
    return structure.typed_cycles(e).select("kind", F.array_join(F.col("nodes").cast("array<string>"), ">").alias("cycle"), "resolved")


@query("gr20_ownership_tree", """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey%50=0 THEN NULL ELSE p_partkey//4 END AS parent FROM part), h AS (SELECT * FROM s WHERE parent IN (SELECT id FROM s))
 SELECT s.id, s.parent, (SELECT count(*) FROM h b WHERE b.parent=h.parent AND b.id<=h.id) * CASE WHEN h.id IS NULL THEN NULL ELSE 1 END AS position, (SELECT count(*) FROM h c WHERE c.parent=s.id) AS n_children, s.parent IS NULL AS root FROM s LEFT JOIN h ON h.id=s.id""")
def _ownership_tree(spark, d):
    return structure.ownership_tree(table(spark, d, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey div 4 END AS parent"))


_BEFORE = "SELECT o_orderkey AS slug, o_orderstatus AS fingerprint FROM orders WHERE o_orderkey%5>0"
_AFTER = "SELECT o_orderkey AS slug, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderstatus END AS fingerprint FROM orders WHERE o_orderkey%7>0"
_CHANGES = f"""SELECT coalesce(a.slug,b.slug) AS slug, CASE WHEN a.slug IS NULL THEN 'added' WHEN b.slug IS NULL THEN 'removed' ELSE 'updated' END AS change FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b ON a.slug=b.slug WHERE a.slug IS NULL OR b.slug IS NULL OR a.fingerprint IS DISTINCT FROM b.fingerprint"""


def _changes(spark, d):
    o = table(spark, d, "orders")
    before = o.filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("slug"), F.col("o_orderstatus").alias("fingerprint"))
    after = o.filter("o_orderkey % 7 > 0").selectExpr("o_orderkey AS slug", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS fingerprint")
    return structure.diff_architecture(before, after)


@query("df10_architecture_changes", _CHANGES)
def _architecture_changes(spark, d):
    return _changes(spark, d)


@query("df10_xp06_architecture_summary", f"""SELECT count(*) FILTER (change='added') AS n_added, count(*) FILTER (change='removed') AS n_removed, count(*) FILTER (change='updated') AS n_updated, true AS navigation_changed, false AS archetypes_changed, false AS is_empty FROM ({_CHANGES})""")
def _architecture_summary(spark, d):
    return structure.summarize_architecture(_changes(spark, d), F.lit(True), F.lit(False))


@query("dg15_generated_links", """WITH l AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'page' WHEN 2 THEN 'api' WHEN 3 THEN 'concept' WHEN 4 THEN 'external' WHEN 5 THEN 'anchor' ELSE 'image' END AS kind, l_partkey AS target FROM lineitem),
 m AS (SELECT DISTINCT CASE p_size%3 WHEN 0 THEN 'page' WHEN 1 THEN 'api' ELSE 'concept' END AS kind, p_partkey AS target FROM part)
 SELECT *, CASE WHEN NOT valid THEN CASE kind WHEN 'image' THEN 'unknown-kind' ELSE 'missing-'||kind END END AS finding FROM (SELECT l.*, l.kind IN ('external','anchor') OR m.target IS NOT NULL AS valid FROM l LEFT JOIN m ON l.kind=m.kind AND l.target=m.target) l""")
def _generated_links(spark, d):
    kind = F.expr("CASE l_linenumber WHEN 1 THEN 'page' WHEN 2 THEN 'api' WHEN 3 THEN 'concept' WHEN 4 THEN 'external' WHEN 5 THEN 'anchor' ELSE 'image' END")
    links = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), F.col("l_partkey").alias("target"))
    model = table(spark, d, "part").select(F.expr("element_at(array('page','api','concept'), int(p_size % 3) + 1)").alias("kind"), F.col("p_partkey").alias("name"))
    return structure.validate_generated_links(links, model)


@query("st03_category_positions", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size NULLS LAST, p_partkey) AS position FROM part""")
def _category_positions(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("category"), F.col("p_size").alias("order"), F.col("p_partkey").alias("ordinal"))
    return structure.category_positions(p).select("p_partkey", "position")


@query("st06_by_importance", """SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey""")
def _by_importance(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_acctbal").alias("importance"), F.col("c_custkey").alias("ordinal"))
    return structure.by_importance(c).select("c_custkey", "c_acctbal")
