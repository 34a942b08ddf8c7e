"""Queries of knowledge graphs and derived relations: documents as modules and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import knowledge as K
from tessella.operators import tours
from tessella.plans.registry import query, table

_SYMBOLS = """SELECT concat('m', doc_id) AS id, CASE WHEN doc_id % 20 = 0 THEN 'package' ELSE 'module' END AS kind, concat('mod', doc_id % 7) AS name, CASE WHEN doc_id % 20 > 0 THEN concat(source, '/', doc_id) END AS file,
  concat(lang, '.', doc_id) AS qualified, CASE WHEN doc_id % 20 > 0 THEN concat('m', doc_id - doc_id % 20) END AS parent FROM documents
 UNION ALL SELECT concat('s', doc_id), 'class', 'C', concat(source, '/', doc_id), NULL, concat('m', doc_id) FROM documents WHERE doc_id % 20 > 0 AND doc_id % 3 = 0"""
_REFERENCES = """SELECT CASE doc_id % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'heritage' WHEN 2 THEN 'export' WHEN 3 THEN 'alias' ELSE 'type-use' END AS kind, concat('m', doc_id) AS from_id,
  CASE WHEN doc_id % 11 > 0 THEN concat('s', doc_id - doc_id % 20 + (doc_id * 3) % 20) END AS to_id, CASE WHEN doc_id % 2 = 0 THEN 'n' END AS name, 'x' AS specifier FROM documents
 UNION ALL SELECT 'heritage', concat('m', doc_id), concat('s', doc_id - doc_id % 20 + (doc_id * 3) % 20), CASE WHEN doc_id % 2 = 0 THEN 'n' END, 'x' FROM documents WHERE doc_id % 4 = 0"""


def _tables(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    get = lambda q: spark.sql(q.replace("FROM documents", "FROM {t}"), t=docs)
    return {"symbols": get(_SYMBOLS), "references": get(_REFERENCES)}


def _users(inputs, needed):
    """Modules that refer to a class are users of the module around it; a node for each language of a module."""
    owns = needed["structural"].edges.filter("kind = 'owns'").select(F.col("src").alias("owner"), F.col("dst").alias("at"))
    refs = needed["references"].edges.select("src", F.col("dst").alias("at"), "kind")
    uses = refs.join(owns, "at").select("src", F.col("owner").alias("dst"), F.lit("references").alias("kind"), F.lit(None).cast("string").alias("label"))
    again = needed["references"].edges.filter("kind = 'references'")
    names = inputs["symbols"].filter("kind = 'module'").select("id", F.lit("module").alias("kind"), F.lit("other").alias("label"), "file", F.lit(None).cast("string").alias("detail"))
    return K.Graph(names, uses.unionByName(again))


_KNOWLEDGE = f"""WITH sy AS ({_SYMBOLS}), rf AS ({_REFERENCES}),
 nd AS (SELECT id, CASE WHEN kind IN ('package','module') THEN kind ELSE 'symbol' END AS kind, name AS label, file, qualified AS detail, CASE WHEN kind='module' THEN 'structural,users' ELSE 'structural' END AS sources FROM sy),
 st AS (SELECT parent AS src, id AS dst, 'owns' AS kind, '' AS label FROM sy WHERE parent IS NOT NULL UNION SELECT sy.id, m.id, 'declared-in', '' FROM sy JOIN sy m ON m.file=sy.file AND m.kind='module' WHERE sy.id<>m.id),
 re AS (SELECT DISTINCT from_id AS src, to_id AS dst, CASE kind WHEN 'import' THEN 'imports' WHEN 'export' THEN 'exports' ELSE 'references' END AS kind, coalesce(name, specifier, '') AS label FROM rf WHERE to_id IS NOT NULL AND kind<>'alias'),
 us AS (SELECT re.src, st.src AS dst, 'references' AS kind, '' AS label FROM re JOIN st ON st.dst=re.dst AND st.kind='owns' UNION SELECT * FROM re WHERE kind='references'),
 al AS (SELECT *, 0 AS k, 'structural' AS s FROM st UNION ALL SELECT *, 1, 'references' FROM re UNION ALL SELECT *, 2, 'users' FROM us),
 ed AS (SELECT src, dst, kind, label, string_agg(s, ',' ORDER BY k) AS sources FROM al WHERE src IN (SELECT id FROM nd) AND dst IN (SELECT id FROM nd) GROUP BY ALL)"""


def _graph(spark, d):
    return K.build_graph([K.STRUCTURAL, K.REFERENCES, K.Contributor("users", _users, ("references", "structural"))], _tables(spark, d))


@query("gr22_knowledge_nodes", _KNOWLEDGE + " SELECT * FROM nd")
def _knowledge_nodes(spark, d):
    return _graph(spark, d).nodes.withColumn("sources", F.array_join("sources", ","))


@query("gr22_knowledge_edges", _KNOWLEDGE + " SELECT kind||':'||substr(sha256(src||chr(0)||dst||chr(0)||label),1,16) AS id, * FROM ed")
def _knowledge_edges(spark, d):
    return _graph(spark, d).edges.withColumn("sources", F.array_join("sources", ","))


_LINKS = "SELECT doc_id AS src, doc_id - doc_id % 50 + (doc_id * 3) % 50 AS dst, CASE doc_id % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'prerequisite' WHEN 2 THEN 'relatedTo' ELSE 'explains' END AS kind, 'link' AS label, 0.5 + doc_id % 5 * 0.1 AS weight, 0.9 AS confidence FROM documents"
_NEXT = "SELECT doc_id AS src, doc_id + 1 AS dst, CASE WHEN doc_id % 3 = 0 THEN 'nextStep' ELSE 'prerequisite' END AS kind, concat('n', doc_id % 2) AS label, 0.8 AS weight, 0.7 AS confidence FROM documents WHERE doc_id % 6 < 4"
_AGAIN = "SELECT doc_id - doc_id % 50 + (doc_id * 3) % 50 AS src, doc_id AS dst, 'usedBy' AS kind, 'back' AS label, 0.3 AS weight, 0.4 AS confidence FROM documents WHERE doc_id % 8 < 5 UNION ALL SELECT doc_id, doc_id + 1, 'prerequisite', 'twice', 0.1, 0.1 FROM documents WHERE doc_id % 5 = 1"
_FIXED = ("links", _LINKS), ("reading", _NEXT), ("again", _AGAIN)

_DERIVED = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _FIXED) + """, al AS (SELECT *, 0 AS k, 'links' AS s FROM links UNION ALL SELECT *, 1, 'reading' FROM reading UNION ALL SELECT *, 2, 'again' FROM again),
 mg AS (SELECT src, dst, kind, min(struct_pack(k, label, weight, confidence)) AS f, array_to_string(list_sort(list(DISTINCT k||s)), ',') AS sources FROM al WHERE src<>dst AND src IN (SELECT doc_id FROM documents) AND dst IN (SELECT doc_id FROM documents) GROUP BY ALL),
 fd AS (SELECT src, dst, kind, f.label AS label, f.weight AS weight, f.confidence AS confidence, regexp_replace(sources, '[0-9]', '', 'g') AS sources FROM mg),
 tn AS (SELECT dst AS src, src AS dst, CASE kind WHEN 'uses' THEN 'usedBy' WHEN 'usedBy' THEN 'uses' WHEN 'prerequisite' THEN 'nextStep' WHEN 'nextStep' THEN 'previousStep' WHEN 'explains' THEN 'deepens' END AS kind, weight*0.9 AS weight, confidence, label FROM fd),
 mr AS (SELECT src, dst, kind, max(struct_pack(weight, confidence, label)) AS m FROM tn WHERE kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.src=tn.src AND fd.dst=tn.dst AND fd.kind=tn.kind) GROUP BY ALL),
 dr AS (SELECT * FROM fd UNION ALL SELECT src, dst, kind, m.label, m.weight, m.confidence, 'mirror' FROM mr)"""


def _relations(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("slug"))
    shape = lambda q: lambda p: spark.sql(f"SELECT src, dst, kind, label, CAST(weight AS double) AS weight, CAST(confidence AS double) AS confidence FROM ({q.replace('FROM documents', 'FROM {t}')})", t=p.withColumnRenamed("slug", "doc_id"))
    return pages, K.derive_relations(pages, [K.Resolver(n, shape(q)) for n, q in _FIXED])


@query("gr25_relations", _DERIVED + " SELECT src, dst, kind, label, weight::double AS weight, confidence::double AS confidence, sources FROM dr")
def _derive(spark, d):
    return _relations(spark, d)[1].withColumn("sources", F.array_join("sources", ","))


@query("gr25_dg12_actions", _DERIVED + """, dg AS (SELECT doc_id AS slug, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM dr) e WHERE e.dst=doc_id) AS i, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM dr) e WHERE e.src=doc_id) AS o FROM documents)
 SELECT slug, CASE WHEN i+o=0 THEN 'link-page' WHEN i=0 OR o=0 THEN 'add-next-step' ELSE 'add-related' END AS action, CASE WHEN i+o=0 THEN 'orphan' WHEN i=0 OR o=0 THEN 'dead-end' ELSE 'underconnected' END AS reason FROM dg WHERE i=0 OR o=0 OR i+o<2""")
def _actions(spark, d):
    pages, found = _relations(spark, d)
    gaps = K.actions_of(pages, found.select("src", "dst").distinct())
    return gaps


# trees of a hundred documents: thirds on top, then a chain, then nodes that hang nowhere
_TREE = """SELECT doc_id AS node, CASE WHEN doc_id % 100 = 0 THEN NULL WHEN doc_id % 100 < 50 THEN doc_id - doc_id % 100 + CAST(floor(doc_id % 100 / 3) AS bigint) WHEN doc_id % 100 < 95 THEN doc_id - 1 WHEN doc_id % 100 = 95 THEN doc_id + 2 ELSE doc_id - 1 END AS parent,
 (doc_id * 7) % 100 AS at FROM documents"""
_WALK = f"""WITH RECURSIVE tr AS ({_TREE.replace(' AS at', ' AS o')}), w AS (SELECT node, node AS root, parent, 0 AS depth, [o*1000+node%100] AS path FROM tr WHERE parent IS NULL UNION ALL SELECT tr.node, w.root, tr.parent, depth+1, list_append(path, tr.o*1000+tr.node%100) FROM w JOIN tr ON tr.parent=w.node),
 r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path)-1 AS pre, row_number() OVER (PARTITION BY root ORDER BY list_append(path, 1000000))-1 AS post FROM w),
 s AS (SELECT r.*, (SELECT count(*) FROM r x WHERE x.root=r.root AND len(x.path)>len(r.path) AND x.path[:len(r.path)]=r.path) AS size FROM r)"""


@query("gr11_gr13_walk", _WALK + " SELECT node, root, parent, pre, post, depth, size FROM s")
def _walk(spark, d):
    t = spark.sql(_TREE.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents").select("doc_id"))
    return tours.tour(t)
