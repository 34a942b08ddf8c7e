"""Queries of symbols, bindings and scopes: conversations as files of nested nodes, documents as modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import symbols as S
from tessella.operators.common import written
from tessella.plans.registry import query, table

# a node for each turn: node k = turn + 2 lies inside node k // 2 (2 and 3 stand at the top), in one of the middle quarters of it
_LEVEL = "(length(bin(k)) - 1)"
_LENGTHS = [4**n for n in range(12)]
_START = " + ".join(f"CASE WHEN lv >= {j} THEN (1 + CAST(floor(k / power(2, lv - {j})) AS bigint) % 2) * {_LENGTHS[11 - j]} ELSE 0 END" for j in range(1, 11))
_WIDTH = "CASE lv " + " ".join(f"WHEN {n} THEN {_LENGTHS[11 - n]}" for n in range(1, 11)) + " END"
_KIND = "CASE (conv_id + k) % 7 WHEN 0 THEN 'class' WHEN 1 THEN 'namespace' WHEN 2 THEN 'method' WHEN 3 THEN 'function' WHEN 4 THEN 'property' WHEN 5 THEN 'class' ELSE 'function' END"
_DOC = "concat(CASE WHEN k % 5 = 0 THEN '@deprecated ' ELSE '' END, CASE WHEN k % 3 = 0 THEN '@internal' ELSE '' END)"


def _list(spark_form: bool) -> str:
    parts = ("CASE WHEN (conv_id + k) % 3 = 0 THEN 'export' END", "CASE (conv_id + k) % 4 WHEN 1 THEN 'private' WHEN 2 THEN 'protected' END")
    return f"array_compact(array({', '.join(parts)}))" if spark_form else f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _each(source: str, values: str, spark_form: bool) -> str:
    """Rows of a table, once for each value ``j``."""
    return f"(SELECT *, explode(array({values})) AS j FROM {source})" if spark_form else f"(SELECT *, unnest([{values}]) AS j FROM {source})"


_BASE = f"SELECT *, {_START} AS start, {_WIDTH} AS width FROM (SELECT *, {_LEVEL} AS lv FROM (SELECT conv_id, turn + 2 AS k FROM conversations))"


def _nodes_sql(spark_form: bool) -> str:
    named = f"SELECT conv_id AS file, k AS node, start, start + width - 1 AS \"end\", {_KIND} AS kind, concat('n', CAST((conv_id + floor(k / 2)) % 3 AS int)) AS name, {_list(spark_form)} AS modifiers, {_DOC} AS doc FROM b"
    small = f"SELECT conv_id, k * 100000 + j, start + j, start + j, CASE WHEN j = 3 THEN 'heritage' ELSE 'parameter' END, concat('p', j * 10 + k % 3), NULL, NULL FROM {_each('b', '1, 2, 3', spark_form)} WHERE width > 4"
    text = f"WITH b AS ({_BASE}) {named} UNION ALL {small}"
    return text.replace('"end"', "`end`") if spark_form else text


def _nodes(spark, d):
    return spark.sql(_nodes_sql(True).replace("FROM conversations", "FROM {t}"), t=table(spark, d, "conversations"))


def _symbols(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("file")).distinct()
    listed = c.filter("file % 4 = 0").select("file", F.lit("n1").alias("name"))
    modules = c.select("file", F.lit("pkg").alias("package"), F.concat(F.lit("m"), "file").alias("module"))
    return S.symbol_tree(_nodes(spark, d), listed, modules)


_NESTED = f"""WITH RECURSIVE nodes AS ({_nodes_sql(False)}),
 up AS (SELECT a.file, a.node, max_by(b.node, b.start) AS parent, count(b.node) AS depth FROM nodes a LEFT JOIN nodes b ON a.file=b.file AND b.node<>a.node AND b.start<=a.start AND b."end">=a."end" GROUP BY ALL),
 n AS (SELECT nodes.*, up.parent, up.depth FROM nodes JOIN up ON nodes.file=up.file AND nodes.node=up.node)"""


@query("pr42_nesting", _NESTED + " SELECT file, node, kind, parent, depth, false AS crossing FROM n")
def _nesting(spark, d):
    return S.nest(_nodes(spark, d)).select("file", "node", "kind", "parent", "depth", "crossing")


@query("pr42_symbols", _NESTED + """, s AS (SELECT n.*, [name] AS path, v AS strict FROM (SELECT *, CASE WHEN list_contains(modifiers,'private') THEN 2 WHEN list_contains(modifiers,'protected') THEN 1 ELSE 0 END AS v FROM n) n WHERE parent IS NULL AND kind IN ('class','namespace','function')
  UNION ALL SELECT n.*, list_append(s.path, n.name), greatest(s.strict, n.v) FROM (SELECT *, CASE WHEN list_contains(modifiers,'private') THEN 2 WHEN list_contains(modifiers,'protected') THEN 1 ELSE 0 END AS v FROM n) n JOIN s ON s.file=n.file AND s.node=n.parent AND ((s.kind='class' AND n.kind IN ('method','property')) OR (s.kind='namespace' AND n.kind IN ('class','namespace','function')))),
 c AS (SELECT *, kind IN ('function','method') AS callable FROM s),
 o AS (SELECT *, count(*) OVER w AS twins, row_number() OVER (PARTITION BY file, parent, callable, name ORDER BY start) AS rn FROM c WINDOW w AS (PARTITION BY file, parent, callable, name)),
 p AS (SELECT file, parent AS node, string_agg(name, ', ' ORDER BY start) FILTER (kind='parameter') AS ps, count(*) FILTER (kind='parameter') AS np, string_agg(name, ',' ORDER BY start) FILTER (kind='heritage') AS hs FROM n WHERE kind IN ('parameter','heritage') GROUP BY ALL)
 SELECT o.file, o.node, o.parent, o.kind, o.name, 'pkg.m'||o.file||'.'||o.name AS qualified, array_to_string(o.path,'/') AS path, CASE WHEN callable AND twins>1 THEN rn-1 END AS overload,
  CASE WHEN list_contains(modifiers,'private') THEN 'private' WHEN list_contains(modifiers,'protected') THEN 'protected' ELSE 'public' END AS visibility, (['public','protected','private'])[strict+1] AS effective,
  list_contains(modifiers,'export') OR (o.parent IS NULL AND o.file%4=0 AND o.name='n1') AS exported, o.node%3=0 AS internal, o.node%5=0 AS deprecated,
  CASE WHEN callable THEN coalesce(np,0) END AS n_parameters, CASE WHEN callable THEN '('||coalesce(ps,'')||')' END AS signature, CASE WHEN kind='class' THEN coalesce(hs,'') END AS heritage,
  substr(sha256(o.file||'|pkg.m'||o.file||'.'||o.name||'|'||o.kind||'|'||CASE WHEN callable AND twins>1 THEN rn-1 ELSE 0 END),1,16) AS hash
 FROM o LEFT JOIN p ON p.file=o.file AND p.node=o.node""")
def _symbol_tree(spark, d):
    s = _symbols(spark, d)
    return s.select("file", "node", "parent", "kind", "name", "qualified", F.array_join("path", "/").alias("path"), "overload", "visibility", "effective", "exported", "internal", "deprecated", "n_parameters", "signature", F.array_join("heritage", ",").alias("heritage"), "hash")


_STATEMENT = "CASE turn % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'import' WHEN 3 THEN 'export' ELSE 'export' END"
_OF = "CASE WHEN turn % 5 IN (0, 2, 4) OR turn % 5 = 1 AND conv_id % 2 = 0 THEN concat('./m', turn) END"
_PART = "CASE turn % 5 WHEN 0 THEN CASE j WHEN 2 THEN 'import-default' ELSE 'import-specifier' END WHEN 2 THEN 'import-namespace' WHEN 1 THEN 'export-specifier' WHEN 3 THEN CASE j WHEN 2 THEN 'export-namespace' ELSE 'export-specifier' END ELSE 'comment' END"
def _statements(spark_form: bool) -> str:
    return f"""SELECT conv_id AS file, turn * 10 AS node, turn * 10 AS start, turn * 10 + 9 AS "end", {_STATEMENT} AS kind, NULL AS name, NULL AS property, {_OF} AS specifier FROM conversations
 UNION ALL SELECT conv_id, turn * 10 + j, turn * 10 + j, turn * 10 + j, {_PART}, CASE WHEN (conv_id + j) % 6 = 0 THEN NULL ELSE concat('a', (turn + j) % 3) END, CASE WHEN (conv_id + turn + j) % 4 = 0 THEN concat('b', j) END, NULL FROM {_each('conversations', '1, 2, 4, 5', spark_form)}"""


@query("pr43_bindings", f"""WITH s AS ({_statements(False)}), h AS (SELECT * FROM s WHERE kind IN ('import','export')),
 c AS (SELECT h.file, h.node AS head, h.kind AS st, h.specifier AS of, h.start AS pos, s.start, s.node, s.kind, coalesce(s.name,s.property,'') AS shown, CASE WHEN s.kind LIKE '%-namespace' THEN '*' WHEN s.kind='import-default' THEN 'default' ELSE coalesce(s.property,s.name,'') END AS far FROM h LEFT JOIN s ON s.file=h.file AND s.start>h.start AND s."end"<=h."end" AND s.kind NOT IN ('import','export','comment')),
 f AS (SELECT *, CASE WHEN st='import' THEN CASE WHEN kind IS NOT NULL THEN 'import' END WHEN kind IS NULL THEN CASE WHEN of IS NOT NULL THEN 'star' END WHEN of IS NULL THEN 'alias' ELSE 're-export' END AS form FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY file, head, CASE WHEN form='star' THEN NULL ELSE shown END ORDER BY start) AS rn FROM f WHERE form IS NOT NULL AND (form='star' OR shown<>''))
 SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos, start) AS place, form, of AS specifier, CASE WHEN form<>'star' THEN shown END AS local_name, CASE WHEN form<>'star' THEN far END AS other_name FROM k WHERE rn=1""")
def _bindings(spark, d):
    return S.bindings(spark.sql(_statements(True).replace('"end"', "`end`").replace("FROM conversations", "FROM {t}"), t=table(spark, d, "conversations")))


# modules in groups of ten: chains of renames, a circle of stars, ways that end nowhere
_EXPORTS = [(0, "a", 0), (0, "a", 1), (0, "default", 0), (7, "c", 0), (9, "q", 0)]
_RENAMES = [(1, "b", 0, 0, "a"), (2, "c", 0, 1, "b"), (2, "ns", 1, 0, "*"), (6, "d", 0, 4, "c"), (6, "e", 1, 5, "nothing"), (6, "f", 2, 6, "g"), (6, "g", 3, 6, "f"), (8, "c", 0, 3, "c"), (8, "default", 1, 0, "default"), (9, "c", 0, 8, "zzz"), (9, "c", 1, 2, "c"), (5, "q", 0, 9, "q")]
_STARS = [(3, 0, 2), (4, 0, 5), (4, 1, 3), (5, 0, 4), (5, 1, 7), (7, 0, 6), (8, 0, 7), (9, 0, 4)]
_NAMES = ("a", "b", "c", "d", "e", "f", "ns", "q", "default")


def _modules(rows: list, columns: str) -> str:
    """SQL of rows by place in a group of ten modules, for the modules that exist; ``t`` in a row is a place too."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT CAST(doc_id AS varchar(20)) AS module, doc_id - doc_id % 10 AS base, v.* FROM documents JOIN (VALUES {values}) v(r, {', '.join(names)}) ON doc_id % 10 = v.r"


_TABLES = f"""ex AS (SELECT module, name, concat(module, '#', name, ordinal) AS id, ordinal FROM ({_modules(_EXPORTS, 'name ordinal')})),
 rn AS (SELECT module, name, ordinal, CAST(base + t AS varchar(20)) AS target, target_name FROM ({_modules(_RENAMES, 'name ordinal t target_name')})),
 st AS (SELECT module, ordinal, CAST(base + t AS varchar(20)) AS target FROM ({_modules(_STARS, 'ordinal t')}))"""


def _scope_tables(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return [spark.sql(f"WITH {_TABLES} SELECT * FROM {n}".replace("FROM documents", "FROM {t}").replace("varchar(20)", "string"), t=docs) for n in ("ex", "rn", "st")]


def _wanted(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("module"), F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("name"))


# the first of all paths without repetition, in order of the ways taken
_PATHS = f"""WITH RECURSIVE {_TABLES},
 own AS (SELECT module, name, min_by(id, ordinal) AS id FROM ex GROUP BY ALL),
 w AS (SELECT module, name, 0 AS rank, ordinal, target, target_name FROM rn WHERE name<>'default'),
 p AS (SELECT m AS sm, n AS sn, m AS module, n AS name, [m||'/'||n] AS seen, CAST([] AS int[]) AS turns FROM (SELECT CAST(doc_id AS varchar) AS m, unnest([{', '.join(f"'{n}'" for n in _NAMES)}]) AS n FROM documents)
  UNION ALL SELECT sm, sn, x.target, x.target_name, list_append(seen, x.target||'/'||x.target_name), turns || [x.rank, x.ordinal] FROM p LEFT JOIN own o ON o.module=p.module AND o.name=p.name
   JOIN (SELECT * FROM w UNION ALL SELECT st.module, n, 1, ordinal, target, n FROM st, (SELECT unnest([{', '.join(f"'{n}'" for n in _NAMES if n != 'default')}, 'nothing', 'zzz', 'g']) AS n)) x ON x.module=p.module AND x.name=p.name WHERE o.id IS NULL AND NOT list_contains(seen, x.target||'/'||x.target_name))
 """


@query("jn07_scopes", _PATHS + "SELECT sm AS module, sn AS name, min_by(CASE WHEN p.name='*' THEN p.module ELSE o.id END, turns) AS id FROM p LEFT JOIN own o ON o.module=p.module AND o.name=p.name WHERE p.name='*' OR o.id IS NOT NULL GROUP BY ALL")
def _scopes(spark, d):
    return S.resolve_exports(_wanted(spark, d), *_scope_tables(spark, d))


# symbols, imports and packages of the same modules
_SYMBOLS = [
    (0, "a", 0, "class", "", True), (0, "a", 1, "interface", "", True), (0, "K", 2, "class", "a,nothing", True), (1, "K", 0, "class", "b,c", True), (2, "K", 0, "class", "ns.a,ns.a.deep,x.y", False),
    (3, "K", 0, "interface", "c,K,ns.K", True), (4, "K", 0, "class", "c,imported,all.q", True), (5, "q2", 0, "function", "", True), (7, "c", 0, "interface", "", True), (8, "T", 0, "type-alias", "c", True), (9, "q", 0, "function", "", True),
]
_IMPORT_NAMES = [(4, 0, "imported", "c", "./m3", 3), (4, 1, "all", "*", "./m9", 9), (4, 2, "dflt", "default", "./m0", 0), (4, 3, "lost", "zip", "./m0", 0), (1, 0, "c", "c", "./m2", 2)]
_BARE = [(1, "lodash/fp"), (2, "@corp/tools/x"), (3, "unknown-package"), (4, "react")]
_ALIASES = [(7, "c2", "c"), (9, "out", "q"), (9, "bad", "nope")]
_EDGE_TABLES = f"""sy AS (SELECT module, concat(module, '#', name, ordinal) AS id, module AS parent, kind, name, ordinal, exported, CASE WHEN kind IN ('class','interface') THEN heritage ELSE '' END AS heritage, CASE WHEN kind = 'type-alias' THEN heritage END AS type_name FROM ({_modules(_SYMBOLS, 'name ordinal kind heritage exported')})
  UNION ALL SELECT module, concat(module, '#a0#deep'), concat(module, '#a0'), 'class', 'deep', 0, true, '', NULL FROM ({_modules([(0, 1)], 'one')})),
 im AS (SELECT module, ordinal, local_name, other_name, specifier, CAST(base + t AS varchar(20)) AS target FROM ({_modules(_IMPORT_NAMES, 'ordinal local_name other_name specifier t')})),
 ip AS (SELECT DISTINCT module, specifier, target, concat('f', target) AS target_file FROM im UNION ALL SELECT module, specifier, NULL, NULL FROM ({_modules(_BARE, 'specifier')})),
 al AS (SELECT module, exported_name, local_name FROM ({_modules(_ALIASES, 'exported_name local_name')})),
 re AS (SELECT module, ordinal, concat('./m', t) AS specifier, name, target_name AS other_name, CAST(base + t AS varchar(20)) AS target, concat('f', CAST(base + t AS varchar(20))) AS target_file FROM ({_modules(_RENAMES, 'name ordinal t target_name')})
  UNION ALL SELECT module, ordinal, concat('./m', t), NULL, NULL, CAST(base + t AS varchar(20)), concat('f', CAST(base + t AS varchar(20))) FROM ({_modules(_STARS, 'ordinal t')})),
 pk AS (SELECT * FROM (VALUES ('lodash', 'lodash.js', false), ('@corp/tools', 'tools.js', true), ('app', 'app.js', true)) p(name, main, workspace)),
 dp AS (SELECT * FROM (VALUES ('app', 'lodash', 'runtime'), ('app', 'vitest', 'dev')) p(package, dependency, type)),
 df AS (SELECT module, concat(module, '#a0') AS id, 0 AS ordinal FROM ({_modules([(0, 1)], 'one')})),
 xp AS (SELECT DISTINCT module, name FROM sy WHERE exported AND parent = module)"""


def _edge_tables(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    # written once: every step reads them again
    get = lambda n: written(spark.sql(f"WITH {_EDGE_TABLES} SELECT * FROM {n}".replace("FROM documents", "FROM {t}").replace("varchar(20)", "string"), t=docs))
    s = get("sy").withColumn("heritage", F.when(F.col("heritage") == "", F.array().cast("array<string>")).otherwise(F.split("heritage", ",")))
    return {"symbols": s, "imports": get("ip"), "import_names": get("im"), "exported": get("xp"), "aliases": get("al"), "reexports": get("re"), "packages": get("pk"), "dependencies": get("dp"), "defaults": get("df")}


# modes of a name: s in scope, x as exported, e as exported but not over stars; the first path wins
_EDGES = f"""WITH RECURSIVE {_EDGE_TABLES},
 own AS (SELECT module, name, id, ordinal FROM sy WHERE parent=module AND exported UNION ALL SELECT al.module, exported_name, id, ordinal+1000000 FROM al JOIN sy ON sy.module=al.module AND sy.name=al.local_name AND sy.parent=sy.module UNION ALL SELECT module, 'default', id, ordinal FROM df),
 fin AS (SELECT 's' AS mode, module, name, min_by(id, ordinal) AS id FROM sy WHERE parent=module GROUP BY ALL UNION ALL SELECT m, module, name, min_by(id, ordinal) FROM own, (VALUES ('x'),('e')) v(m) GROUP BY ALL),
 u AS (SELECT module, id, name, 'heritage' AS kind FROM (SELECT module, id, unnest(string_split(heritage, ',')) AS name FROM sy WHERE parent=module AND heritage<>'') UNION ALL SELECT module, id, type_name, 'type-use' FROM sy WHERE type_name IS NOT NULL),
 ask AS (SELECT 's' AS mode, module, split_part(name,'.',1) AS name FROM u UNION SELECT 'x', target, other_name FROM im WHERE other_name<>'*' UNION SELECT 'x', module, name FROM xp UNION SELECT 'x', module, local_name FROM al UNION SELECT 'x', target, other_name FROM re WHERE name IS NOT NULL AND other_name<>'*'),
 p AS (SELECT mode AS am, module AS amod, name AS an, mode, module, name, [mode||module||'/'||name] AS seen, CAST([] AS int[]) AS turns FROM ask
  UNION ALL SELECT am, amod, an, w.m2, w.target, w.target_name, list_append(seen, w.m2||w.target||'/'||w.target_name), turns||[w.rank, w.ordinal] FROM p LEFT JOIN fin ON fin.mode=p.mode AND fin.module=p.module AND fin.name=p.name
   JOIN LATERAL (SELECT 0 AS rank, ordinal, 'x' AS m2, target, other_name AS target_name FROM im WHERE p.mode='s' AND im.module=p.module AND im.local_name=p.name
     UNION ALL SELECT 1, 0, 'e', p.module, p.name WHERE p.mode='s' UNION ALL SELECT 2, ordinal, 's', target, p.name FROM re WHERE p.mode='s' AND re.module=p.module AND re.name IS NULL
     UNION ALL SELECT 0, ordinal, 'x', target, other_name FROM re WHERE p.mode IN ('e','x') AND p.name<>'default' AND re.module=p.module AND re.name=p.name
     UNION ALL SELECT 1, ordinal, 'x', target, p.name FROM re WHERE p.mode='x' AND p.name<>'default' AND re.module=p.module AND re.name IS NULL) w ON true
   WHERE fin.id IS NULL AND p.name<>'*' AND NOT list_contains(seen, w.m2||w.target||'/'||w.target_name)),
 got AS (SELECT am AS mode, amod AS module, an AS name, min_by(CASE WHEN p.name='*' THEN p.module ELSE fin.id END, turns) AS id FROM p LEFT JOIN fin ON fin.mode=p.mode AND fin.module=p.module AND fin.name=p.name WHERE p.name='*' OR fin.id IS NOT NULL GROUP BY ALL),
 dot AS (SELECT u.*, g.id AS cur, 2 AS k FROM u LEFT JOIN got g ON g.mode='s' AND g.module=u.module AND g.name=split_part(u.name,'.',1)
  UNION ALL SELECT dot.module, dot.id, dot.name, dot.kind, (SELECT min_by(c.id, c.ordinal) FROM sy c WHERE c.parent=dot.cur AND c.name=split_part(dot.name,'.',dot.k)), dot.k+1 FROM dot WHERE split_part(dot.name,'.',dot.k)<>''),
 h AS (SELECT module, id, name, kind, max_by(struct_pack(c:=cur), k).c AS to_id FROM dot GROUP BY ALL),
 e AS (SELECT DISTINCT 'import' AS kind, module AS from_id, NULL AS name, specifier, target AS to_id, target_file AS to_file FROM ip
  UNION ALL SELECT 'import-name', im.module, local_name, specifier, CASE WHEN other_name='*' THEN target ELSE g.id END, NULL FROM im LEFT JOIN got g ON g.mode='x' AND g.module=target AND g.name=other_name
  UNION ALL SELECT CASE WHEN specifier LIKE '@corp/%' THEN 'workspace' ELSE 'package' END, module, NULL, specifier, NULL, CASE WHEN specifier LIKE 'lodash%' THEN 'lodash.js' END FROM ip WHERE specifier NOT LIKE './%'
  UNION ALL SELECT 'export', xp.module, xp.name, NULL, g.id, NULL FROM xp LEFT JOIN got g ON g.mode='x' AND g.module=xp.module AND g.name=xp.name
  UNION ALL SELECT 'alias', al.module, exported_name, NULL, g.id, NULL FROM al LEFT JOIN got g ON g.mode='x' AND g.module=al.module AND g.name=local_name
  UNION ALL SELECT 're-export', re.module, re.name, specifier, CASE WHEN re.name IS NULL OR other_name='*' THEN target ELSE g.id END, CASE WHEN re.name IS NULL THEN target_file END FROM re LEFT JOIN got g ON g.mode='x' AND g.module=target AND g.name=other_name
  UNION ALL SELECT kind, id, name, NULL, to_id, NULL FROM h
  UNION ALL SELECT CASE s.kind WHEN 'class' THEN 'extends' ELSE 'implements' END, h.id, h.name, NULL, to_id, NULL FROM h JOIN sy s ON s.id=h.to_id WHERE h.kind='heritage' AND s.kind IN ('class','interface')
  UNION ALL SELECT k, parent, NULL, NULL, id, NULL FROM sy, (VALUES ('ownership'),('containment')) v(k)
  UNION ALL SELECT 'dependency', package, dependency, type, NULL, CASE WHEN dependency='lodash' THEN 'lodash' END FROM dp)"""


@query("gr01_reference_edges", _EDGES + " SELECT * FROM e")
def _reference_edges(spark, d):
    return S.reference_edges(**_edge_tables(spark, d)).drop("id")


@query("gr21_symbol_graph", f"""WITH {_EDGE_TABLES} SELECT DISTINCT * FROM (SELECT id AS from_id, 'declared-in' AS kind, module AS to_id FROM sy UNION ALL SELECT parent, 'owns', id FROM sy UNION ALL SELECT id, 'nested-inside', parent FROM sy WHERE parent<>module UNION ALL SELECT id, 'exported-by', module FROM sy WHERE parent=module AND exported
 UNION ALL SELECT module, 'imports', target FROM ip WHERE target IS NOT NULL UNION ALL SELECT module, 're-exports', target FROM re)""")
def _symbol_graph(spark, d):
    t = _edge_tables(spark, d)
    return S.symbol_graph(t["symbols"], t["imports"], t["reexports"])
