"""Queries of matching: API names from the first words of conversations, pages from their later turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import claims as C
from tessella.operators import matching as M
from tessella.plans.registry import query, table

# a name: the first three words of a conversation's first turn, letters only
_WORDS = "regexp_replace(regexp_replace(lower(substr(text, 1, 80)), '[^a-z ]', ''{g}), ' +', '-'{g})"


def _words(spark_form: bool) -> str:
    letters = _WORDS.format(g="" if spark_form else ", 'g'")
    return f"concat_ws('-', nullif(split_part({letters}, '-', 1), ''), nullif(split_part({letters}, '-', 2), ''), nullif(split_part({letters}, '-', 3), ''))"


_BEFORE = "SELECT {w} AS name, conv_id AS at, CAST(conv_id % 7 AS varchar(9)) AS signature, conv_id % 6 = 0 AS deprecated, CAST(NULL AS varchar(9)) AS in_favor_of FROM conversations WHERE turn = 0 AND conv_id % 8 <> 0"
_AFTER = """SELECT CASE WHEN conv_id % 8 = 1 THEN concat({w}, CASE conv_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN '-new' ELSE '' END) WHEN conv_id % 8 = 2 THEN concat('Q', {w}) ELSE {w} END AS name, conv_id AS at,
 CAST(conv_id % 7 + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS varchar(9)) AS signature, conv_id % 3 = 0 AS deprecated, CASE WHEN conv_id % 2 = 0 THEN concat('n', conv_id) END AS in_favor_of FROM conversations WHERE turn = 0 AND conv_id % 8 <> 3"""


def _sql(text: str, spark_form: bool) -> str:
    out = text.format(w=_words(spark_form))
    return out.replace("FROM conversations", "FROM {t}").replace("varchar(9)", "string") if spark_form else out


def _states(spark, d):
    t = table(spark, d, "conversations")
    return [spark.sql(_sql(s, True), t=t) for s in (_BEFORE, _AFTER)]


# one old name after the other takes the best new one left
_GREEDY = f"""WITH RECURSIVE bf AS ({_sql(_BEFORE, False)}), af AS ({_sql(_AFTER, False)}),
 b AS (SELECT name, min("at") AS at0 FROM bf GROUP BY 1), a AS (SELECT name, min("at") AS at0 FROM af GROUP BY 1),
 g AS (SELECT *, row_number() OVER (ORDER BY at0) AS i FROM b WHERE name NOT IN (SELECT name FROM a)), f AS (SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)),
 s AS (SELECT g.i, g.name AS old, f.name AS new, f.at0, greatest(len(list_intersect(list_distinct(string_split(lower(g.name),'-')), list_distinct(string_split(lower(f.name),'-'))))/greatest(len(list_distinct(string_split(lower(g.name),'-'))), len(list_distinct(string_split(lower(f.name),'-'))), 1), 0.9*(1-levenshtein(lower(g.name),lower(f.name))/greatest(length(g.name),length(f.name),1))) AS score FROM g, f),
 o AS (SELECT * FROM s WHERE score>=0.6-1e-12),
 t AS (SELECT CAST(0 AS bigint) AS i, CAST([] AS varchar[]) AS taken, CAST(NULL AS varchar) AS old, CAST(NULL AS varchar) AS new
  UNION ALL SELECT t.i+1, CASE WHEN c.new IS NULL THEN t.taken ELSE list_append(t.taken, c.new) END, g.name, c.new FROM t JOIN g ON g.i=t.i+1 LEFT JOIN LATERAL (SELECT o.new FROM o WHERE o.i=t.i+1 AND NOT list_contains(t.taken, o.new) ORDER BY score DESC, at0 LIMIT 1) c ON true),
 r AS (SELECT old, new FROM t WHERE new IS NOT NULL),
 chg AS (SELECT 'renamed' AS change, old, new FROM r UNION ALL SELECT 'added', NULL, name FROM f WHERE name NOT IN (SELECT new FROM r) UNION ALL SELECT 'removed', name, NULL FROM g WHERE name NOT IN (SELECT old FROM r))"""


@query("jn15_renames", _GREEDY + " SELECT * FROM chg")
def _renames(spark, d):
    return M.detect_renames(*_states(spark, d))


_PROJECT = _GREEDY + """, fb AS (SELECT name, min_by(struct_pack(signature, deprecated, in_favor_of), "at") AS v FROM bf GROUP BY 1), fa AS (SELECT name, min_by(struct_pack(signature, deprecated, in_favor_of), "at") AS v FROM af GROUP BY 1),
 dp AS (SELECT change AS kind, coalesce(new, old) AS symbol, CASE WHEN change='renamed' THEN old END AS old_name, CASE WHEN change='renamed' THEN new END AS new_name FROM chg
  UNION ALL SELECT 'signature-changed', fb.name, NULL, NULL FROM fb JOIN fa USING (name) WHERE fb.v.signature IS DISTINCT FROM fa.v.signature
  UNION ALL SELECT 'deprecated', fb.name, fb.name, fa.v.in_favor_of FROM fb JOIN fa USING (name) WHERE NOT fb.v.deprecated AND fa.v.deprecated
  UNION ALL SELECT 'dependency-changed', NULL, NULL, NULL)"""


def _project(spark, d):
    before, after = _states(spark, d)
    t = table(spark, d, "conversations").filter("turn < 3")
    roles = t.select(F.col("role").alias("name"))
    # the same keys in both states, one dependency once more
    return M.diff_project(before, after, (roles, roles.distinct()), (roles, roles.unionByName(spark.createDataFrame([("user",)], "name string"))))


@query("df09_project_changes", _PROJECT + " SELECT * FROM dp")
def _project_changes(spark, d):
    return _project(spark, d)


_PAGES = """SELECT conv_id AS slug, list(DISTINCT {w}) AS symbols, [CASE conv_id % 5 WHEN 0 THEN 'configuration' WHEN 1 THEN 'guide' WHEN 2 THEN 'architecture' WHEN 3 THEN 'overview' ELSE 'api' END] AS kinds FROM conversations WHERE conv_id % 3 > 0 OR turn > 1 GROUP BY conv_id"""


@query("sr10_impact", _PROJECT + f""", pg AS ({_sql(_PAGES, False)}), ps AS (SELECT slug, unnest(symbols) AS symbol FROM pg),
 fl AS (SELECT DISTINCT 'src/'||replace(name,'-','/') AS file FROM bf WHERE "at"%4=0),
 cs AS (SELECT kind, symbol AS s, old_name, new_name FROM dp WHERE kind NOT IN ('renamed','configuration-changed','dependency-changed')),
 x AS (SELECT CASE kind WHEN 'deprecated' THEN 'deprecate' ELSE 'regenerate' END AS effect, slug AS subject, kind, s FROM cs LEFT JOIN ps ON ps.symbol=s),
 e AS (SELECT effect, CAST(subject AS varchar) AS subject, NULL AS target FROM x WHERE subject IS NOT NULL
  UNION SELECT 'create', CASE kind WHEN 'added' THEN 'api:'||s ELSE 'migration' END, NULL FROM x WHERE subject IS NULL AND kind IN ('added','deprecated') AND s<>''
  UNION SELECT 'create', 'api:', NULL FROM x WHERE subject IS NULL AND kind='added' AND s=''
  UNION SELECT 'relink', CAST(slug AS varchar), NULL FROM dp JOIN ps ON ps.symbol=old_name WHERE kind='renamed' UNION SELECT 'regenerate', CAST(slug AS varchar), NULL FROM dp JOIN ps ON ps.symbol=new_name WHERE kind='renamed'
  UNION SELECT 'rename', old_name, new_name FROM dp WHERE kind IN ('renamed','deprecated') AND old_name IS NOT NULL AND new_name IS NOT NULL
  UNION SELECT 'regenerate', CAST(slug AS varchar), NULL FROM pg WHERE list_has_any(kinds, ['guide','overview','architecture']) UNION SELECT 'navigation', NULL, NULL
  UNION SELECT 'regenerate', CAST(slug AS varchar), NULL FROM ps WHERE EXISTS (SELECT 1 FROM fl WHERE contains(file, lower(symbol))))
 SELECT * FROM e""")
def _impact(spark, d):
    t = table(spark, d, "conversations")
    changed = _project(spark, d).select("kind", F.when(F.col("symbol").isNotNull(), F.array("symbol")).alias("symbols"), F.lit(None).cast("array<string>").alias("files"), "old_name", "new_name")
    before = _states(spark, d)[0].filter("at % 4 = 0")
    files = before.select(F.lit("modified").alias("kind"), F.lit(None).cast("array<string>").alias("symbols"), F.array(F.concat(F.lit("src/"), F.replace("name", F.lit("-"), F.lit("/")))).alias("files"), F.lit(None).cast("string").alias("old_name"), F.lit(None).cast("string").alias("new_name"))
    layout = spark.createDataFrame([("architecture-changed", None, None, None, None)], "kind string, symbols array<string>, files array<string>, old_name string, new_name string")
    pages = t.filter("conv_id % 3 > 0 or turn > 1").groupBy(F.col("conv_id").alias("slug")).agg(F.collect_set(F.expr(_words(True))).alias("symbols"))
    kind = F.expr("CASE slug % 5 WHEN 0 THEN 'configuration' WHEN 1 THEN 'guide' WHEN 2 THEN 'architecture' WHEN 3 THEN 'overview' ELSE 'api' END")
    return M.classify_impact(changed.unionByName(files).unionByName(layout), pages.select(F.col("slug").cast("string").alias("slug"), "symbols", F.array(kind).alias("kinds")))


def _part(k: int, spark_form: bool) -> str:
    return f"split_part({_WORDS.format(g='' if spark_form else ', ' + chr(39) + 'g' + chr(39))}, '-', {k})"


_CLAIMS = """SELECT conv_id * 1000 + turn AS id, concat(CASE WHEN turn % 3 < 2 THEN concat('Call ', {a}, '() of the ', {b}, ' class') ELSE '' END, CASE WHEN turn % 2 = 0 THEN concat(' in `', {c}, '.ts`') ELSE '' END, CASE WHEN turn % 5 = 2 THEN concat(' by the `', role, '` option') ELSE '' END) AS text,
  conv_id % 7 < 3 AS puts, {b} AS put FROM conversations"""
_KNOWN = "SELECT concat({a}, {b}) AS name FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT {a} FROM conversations WHERE conv_id % 5 = 0 UNION ALL SELECT {b} FROM conversations WHERE turn = 1"
_PATHS = "SELECT concat('src/', {c}, '.ts') AS name FROM conversations WHERE conv_id % 4 = 0"


def _fill(text: str, spark_form: bool) -> str:
    out = text.format(a=_part(1, spark_form), b=_part(2, spark_form), c=_part(3, spark_form))
    return out.replace("FROM conversations", "FROM {t}") if spark_form else out


_VERDICTS = f"""WITH cl AS ({_fill(_CLAIMS, False)}), sy AS ({_fill(_KNOWN, False)}), fi AS ({_fill(_PATHS, False)}), sl AS (SELECT DISTINCT lower(name) AS name FROM sy),
 t AS (SELECT id, lower(text) AS text, puts, put FROM cl),
 r AS (SELECT id, 'symbol' AS kind, unnest(l) AS v, generate_subscripts(l, 1) AS n FROM (SELECT id, list_distinct(regexp_extract_all(text, '(\\w+)\\(\\)', 1)) || list_filter(list_distinct(regexp_extract_all(text, '(?:the|a|an)\\s+(\\w+)\\s+(?:class|interface|type|function|method)', 1)), lambda x: NOT list_contains(regexp_extract_all(text, '(\\w+)\\(\\)', 1), x)) AS l FROM t)
  UNION ALL SELECT id, 'file', unnest(regexp_extract_all(text, '`([^`]+\\.(?:ts|js|tsx|jsx|json|yaml|yml))`', 1)), 0 FROM t UNION ALL SELECT id, 'config', unnest(regexp_extract_all(text, '`([^`]+)`\\s+(?:option|setting|key|config)', 1)), 0 FROM t),
 d AS (SELECT DISTINCT kind, v FROM r),
 k AS (SELECT kind, v, CASE kind WHEN 'symbol' THEN CASE WHEN v IN (SELECT name FROM sl) THEN 'verified' WHEN EXISTS (SELECT 1 FROM sl WHERE contains(name, v)) THEN 'inferred' END WHEN 'file' THEN CASE WHEN EXISTS (SELECT 1 FROM fi WHERE contains(name, v)) THEN 'verified' END ELSE CASE WHEN v IN ('user', 'system') THEN 'verified' END END AS c FROM d),
 g AS (SELECT r.id, list_sort(list(struct_pack(kind := r.kind, v := r.v, c := k.c)) FILTER (k.c IS NOT NULL)) AS f, max(struct_pack(n, v := r.v)) FILTER (k.c IS NULL AND r.kind='symbol') AS lost FROM r JOIN k ON k.kind=r.kind AND k.v=r.v GROUP BY 1),
 o AS (SELECT t.*, coalesce(len(g.f), 0) AS nf, g.f, g.lost.v AS lost, puts AND coalesce(len(g.f), 0)=0 AS asked, put IN (SELECT name FROM sy) AS there FROM t LEFT JOIN g USING (id)),
 s AS (SELECT *, CASE WHEN asked AND NOT there THEN 'contradicted' WHEN lost IS NOT NULL THEN 'unsupported' WHEN nf=0 AND NOT asked THEN 'inferred' ELSE 'verified' END AS status FROM o)"""


@query("sr08_claims", _VERDICTS.replace("\\\\", "\\") + """ SELECT id, status IN ('verified','inferred') AS valid, status, CASE status WHEN 'contradicted' THEN 'Claimed evidence "'||put||'" not found.' WHEN 'unsupported' THEN 'Symbol "'||lost||'" not found in project.' WHEN 'inferred' THEN 'No direct evidence found; claim may be inferential.' ELSE 'Claim is supported by project evidence.' END AS reason,
 CASE WHEN nf>0 THEN array_to_string(list_transform(f, lambda x: x.kind||':'||x.v||':'||x.c), ' ') WHEN asked AND there THEN 'symbol:'||put||':verified' ELSE '' END AS evidence FROM s""")
def _claims(spark, d):
    t = table(spark, d, "conversations")
    get = lambda q: spark.sql(_fill(q, True), t=t)
    own = F.when(F.col("puts"), F.array(F.struct(F.lit("symbol").alias("kind"), F.col("put").alias("value"))))
    keys = spark.createDataFrame([("USER",), ("system",)], "name string")
    found = C.validate_claims(get(_CLAIMS).select("id", "text", own.alias("evidence")), get(_KNOWN), get(_PATHS), keys)
    return found.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["value"], e["confidence"])), " "))
