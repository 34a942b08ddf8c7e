"""Queries of page plans: a conversation as a project, its turns as candidates, concepts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import page_plan as P
from tessella.plans.registry import query, table

_CANDIDATES = "SELECT conv_id AS project, CAST(floor(turn / 3) AS int) AS rank, turn AS at, concat('s', (conv_id + turn * 5) % 4) AS id, concat('Section ', turn) AS title, CASE WHEN turn % 4 < 3 THEN concat('e', turn % 4) END AS needs FROM conversations"
_EVIDENCE = "SELECT conv_id AS project, concat('e', (conv_id + turn) % 3) AS kind FROM conversations WHERE turn % 4 = 1"
_OVERRIDES = "SELECT DISTINCT conv_id AS project, concat('s', conv_id % 3) AS id, conv_id % 5 = 0 AS enabled, CASE WHEN conv_id % 2 = 0 THEN 'Forced' END AS title FROM conversations WHERE conv_id % 5 < 2"
_CONCEPTS = "SELECT conv_id AS project, concat('group', CASE WHEN conv_id % 2 = 0 THEN 0 ELSE turn % 2 END) AS grp, conv_id % 3 < 2 AS shared, turn AS at, concat('name', turn) AS name, CASE WHEN turn % 3 = 0 THEN 'api' WHEN turn % 3 = 1 THEN role END AS api FROM conversations"
_PAGES = """SELECT conv_id AS project, concat('p', turn) AS slug, CASE WHEN turn % 4 = 2 THEN concat('Section ', turn % 2) ELSE concat('Page ', turn) END AS title, concat('s', turn % 2) AS section, turn AS at,
 CASE WHEN turn % 4 = 2 THEN concat('p', turn - 2) WHEN turn % 8 = 3 THEN 'nowhere' WHEN turn % 8 = 5 THEN concat('p', turn - 1) END AS split_from FROM conversations"""


def _get(spark, d, text):
    return spark.sql(text.replace("FROM conversations", "FROM {t}"), t=table(spark, d, "conversations"))


@query("xp01_sections", f"""WITH ca AS ({_CANDIDATES.replace(' AS at', ' AS o')}), ev AS ({_EVIDENCE}), ov AS ({_OVERRIDES}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY rank, o) AS n FROM ca) WHERE n=1)
 SELECT f.project, f.id, coalesce(ov.title, f.title) AS title, row_number() OVER (PARTITION BY f.project ORDER BY f.rank, f.o) AS position, ov.id IS NOT NULL AS overridden FROM f LEFT JOIN ov ON ov.project=f.project AND ov.id=f.id
 WHERE coalesce(ov.enabled, f.needs IS NULL OR EXISTS (SELECT 1 FROM ev WHERE ev.project=f.project AND ev.kind=f.needs))""")
def _sections(spark, d):
    return P.plan_sections(_get(spark, d, _CANDIDATES), _get(spark, d, _EVIDENCE), _get(spark, d, _OVERRIDES))


@query("xp01_concept_pages", f"""WITH c AS ({_CONCEPTS.replace(' AS at', ' AS o')}), k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY project, grp) AS n FROM c WINDOW w AS (PARTITION BY project, grp ORDER BY o)), s AS (SELECT *, shared AND n>=6 AS split FROM k)
 SELECT project, grp AS slug, 'Group'||substr(grp,6) AS title, 0.8::double AS importance, 'summary' AS depth, NULL AS split_from, NULL AS consolidated_from, '' AS symbols FROM s WHERE split AND k=1
 UNION ALL SELECT project, grp||'/'||name, 'Name'||substr(name,5), 0.55, 'standard', grp, NULL, coalesce(api, '') FROM s WHERE split AND k<=12
 UNION ALL SELECT project, grp, 'Group'||substr(grp,6), CASE WHEN n>1 THEN 0.75 ELSE 0.65 END, 'standard', NULL, CASE WHEN n>1 THEN string_agg(name, ',' ORDER BY k) END, coalesce((SELECT string_agg(api, ',' ORDER BY m) FROM (SELECT x.api, min(x.k) AS m FROM s x WHERE x.project=s.project AND x.grp=s.grp AND x.api IS NOT NULL GROUP BY 1)), '') FROM s WHERE NOT split GROUP BY project, grp, n""")
def _concept_pages(spark, d):
    c = _get(spark, d, _CONCEPTS).withColumnRenamed("grp", "group").withColumn("apis", F.when(F.col("api").isNotNull(), F.array("api"))).drop("api")
    return P.concept_pages(c).withColumn("consolidated_from", F.array_join("consolidated_from", ",")).withColumn("symbols", F.array_join("symbols", ","))


@query("xp02_navigation", f"""WITH p AS ({_PAGES.replace(' AS at', ' AS o')}), t AS (SELECT p.*, split_from IS NOT NULL AND EXISTS (SELECT 1 FROM p h WHERE h.project=p.project AND h.section=p.section AND h.slug=p.split_from AND h.split_from IS NULL) AS hangs FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY project, section, hangs ORDER BY split_from IS NOT NULL, o) AS top, row_number() OVER (PARTITION BY project, section, split_from ORDER BY o) AS below FROM t),
 b AS (SELECT r.*, u.top AS up, (SELECT min_by(title, o) FROM p x WHERE x.project=r.project AND x.slug=r.split_from) AS pt, 'Section '||substr(r.section,2) AS st FROM r LEFT JOIN r u ON r.hangs AND u.project=r.project AND u.section=r.section AND u.slug=r.split_from AND u.split_from IS NULL)
 SELECT project, section, slug, CASE WHEN hangs THEN split_from END AS parent, (substr(section,2)::int+1)||'.'||CASE WHEN hangs THEN up||'.'||below ELSE top::varchar END AS place,
  'Documentation>'||st||CASE WHEN split_from IS NULL OR coalesce(pt, split_from)=st THEN '' ELSE '>'||coalesce(pt, split_from) END||CASE WHEN title=CASE WHEN split_from IS NULL THEN st ELSE coalesce(pt, split_from) END THEN '' ELSE '>'||title END AS breadcrumbs FROM b""")
def _navigation(spark, d):
    sections = table(spark, d, "conversations").select(F.col("conv_id").alias("project")).distinct().select("project", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr("project", "concat('s', k) AS id", "concat('Section ', k) AS title", "k + 1 AS position")
    found = P.organize(sections, _get(spark, d, _PAGES))
    return found.withColumn("place", F.array_join(F.col("place").cast("array<string>"), ".")).withColumn("breadcrumbs", F.array_join("breadcrumbs", ">"))


_KNOWN = "SELECT conv_id AS project, CASE turn % 8 WHEN 0 THEN 'getting-started' WHEN 1 THEN 'api' WHEN 2 THEN 'troubleshooting' WHEN 3 THEN 'concepts' WHEN 4 THEN 'architecture' WHEN 5 THEN 'introduction' WHEN 6 THEN 'configuration' ELSE 'other' END AS slug FROM conversations"
_WHO = "SELECT conv_id AS project, CASE turn % 6 WHEN 0 THEN 'end-user' WHEN 1 THEN 'api-consumer' WHEN 2 THEN 'operator' WHEN 3 THEN 'contributor' WHEN 4 THEN 'developer' ELSE 'plugin-author' END AS persona, (conv_id + turn) % 3 AS priority FROM conversations WHERE conv_id % 6 > 0 AND turn < 6"
_STEPS = ", ".join(f"('{n}', {k}, '{s}')" for n, steps in [*P.PERSONAS.items(), ("developer", P.OTHERS)] for k, s in enumerate(steps))


@query("xp04_learning_paths", f"""WITH pg AS (SELECT DISTINCT * FROM ({_KNOWN})), w AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY priority DESC, persona) AS n FROM ({_WHO})), j AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{s}')" for k, s in enumerate(P.JOURNEY))}) v(k, slug)), st AS (SELECT * FROM (VALUES {_STEPS}) v(persona, k, slug)),
 a AS (SELECT pg.project, 'Primary Journey' AS path, coalesce(w.persona, 'developer') AS persona, k, pg.slug FROM pg JOIN j USING (slug) LEFT JOIN w ON w.project=pg.project AND w.n=1
  UNION ALL SELECT w.project, CASE w.persona WHEN 'end-user' THEN 'End User' WHEN 'api-consumer' THEN 'Api Consumer' WHEN 'plugin-author' THEN 'Plugin Author' ELSE upper(w.persona[1])||substr(w.persona,2) END||' Path', w.persona, k, pg.slug FROM w JOIN st ON st.persona=w.persona JOIN pg ON pg.project=w.project AND pg.slug=st.slug WHERE n BETWEEN 2 AND 4)
 SELECT project, path, persona, row_number() OVER (PARTITION BY project, path, persona ORDER BY k) AS step, slug FROM a""")
def _learning_paths(spark, d):
    return P.learning_paths(_get(spark, d, _KNOWN), _get(spark, d, _WHO))
