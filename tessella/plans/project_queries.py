"""Project, summary and check queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import project
from tessella.plans.registry import query, table
from tessella.sources.sinks import MARKER


@query("ag07_modules", r"""SELECT CASE WHEN strpos(p,'/')=0 THEN '.' ELSE regexp_replace(p,'/[^/]*$','') END AS module, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p FROM pages) GROUP BY 1""")
def _modules(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return project.by_module(table(spark, d, "pages").select(p.alias("p")), "p")


@query("ag11_link_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus='F') AS valid, count(*) FILTER (WHERE o_orderstatus='F')/count(*) AS rate FROM orders""")
def _link_summary(spark, d):
    return project.link_summary(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").otherwise("missing-page").alias("status")))


@query("ag12_ag16_severities", """SELECT count(*) FILTER (WHERE event_type='error') AS errors, count(*) FILTER (WHERE event_type='click') AS warnings, count(*) FILTER (WHERE event_type NOT IN ('error','click')) AS notes FROM events""")
def _severities(spark, d):
    s = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return project.severity_counts(table(spark, d, "events").select(s.alias("severity")))


@query("ag13_reviews", """SELECT avg(n) AS rounds, avg(last) AS last FROM (SELECT count(*) AS n, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY o_custkey)""")
def _reviews(spark, d):
    scores = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"])
    return project.review_summary(table(spark, d, "orders").groupBy("o_custkey").agg(scores.alias("scores")))


@query("jn08_dotted_names", """SELECT p_partkey||'.a.b' AS name, CASE WHEN p_partkey%2=0 THEN 'm'||p_partkey||'ab' END AS target FROM part""")
def _dotted(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    m = F.concat(F.lit("m"), k)
    none = F.lit(None).cast("string")
    members = p.select(none.alias("owner"), k.alias("member"), m.alias("target")).unionByName(
        p.select(m.alias("owner"), F.lit("a").alias("member"), F.concat(m, F.lit("a")).alias("target"))
    ).unionByName(p.filter("p_partkey % 2 = 0").select(F.concat(m, F.lit("a")).alias("owner"), F.lit("b").alias("member"), F.concat(m, F.lit("ab")).alias("target")))
    return project.resolve_dotted(p.select(F.concat(k, F.lit(".a.b")).alias("name")), members, 3)


@query("xd07_xd15_precedence", """SELECT p_brand AS project, CASE min(CASE p_type WHEN 'SMALL' THEN 1 WHEN 'ECONOMY' THEN 2 WHEN 'STANDARD' THEN 3 END) WHEN 1 THEN 'SMALL' WHEN 2 THEN 'ECONOMY' ELSE 'STANDARD' END AS tool FROM part WHERE p_type IN ('SMALL','ECONOMY','STANDARD') GROUP BY 1""")
def _precedence(spark, d):
    return project.first_by_precedence(table(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("tool")), "project", "tool", ["SMALL", "ECONOMY", "STANDARD"])


@query("sr20_xd11_languages", """SELECT user_id AS project, event_type AS language, least(1e0, count(*)*5e-2) AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY least(1e0, count(*)*5e-2) DESC, event_type) AS rank FROM events GROUP BY 1,2""")
def _languages(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("project"), F.col("event_type").alias("language")).agg((F.count("*") * 0.05).alias("weight"))
    return project.detect_languages(e)


@query("xp03_related", """SELECT l_orderkey AS src, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS related FROM lineitem GROUP BY 1""")
def _related(spark, d):
    r = project.related_lists(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("dst")))
    return r.select("src", F.array_join("related", ",").alias("related"))


@query("xp05_journey", """SELECT slug, CASE slug WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 3 ELSE 4 END::BIGINT AS position FROM (SELECT DISTINCT c_mktsegment AS slug FROM customer) WHERE slug IN ('BUILDING','MACHINERY','HOUSEHOLD')""")
def _journey(spark, d):
    return project.journey(table(spark, d, "customer").select(F.col("c_mktsegment").alias("slug")).distinct(), ["BUILDING", "none", "MACHINERY", "HOUSEHOLD"])


@query("xp10_markers", """SELECT conv_id, turn, turn%2=0 AS generated, true AS marked, text AS plain FROM conversations""")
def _markers(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(MARKER + "\n"), "text")).otherwise(F.col("text"))
    c = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    return c.select("conv_id", "turn", project.is_generated("t").alias("generated"), project.is_generated(project.mark_generated("t")).alias("marked"), project.strip_marker(project.mark_generated("t")).alias("plain"))


@query("xr04_exports", """SELECT p_partkey, p_partkey%3<>2 AS exported, CASE p_partkey%3 WHEN 0 THEN 'main.js' WHEN 1 THEN 'sub.js' END AS target FROM part""")
def _exports(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg"), k)
    packages = p.select(name.alias("name"), F.lit("main.js").alias("main"), F.create_map(F.lit("./sub"), F.lit("sub.js")).alias("exports"))
    spec = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, F.lit("/sub"))).otherwise(F.concat(name, F.lit("/no")))
    r = project.export_target(packages, p.select(spec.alias("specifier")))
    return r.select(F.regexp_extract("specifier", r"pkg(\d+)", 1).cast("long").alias("p_partkey"), "exported", "target")


@query("xs01_doctor", """SELECT p_partkey AS name, 'unknown' AS state FROM part WHERE p_partkey%2=0 AND p_partkey%3<>0 UNION ALL SELECT p_partkey, 'untracked' FROM part WHERE p_partkey%2=0 AND p_partkey%3=0 AND p_partkey%5<>0 UNION ALL SELECT p_partkey, 'orphaned' FROM part WHERE p_partkey%5=0 AND p_partkey%2<>0""")
def _doctor(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    return project.doctor(p.filter("name % 3 = 0"), p.filter("name % 2 = 0"), p.filter("name % 5 = 0"))


@query("dg06_page_findings", """WITH s AS (SELECT conv_id, count(*) FILTER (WHERE role<>'user') AS content, count(*) FILTER (WHERE role='user') AS titles FROM conversations GROUP BY 1) SELECT conv_id, 'EMPTY_PAGE' AS code FROM s WHERE content=0 UNION ALL SELECT conv_id, 'DUPLICATE_TITLE' FROM s WHERE titles>1""")
def _page_findings(spark, d):
    b = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"), "text")
    return project.page_findings(b, "conv_id")


@query("dg13_output", """SELECT 'o/'||p_partkey AS path, 'MISSING_OUTPUT' AS code FROM part WHERE p_size%3=0 UNION ALL SELECT '../'||p_partkey, 'PATH_ESCAPE' FROM part WHERE p_size%7=0 AND p_size%3<>0""")
def _output(spark, d):
    p = table(spark, d, "part")
    inside, outside = F.concat(F.lit("o/"), "p_partkey"), F.concat(F.lit("../"), "p_partkey")
    written = p.filter("p_size % 3 <> 0").select(inside.alias("path")).union(p.filter("p_size % 7 = 0 and p_size % 3 <> 0").select(outside))
    return project.output_findings(p.select(inside.alias("path")), written)


@query("dg16_components", """SELECT p_partkey AS id, CASE WHEN p_size%3=0 THEN 'UNKNOWN_COMPONENT' ELSE 'MISSING_PROP' END AS code FROM part WHERE p_size%3<>1""")
def _components(spark, d):
    s = F.col("p_size") % 3
    usages = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(s == 0, "Nope").otherwise("Card").alias("component"), F.when(s == 1, F.array(F.lit("title"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("props")
    )
    return project.component_findings(usages, spark.createDataFrame([("Card", ["title"])], "component string, required array<string>"))
