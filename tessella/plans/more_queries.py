"""Reference, search, composition and planning queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import compose, planning, references, search, site
from tessella.operators.common import cut
from tessella.plans.registry import query, table


def _name(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]) if isinstance(p, str) else p for p in parts])


@query("jn06_imports", """WITH f AS (SELECT 'src/m'||p_partkey||CASE p_partkey%3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END AS path FROM part), i AS (SELECT p_partkey AS id, 'src/m'||(p_partkey*3%2500) AS base FROM part)
 SELECT id, coalesce(a.path,b.path,c.path) AS target FROM i LEFT JOIN f a ON a.path=base||'.ts' LEFT JOIN f b ON b.path=base||'.js' LEFT JOIN f c ON c.path=base||'/index.ts'""")
def _imports(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    ending = F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".js").otherwise("/index.ts")
    files = p.select(F.concat(F.lit("src/m"), k, ending).alias("path"))
    uses = p.select(F.concat(F.lit("src/x"), k, F.lit(".ts")).alias("file"), F.concat(F.lit("./m"), k * 3 % 2500).alias("specifier"))
    r = references.resolve_imports(uses, files)
    return r.select(F.regexp_extract("file", r"x(\d+)", 1).cast("long").alias("id"), "target")


@query("jn07_names", """WITH RECURSIVE e AS (SELECT p_partkey%100 AS module, p_name AS name FROM part WHERE p_partkey%100>=50), s AS (SELECT DISTINCT p_partkey%50 AS module, p_partkey%50+25+(p_partkey%50)//2 AS source FROM part),
 x AS (SELECT module, name FROM e UNION SELECT s.module, x.name FROM s JOIN x ON s.source=x.module) SELECT module, count(*) AS names FROM x GROUP BY 1""")
def _names(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    exports = p.select((k % 100).alias("module"), F.col("p_name").alias("name")).filter("module >= 50")
    stars = p.select((k % 50).alias("module"), (k % 50 + 25 + F.floor(k % 50 / 2)).alias("source")).distinct()
    return references.exported_names(exports, stars).groupBy("module").agg(F.count("*").alias("names"))


@query("jn10_packages", """SELECT p_partkey, CASE WHEN lower(p_type) IN ('economy','small') THEN '1.0' END AS version FROM part""")
def _packages(spark, d):
    known = spark.createDataFrame([("economy", "1.0"), ("small", "1.0")], "name string, version string")
    return references.resolve_packages(table(spark, d, "part").select("p_partkey", F.concat(F.lower("p_type"), F.lit("/sub")).alias("specifier")), known).select("p_partkey", "version")


@query("jn16_title_mentions", r"""SELECT DISTINCT d.doc_id AS page, 100000+t.item AS mentions FROM documents d JOIN (SELECT item_id AS item, regexp_extract(text,'^[A-Za-z0-9_]+ [A-Za-z0-9_]+') AS title FROM benchmark) t ON length(t.title)>=4 AND regexp_matches(d.text,'\b'||t.title||'\b')""")
def _mentions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), "text")
    titles = table(spark, d, "benchmark").select((F.col("item_id") + 100000).alias("id"), F.regexp_extract("text", "^[A-Za-z0-9_]+ [A-Za-z0-9_]+", 0).alias("title"), F.lit("").alias("text"))
    return references.title_mentions(docs.unionByName(titles), "id", "title", "text")


@query("jn25_type_edges", """WITH s AS (SELECT DISTINCT upper(substr(split_part(p_name,' ',1),1,1))||substr(split_part(p_name,' ',1),2) AS name, upper(substr(split_part(p_name,' ',2),1,1))||substr(split_part(p_name,' ',2),2) AS ret FROM part), n AS (SELECT DISTINCT name FROM (SELECT name FROM s UNION SELECT ret FROM s WHERE ret<'N'))
 SELECT DISTINCT s.name AS src, s.ret AS dst, 'returns' AS kind FROM s JOIN n ON n.name=s.ret WHERE s.name<>s.ret""")
def _type_edges(spark, d):
    word = lambda k: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(k)))
    s = table(spark, d, "part").select(word(1).alias("name"), word(2).alias("ret")).distinct()
    none = F.lit(None).cast("string")
    rows = s.select("name", none.alias("parent"), none.alias("extends"), F.array().cast("array<string>").alias("implements"), F.concat(F.lit("Promise<"), "ret", F.lit(">")).alias("return_type"), F.array(F.lit("string")).alias("parameters"))
    extra = s.filter("ret < 'N'").select(F.col("ret").alias("name"), none.alias("parent"), none.alias("extends"), F.array().cast("array<string>").alias("implements"), F.lit("void").alias("return_type"), F.array(F.lit("string")).alias("parameters"))
    return references.type_edges(rows.unionByName(extra))


@query("jn26_affected", """SELECT l_orderkey AS page, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size=7) GROUP BY 1""")
def _affected(spark, d):
    changes = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("subject"))
    return references.affected_pages(changes, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("subject")))


@query("gr16_edge_projection", """SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag IN ('A','R')""")
def _projection(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return references.owning_chain(e, ["A", "R"])


@query("gr26_planner_orders", """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS s FROM lineitem), p AS (SELECT DISTINCT k, k::VARCHAR AS slug FROM s)
 SELECT 'getting-started' AS src, slug AS dst, 'prerequisite' AS kind FROM p WHERE k%2=0 UNION SELECT a.k::VARCHAR, b.k::VARCHAR, 'related' FROM s a JOIN s b ON a.s=b.s AND a.k::VARCHAR<b.k::VARCHAR
 UNION SELECT * FROM (SELECT lag(slug) OVER (PARTITION BY k//100 ORDER BY k) AS src, slug, 'next-step' FROM p WHERE k%5=0) WHERE src IS NOT NULL UNION SELECT (k//100*100)::VARCHAR, slug, 'extends' FROM p WHERE k%5=0 AND k//100*100 IN (SELECT k FROM p)""")
def _planner_orders(spark, d):
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("symbols"))
    pages = o.select(
        F.col("k").cast("string").alias("slug"), F.col("k").alias("ordinal"), F.when(F.col("k") % 2 == 0, F.array(F.lit("api"))).otherwise(F.array(F.lit("x"))).alias("kinds"), "symbols",
        F.when(F.col("k") % 5 == 0, (F.floor(F.col("k") / 100) * 100).cast("string")).alias("split_from"),
    )
    start = spark.createDataFrame([("getting-started", -1, ["overview"], [], None)], pages.schema)
    return planning.planner_relations(pages.unionByName(start))


@query("sr02_importance", """SELECT p_partkey, greatest(0e0,least(1e0, CASE WHEN p_size%2=0 THEN 25e-2*least(1e0,1/1e2+4e-1) ELSE 0e0 END + CASE p_size%3 WHEN 0 THEN 12e-2 WHEN 1 THEN 75e-3 ELSE 0e0 END + 15e-2*least(1e0,p_partkey%4/3e0) + CASE WHEN p_partkey%5=0 THEN 5e-2 ELSE 0e0 END + CASE WHEN p_size%3=0 THEN 1e-1 ELSE 0e0 END + CASE WHEN p_size%3=1 THEN 6e-2 ELSE 0e0 END + 5e-2*5e-1)) AS importance FROM part""")
def _importance(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    kinds = F.array_compact(F.array(F.when(s % 2 == 0, "api"), F.when(s % 3 == 0, "overview").when(s % 3 == 1, "guide")))
    t = table(spark, d, "part").select("p_partkey", F.lit("x").alias("slug"), kinds.alias("kinds"), F.array("p_name").alias("symbols"), F.lit("s").alias("section"), (k % 5 == 0).alias("canonical"), (k % 4).alias("dependents"), F.lit(0.5).alias("churn"))
    return planning.importance(t, 100).select("p_partkey", "importance")


@query("sr11_file_classes", """SELECT p_partkey, ['test','story','documentation','config','declaration','style','asset','source','asset','unknown'][p_partkey%10+1] AS class FROM part""")
def _classes(spark, d):
    names = F.array(*[F.lit(x) for x in ("a.test.ts", "b.stories.tsx", "C.md", "x/tsconfig.json", "t.d.ts", "u.scss", "v.PNG", "src/w.py", "y.csv", "z.bin")])
    return table(spark, d, "part").select("p_partkey", planning.file_class(F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int"))).alias("class"))


@query("xd09_scripts", """SELECT p_partkey, ['testing','validation','build','publishing','development','maintenance'][p_partkey%6+1] AS bucket FROM part""")
def _scripts(spark, d):
    names = F.array(*[F.lit(x) for x in ("test:unit", "lint", "build", "release", "dev", "clean")])
    return table(spark, d, "part").select("p_partkey", planning.script_class(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("bucket"))


@query("sr19_search")
def _search(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<h1>([\s\S]*?)</h1>", 1).alias("title"), F.regexp_extract("url", "//([^/?#]*)", 1).alias("category"), X.strip_html("html").alias("content"))
    index = cut(search.inverted_index(pages, "page_id", {"title": "title", "category": "category", "content": "content"}))
    found = search.search(index, "page_id", spark.createDataFrame([("there estion",), ("menteau",)], "query string"), n_docs=pages.count())
    return found.select("query", "page_id", F.round("score", 6).alias("score"))


@query("ag08_concepts", """WITH c AS (SELECT p_partkey AS k, CASE p_size%3 WHEN 0 THEN lower(p_type)||'-'||p_partkey WHEN 1 THEN 'get-'||p_partkey ELSE p_name||p_partkey END AS name, CASE WHEN p_size%3=0 THEN lower(p_type) END AS pre FROM part)
 SELECT CASE WHEN count(*)>1 THEN coalesce(pre,name) ELSE min(name) END AS name, count(*) AS members FROM c GROUP BY coalesce(pre,name), pre""")
def _concepts(spark, d):
    s = F.col("p_size") % 3
    name = F.when(s == 0, F.concat(F.lower("p_type"), F.lit("-"), "p_partkey")).when(s == 1, F.concat(F.lit("get-"), "p_partkey")).otherwise(F.concat("p_name", "p_partkey"))
    g = planning.concept_groups(table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), name.alias("name")))
    return g.select("name", F.size("members").cast("long").alias("members"))


@query("ag09_coverage", """SELECT p_type AS area, count(*) FILTER (WHERE p_size>20) AS documented, count(*) FILTER (WHERE p_size<=20) AS gaps, count(*) FILTER (WHERE p_size>20)/count(*) AS score FROM part WHERE p_partkey%7<>0 GROUP BY 1""")
def _coverage(spark, d):
    t = table(spark, d, "part").select(F.col("p_type").alias("area"), F.col("p_name").alias("item"), (F.col("p_size") > 20).alias("documented"), (F.col("p_partkey") % 7 == 0).alias("excluded"))
    return planning.coverage(t)


@query("in07_fingerprints", """SELECT o_orderkey, substr(sha256(o_custkey||chr(1)||o_orderstatus||chr(1)||o_orderpriority),1,16) AS fingerprint FROM orders""")
def _fingerprints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", planning.page_fingerprint(["o_custkey", "o_orderstatus", "o_orderpriority"]).alias("fingerprint"))


@query("xd03_directories", r"""WITH p AS (SELECT regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p FROM pages), x AS (SELECT regexp_replace(p,'/[^/]*$','') AS dir FROM p WHERE strpos(p,'/')>0), s AS (SELECT string_split(dir,'/') AS l FROM x)
 SELECT DISTINCT array_to_string(l[1:i],'/') AS node, CASE WHEN i=1 THEN '.' ELSE array_to_string(l[1:i-1],'/') END AS parent, i::INT AS depth FROM s, unnest(range(1,least(len(l),5)+1)) AS r(i)""")
def _directories(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return planning.directory_tree(table(spark, d, "pages").select(path.alias("p")), "p")


@query("xd05_environment", """SELECT 'KEY_'||p_size AS name, max(p_brand||p_partkey) AS file, false AS secret FROM part GROUP BY 1""")
def _environment(spark, d):
    t = table(spark, d, "part").select(F.concat("p_brand", "p_partkey").alias("f"), F.concat(F.lit("x = process.env.KEY_"), "p_size", F.lit(";")).alias("c"))
    return planning.environment_variables(t, "f", "c")


@query("dg08_breadcrumbs", """SELECT o_custkey AS slug, o_orderkey AS ordinal, o_orderstatus AS label FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NULL OR b<>o_orderstatus""")
def _breadcrumbs(spark, d):
    return planning.breadcrumbs(table(spark, d, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("label")))


@query("dg09_api_findings", """SELECT p_name||p_partkey AS name, CASE WHEN p_size%3=0 THEN 'API_UNDOCUMENTED' WHEN p_size%3=1 THEN 'API_PARAM_MISMATCH' ELSE 'API_MISSING_RETURNS' END AS code, CASE WHEN p_size%3=2 THEN 'info' ELSE 'warning' END AS severity FROM part""")
def _api_findings(spark, d):
    s = F.col("p_size") % 3
    t = table(spark, d, "part").select(
        _name("$p_name", "$p_partkey").alias("name"), F.when(s != 0, "d").alias("doc"), F.array(F.lit("a")).alias("parameters"), F.when(s == 1, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("doc_parameters"),
        F.when(s == 2, "number").otherwise("void").alias("return_type"), F.lit(False).alias("doc_returns"),
    )
    return references.undocumented(t)


@query("dg10_unresolved", """SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'REF_UNRESOLVED_IMPORT' WHEN 'error' THEN 'REF_UNRESOLVED_BASE' ELSE 'REF_UNRESOLVED_NAME' END AS code, CASE WHEN event_type IN ('click','error') THEN 'error' ELSE 'warning' END AS severity FROM events WHERE value<10 AND user_id%3=0""")
def _unresolved(spark, d):
    kind = F.when(F.col("event_type") == "click", "import").when(F.col("event_type") == "error", "extends").otherwise("name")
    return references.unresolved(table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("kind"), F.when(F.col("value") >= 10, F.col("value")).alias("to_id"), F.when(F.col("user_id") % 3 != 0, F.lit("f")).alias("to_file")))


@query("dg14_terms", """SELECT p_name||p_partkey AS term, CASE WHEN p_partkey%3=0 THEN 'valid' WHEN p_partkey%3=1 THEN 'suggestion' ELSE 'unknown' END AS status, CASE WHEN p_partkey%3=1 THEN 'C'||p_partkey END AS suggestion FROM part""")
def _term_status(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    term = _name("$p_name", "$p_partkey")
    dictionary = p.filter(k % 3 != 2).select(F.when(k % 3 == 0, F.upper(term)).otherwise(F.concat(F.lit("C"), k)).alias("canonical"), F.when(k % 3 == 1, F.array(F.upper(term))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    return planning.validate_terms(p.select(term.alias("term")), dictionary)


@query("df05_semantic_diff")
def _semantic(spark, d):
    b = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ordinal"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"), F.col("text"))
    after = b.withColumn("text", F.when(F.col("ordinal") % 3 == 0, F.upper(F.substring("text", 2, 60))).otherwise(F.col("text")))
    return compose.semantic_diff(b, after, "conv_id").select("conv_id", "change", X.hash16("subject").alias("subject"))


@query("df06_merge")
def _merge(spark, d):
    b = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("page"), F.col("turn").alias("ordinal"), "text")
    generated = b.withColumn("text", F.when(F.col("ordinal") % 4 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    user = b.withColumn("text", F.when(F.col("ordinal") % 5 == 1, F.concat("text", F.lit(" mine"))).otherwise(F.col("text")))
    return compose.three_way_merge(b, generated, user).groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("owner") == "user-authored").alias("mine"), F.count_if("conflict").alias("conflicts"))


@query("df14_redirects", """SELECT '/a'||p_partkey AS "from", '/b'||p_partkey AS "to" FROM part WHERE p_size<3 UNION ALL SELECT 'old/'||p_partkey, '/b'||p_partkey FROM part WHERE p_size>48""")
def _redirects(spark, d):
    p = table(spark, d, "part")
    renames = p.filter("p_size < 3").select(_name("a", "$p_partkey").alias("from"), _name("b", "$p_partkey").alias("to"))
    aliases = p.filter("p_size > 48").select(_name("b", "$p_partkey").alias("slug"), F.concat(F.lit("/old/"), "p_partkey", F.lit(".md")).alias("alias"))
    return site.redirects(renames, aliases)


@query("pr50_includes", """SELECT p_partkey, 'a '||CASE WHEN p_size%3=2 THEN '' ELSE '['||p_type||']' END||' b' AS body, false AS cyclic FROM part""")
def _includes(spark, d):
    p = table(spark, d, "part")
    t = p.select("p_partkey", F.concat(F.lit("a <!-- @include "), F.when(F.col("p_size") % 3 == 2, "none").when(F.col("p_size") % 3 == 1, F.concat(F.lit("via-"), F.lower("p_type"))).otherwise(F.lower("p_type")), F.lit(" --> b")).alias("body"))
    own = p.select(F.lower("p_type").alias("name"), F.concat(F.lit("["), "p_type", F.lit("]")).alias("body")).distinct()
    via = own.select(F.concat(F.lit("via-"), "name").alias("name"), F.concat(F.lit("<!-- @docs:include "), "name", F.lit(" -->")).alias("body"))
    return compose.expand_includes(t, "p_partkey", "body", own.unionByName(via))


@query("pr51_highlight")
def _highlight(spark, d):
    code = F.concat(F.lit("const x = '"), "p_name", F.lit("'; // "), "p_brand")
    return table(spark, d, "part").select("p_partkey", X.hash16(compose.highlighted(code, "ts")).alias("html_hash"))


@query("pr38_pr39_pr41_pr44_extract", """SELECT p_partkey, p_name AS tests, 'param,returns' AS tags, 'timeout' AS keys FROM part""")
def _extract(spark, d):
    src = F.concat(F.lit("/** Doc.\n * @param a the a\n * @returns b */\nit('"), "p_name", F.lit("', () => {});\nconst c = { timeout: 3 };"))
    t = table(spark, d, "part").select("p_partkey", src.alias("s"))
    tags = F.transform(compose.doc_tags("s"), lambda x: x["tag"])
    return t.select("p_partkey", F.array_join(compose.test_cases("s"), ",").alias("tests"), F.array_join(tags, ",").alias("tags"), F.array_join(compose.configuration_keys("s", ["timeout", "retries"]), ",").alias("keys"))
