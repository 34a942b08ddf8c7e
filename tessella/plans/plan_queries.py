"""Leading blocks, output plans and relation queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import frontmatter, graph, output_plan, pages, relations
from tessella.plans.registry import query, table

#: A document for each part, written in SQL that both engines read.
_RAW = """CASE WHEN p_partkey%5=0 THEN 'Body of '||p_name ELSE '---'||chr(10)||'title: '||p_name||chr(10)||'order: '||p_size||chr(10)
 ||CASE WHEN p_partkey%3=0 THEN 'sidebar:'||chr(10)||'  order: '||(p_partkey%50)||chr(10)||'  label: x'||chr(10) ELSE '' END
 ||'author: '||CASE WHEN p_partkey%7=0 THEN '42' WHEN p_partkey%7=1 THEN '" "' ELSE p_brand END||chr(10)
 ||'date: 2024-'||lpad(CAST(p_partkey%14 AS STRING),2,'0')||'-'||lpad(CAST(p_size AS STRING),2,'0')||chr(10)
 ||'aliases: [a'||p_partkey||', b]'||chr(10)||'protected: '||CASE WHEN p_size%2=0 THEN 'true' ELSE '1' END||chr(10)||'---'||chr(10)||'Body of '||p_name END"""


@query("pr02_pr10_pr11_pr12_frontmatter", """SELECT p_partkey, CASE WHEN b THEN p_name END AS title, b AND p_size%2=0 AS protected, CASE WHEN b THEN 'a'||p_partkey||'|b' END AS aliases,
 CASE WHEN b THEN 'author,date,order' ELSE '' END AS unknown, 'Body of '||p_name AS body,
 CASE WHEN NOT b THEN 0.0 WHEN p_partkey%3=0 THEN p_partkey%50 ELSE p_size END::DOUBLE AS page_order,
 CASE WHEN b THEN strftime(try_cast('2024-'||lpad((p_partkey%14)::VARCHAR,2,'0')||'-'||lpad(p_size::VARCHAR,2,'0') AS DATE),'%Y-%m-%d') END AS day,
 CASE WHEN b AND p_partkey%7>1 THEN p_brand END AS author FROM (SELECT *, p_partkey%5<>0 AS b FROM part)""")
def _frontmatter(spark, d):
    found = frontmatter.split_frontmatter(table(spark, d, "part").withColumn("raw", F.expr(_RAW)), "raw")
    return found.select(
        "p_partkey", "title", "protected", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.array_sort(F.map_keys("unknown")), ",").alias("unknown"), "body",
        frontmatter.page_order().alias("page_order"), frontmatter.page_date().alias("day"), frontmatter.page_author().alias("author"),
    )


#: A document before each text: blocks of every form, some broken; written in SQL that both engines read.
_FORMS = (
    "'title: |-'||chr(10)||'  Page '||doc_id||chr(10)||'  two'||chr(10)",
    "'title: \"Page '||chr(92)||'\"'||doc_id||chr(92)||'\"\"   # note'||chr(10)||'sidebar: {order: '||(doc_id%9)||', label: '||chr(39)||'it'||chr(39)||chr(39)||'s'||chr(39)||'}'||chr(10)",
    "'title: >'||chr(10)||'  Page'||chr(10)||'  '||doc_id||chr(10)||'aliases:'||chr(10)||'  - a'||doc_id||chr(10)||'  - \"b # c\"'||chr(10)||'  - 7'||chr(10)||'order: 1e1'||chr(10)",
    "'\"title\": Page '||doc_id||chr(10)||'title: again'||chr(10)||'author: '||chr(39)||' Ann '||chr(39)||chr(10)||'date: 2024-02-'||lpad(CAST(20+doc_id%12 AS varchar(9)),2,'0')||chr(10)||'kind: blog'||chr(10)",
    "'title: '||doc_id||chr(10)||'order: [1'||chr(10)",
    "'tags: [x,'||chr(10)||'  y]'||chr(10)||'deep:'||chr(10)||'  in:'||chr(10)||'  - k: 1'||chr(10)||'    l: 2'||chr(10)||'protected: true'||chr(10)||'locale: '||chr(39)||'no'||chr(39)||chr(10)||'order: \"3\"'||chr(10)",
)
_BLOCK = "CASE doc_id%7 " + " ".join(f"WHEN {k} THEN '---'||chr(10)||{f}||'---'||chr(10)" for k, f in enumerate(_FORMS)) + " ELSE '' END"
_CLEAN = r"regexp_replace(regexp_replace(text,'^[ \t\n\x0b\f\r]+',''),'[ \t\n\x0b\f\r]+$','')"


@query("pr01_pr02_pr10_pr13_whole_pages", rf"""WITH r AS (SELECT *, doc_id%7 AS f, regexp_replace(replace({_CLEAN},chr(13)||chr(10),chr(10)),'\n{{3,}}',chr(10)||chr(10),'g') AS t FROM documents),
 d AS (SELECT doc_id, f, 'src/'||source||'/p'||doc_id AS slug, CASE f WHEN 0 THEN 'Page '||doc_id||chr(10)||'two' WHEN 1 THEN 'Page "'||doc_id||'"' WHEN 2 THEN 'Page '||doc_id||chr(10) WHEN 3 THEN 'Page '||doc_id ELSE 'Head '||doc_id END AS title,
  try_cast('2024-02-'||lpad(CAST(20+doc_id%12 AS varchar),2,'0') AS date) AS day, 'See other pages '||doc_id||'.' AS description, '# Head '||doc_id||chr(10)||chr(10)||'See [other](../x/y.md#z) [pages](https://h.org/'||doc_id||') '||doc_id||'.'||chr(10)||chr(10)||t AS b0 FROM r),
 b AS (SELECT *, regexp_replace(b0,'[ \t\n\x0b\f\r]+$','')||chr(10) AS body FROM d)
 SELECT doc_id, slug, '/'||slug AS route, CASE WHEN f=3 THEN 'blog' ELSE 'documentation' END AS kind, title, CASE f WHEN 1 THEN doc_id%9 WHEN 2 THEN 10 ELSE 0 END::DOUBLE AS page_order, CASE WHEN f=3 THEN strftime(day,'%Y-%m-%d') END AS date, CASE WHEN f=3 THEN 'Ann' END AS author,
  f=5 AS protected, CASE WHEN f=2 THEN 'a'||doc_id||'|b # c' END AS aliases, CASE WHEN f=5 THEN 'no' END AS locale, CASE f WHEN 2 THEN 'order=10.0' WHEN 3 THEN 'author=" Ann ";date="2024-02-'||lpad(CAST(20+doc_id%12 AS varchar),2,'0')||'";kind="blog"' WHEN 4 THEN 'order=null' WHEN 5 THEN 'deep={{"in": [{{"k": 1, "l": 2}}]}};order="3";tags=["x", "y"]' ELSE '' END AS unknown,
  CASE f WHEN 3 THEN 'repeated key title' WHEN 4 THEN 'a value without an end' END AS problem, description, 'other>src/x/y|pages>' AS links, substr(sha256(body),1,16) AS body_hash FROM b""")
def _whole_pages(spark, d):
    head = "'# Head '||doc_id||chr(10)||chr(10)||'See [other](../x/y.md#z) [pages](https://h.org/'||doc_id||') '||doc_id||'.'||chr(10)||chr(10)"
    raw = f"{_BLOCK.replace('varchar(9)', 'string')}||{head}||{_CLEAN.replace(chr(92), chr(92) * 2)}"
    docs = table(spark, d, "documents").select("doc_id", F.expr("'src/'||source||'/p'||doc_id||'.md'").alias("path"), F.expr(raw).alias("raw"))
    p = pages.normalize_pages(docs, "path", "raw")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("unknown")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    # the texts may hold links too: the first two are the query's own
    links = F.array_join(F.transform(F.slice("links", 1, 2), lambda x: F.concat(x["text"], F.lit(">"), F.coalesce(x["target"], F.lit("")))), "|")
    return p.select(
        "doc_id", "slug", "route", "kind", "title", "page_order", "date", "author", "protected", F.array_join("aliases", "|").alias("aliases"), "locale", pairs.alias("unknown"), "problem",
        "description", links.alias("links"), X.hash16("body").alias("body_hash"),
    )


@query("pr23_locks", """WITH t AS (SELECT p_partkey, p_size AS a, p_size+27+length(p_name) AS b, p_partkey%2=0 AS two FROM part)
 SELECT p_partkey, 1::BIGINT AS ordinal, a::BIGINT AS "start", b::BIGINT AS "end" FROM t UNION ALL SELECT p_partkey, 2, b+1, b+30 FROM t WHERE two""")
def _locks(spark, d):
    raw = F.expr("repeat('x',p_size)||'<!-- lock -->'||p_name||'<!-- /lock -->y<!-- lock -->'||CASE WHEN p_partkey%2=0 THEN 'zz<!-- /lock -->' ELSE '' END")
    return frontmatter.locked_regions(table(spark, d, "part").withColumn("raw", raw), "p_partkey", "raw")


_SLUG = "'n'||s_nationkey||'/s'||s_suppkey"


def _planned(spark, d):
    s = table(spark, d, "supplier")
    pages = s.select(F.expr(_SLUG).alias("slug"), F.col("s_name").alias("title"), F.expr("'n'||s_nationkey").alias("section_id"))
    nav = s.filter("s_suppkey % 10 = 0").select(F.expr(_SLUG).alias("slug"), F.col("s_suppkey").alias("position"))
    sections = table(spark, d, "nation").filter("n_regionkey < 4").select(F.expr("'n'||n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return output_plan.planned_pages(pages, nav, sections)


@query("pr52_st10_xp11_plan", f"""SELECT {_SLUG} AS slug, s_name AS title, CASE WHEN n_regionkey<4 THEN n_name ELSE 'n'||s_nationkey END AS section_title, '/docs/'||{_SLUG} AS route,
 {_SLUG}||'.mdx' AS md_path, {_SLUG}||'/index.html' AS static_path, CASE WHEN s_suppkey%10=0 THEN s_suppkey END::BIGINT AS nav FROM supplier JOIN nation ON n_nationkey=s_nationkey""")
def _plan(spark, d):
    return output_plan.in_plan_order(_planned(spark, d)).drop("section_id")


_PAIRS = f"(SELECT a.s_suppkey AS k, 'n'||a.s_nationkey AS an, {_SLUG.replace('s_', 'a.s_')} AS source, 'n'||b.s_nationkey AS bn, 's'||b.s_suppkey AS bs, {_SLUG.replace('s_', 'b.s_')} AS target FROM supplier a JOIN supplier b ON b.s_suppkey=a.s_suppkey+1)"


def _pairs(spark, d):
    s = table(spark, d, "supplier")
    b = s.select((F.col("s_suppkey") - 1).alias("k"), F.expr(_SLUG).alias("target"))
    return s.select(F.col("s_suppkey").alias("k"), F.expr(_SLUG).alias("source")).join(b, "k")


@query("jn05_document_links", f"""SELECT source, target, '/docs/'||target AS next, CASE WHEN an=bn THEN bs||'.mdx' ELSE '../'||bn||'/'||bs||'.mdx' END AS markdown,
 CASE WHEN an=bn THEN '../'||bs||'/' ELSE '../../'||bn||'/'||bs||'/' END AS static FROM {_PAIRS} UNION ALL SELECT {_SLUG}, 'nowhere', NULL, NULL, NULL FROM supplier""")
def _document_links(spark, d):
    planned = _planned(spark, d)
    links = _pairs(spark, d).drop("k").unionByName(table(spark, d, "supplier").select(F.expr(_SLUG).alias("source"), F.lit("nowhere").alias("target")))
    for r in ("next", "markdown", "static"):
        links = output_plan.document_links(links, planned, r).withColumnRenamed("href", r)
    return links


@query("jn04_content_links", f"""SELECT source, url, CASE WHEN k%6<3 THEN '/docs/'||target||suffix END AS next, CASE WHEN k%6<3 THEN CASE WHEN an=bn THEN bs||'.mdx' ELSE '../'||bn||'/'||bs||'.mdx' END||suffix END AS markdown FROM (
 SELECT *, CASE k%6 WHEN 0 THEN '../'||target||'.md#top' WHEN 1 THEN '/docs/'||target||'?q=1' WHEN 2 THEN '/'||target||'/' WHEN 3 THEN 'https://x.org/'||target WHEN 4 THEN '#'||target ELSE '../'||target||'.png' END AS url,
 CASE k%6 WHEN 0 THEN '#top' WHEN 1 THEN '?q=1' ELSE '' END AS suffix FROM {_PAIRS})""")
def _content_links(spark, d):
    url = F.expr("CASE k%6 WHEN 0 THEN '../'||target||'.md#top' WHEN 1 THEN '/docs/'||target||'?q=1' WHEN 2 THEN '/'||target||'/' WHEN 3 THEN 'https://x.org/'||target WHEN 4 THEN '#'||target ELSE '../'||target||'.png' END")
    links, planned = _pairs(spark, d).select("source", url.alias("url")), _planned(spark, d)
    for r in ("next", "markdown"):
        links = output_plan.content_links(links, planned, r).withColumnRenamed("href", r).drop("target")
    return links


_KINDS = "['prerequisite','nextStep','relatedTo','complements']"
_LINKS = f"(SELECT p_partkey AS n, p_partkey//10*10 AS ten, p_partkey AS src, p_partkey//10*10+(p_partkey*k+p_size)%10 AS dst, {_KINDS}[(p_size*k)%4+1] AS kind, p_size/50.0 AS weight FROM part, (VALUES (3),(7)) v(k))"


def _links(spark, d):
    p = table(spark, d, "part").withColumn("k", F.explode(F.array(F.lit(3), F.lit(7))))
    kinds = F.array(*[F.lit(x) for x in ("prerequisite", "nextStep", "relatedTo", "complements")])
    ten = F.floor(F.col("p_partkey") / 10) * 10
    return p.select(
        F.col("p_partkey").alias("n"), F.col("p_partkey").alias("src"), (ten + (F.col("p_partkey") * F.col("k") + F.col("p_size")) % 10).alias("dst"),
        F.element_at(kinds, (F.col("p_size") * F.col("k") % 4 + 1).cast("int")).alias("kind"), (F.col("p_size") / 50.0).alias("weight"),
    )


_GROWN = """p AS (SELECT kind, src AS s, dst AS t, [src,dst] AS path FROM e WHERE src<dst UNION ALL SELECT p.kind, p.s, e.dst, list_append(p.path,e.dst) FROM p JOIN e ON e.src=p.t AND e.kind=p.kind WHERE e.dst>p.s AND NOT list_contains(p.path,e.dst))
 SELECT p.kind, CASE p.kind WHEN 'relatedTo' THEN 'soft' ELSE 'hard' END AS severity, array_to_string(path,'>') AS cycle FROM p JOIN e ON e.src=p.t AND e.dst=p.s AND e.kind=p.kind"""


@query("gr17_relation_cycles", f"""WITH RECURSIVE l AS {_LINKS}, e AS (SELECT DISTINCT kind, src, dst FROM l WHERE src<>dst AND kind IN ('prerequisite','nextStep')
 UNION SELECT 'relatedTo', src, dst FROM l WHERE src<>dst AND kind NOT IN ('prerequisite','nextStep') UNION SELECT 'relatedTo', dst, src FROM l WHERE src<>dst AND kind NOT IN ('prerequisite','nextStep')), {_GROWN}""")
def _relation_cycles(spark, d):
    found = relations.relation_cycles(_links(spark, d), ["prerequisite", "nextStep"])
    return found.select("kind", "severity", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("cycle"))


@query("dd09_relations_once", f"SELECT src, dst, kind, min(weight)::DOUBLE AS weight, min(n) AS n FROM {_LINKS} GROUP BY 1,2,3")
def _relations_once(spark, d):
    once = relations.dedupe_relations(_links(spark, d), ["src", "dst", "kind"], "n")
    return once.select("src", "dst", "kind", F.col("weight").cast("double").alias("weight"), "n")


@query("gr23_neighbours", f"WITH l AS {_LINKS}, b AS (SELECT src AS node, dst AS other FROM l UNION SELECT dst, src FROM l) SELECT node, other FROM b WHERE other IN (SELECT p_partkey FROM part WHERE p_size%2=0)")
def _neighbours(spark, d):
    return relations.neighbours(_links(spark, d), table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("node")))


@query("xc06_first_neighbours", f"""WITH l AS {_LINKS}, b AS (SELECT src AS node, dst AS other FROM l UNION SELECT dst, src FROM l) SELECT node, other FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY other) AS r FROM b WHERE other IN (SELECT p_partkey FROM part)) WHERE r<=3""")
def _first_neighbours(spark, d):
    return relations.neighbours(_links(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node")), limit=3)


@query("st05_related_pages", f"""SELECT dst, kind, row_number() OVER (ORDER BY weight DESC, kind, dst) AS rank FROM (SELECT src, dst, kind, max(weight) AS weight FROM {_LINKS} WHERE kind<>'complements' GROUP BY 1,2,3) WHERE src=57""")
def _related_pages(spark, d):
    r = _links(spark, d).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight")).withColumn("confidence", F.lit(1.0)).withColumn("label", F.col("kind"))
    return relations.related_pages(r, F.lit(57), ["complements"]).select("dst", "kind", "rank")


@query("ag17_relation_counts", f"""WITH l AS {_LINKS}, p AS (SELECT p_partkey AS slug FROM part WHERE p_size%3>0) SELECT (SELECT count(*) FROM l) AS relations, (SELECT count(DISTINCT kind) FROM l) AS kinds,
 (SELECT count(*) FROM p WHERE slug NOT IN (SELECT src FROM l UNION SELECT dst FROM l)) AS orphans, (SELECT count(*) FROM l WHERE dst NOT IN (SELECT slug FROM p)) AS broken""")
def _relation_counts(spark, d):
    return relations.relation_counts(_links(spark, d), table(spark, d, "part").filter("p_size % 3 > 0").select(F.col("p_partkey").alias("slug")))


@query("ag15_health", """SELECT c_nationkey, floor((n-stale)*100.0/n+0.5)::BIGINT AS freshness, floor((n-bad)*100.0/n+0.5)::BIGINT AS consistency, 100::BIGINT AS coverage FROM
 (SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_mktsegment='BUILDING') AS stale, count(*) FILTER (c_acctbal<0) AS bad FROM customer GROUP BY 1)""")
def _health(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("stale"), F.count_if(F.col("c_acctbal") < 0).alias("bad"))
    return c.select("c_nationkey", *relations.health(F.col("n"), F.col("stale"), F.col("bad")))


@query("wn11_repeated_symbols", """SELECT file, ordinal, name, CASE WHEN name='' THEN 'unnamed-symbol' ELSE 'duplicate-symbol' END AS code FROM (SELECT *, lag(parent) OVER w AS last, row_number() OVER w AS r FROM
 (SELECT l_orderkey AS file, l_linenumber AS ordinal, CASE l_suppkey%4 WHEN 0 THEN '' ELSE 's'||(l_suppkey%4) END AS name, l_returnflag AS parent FROM lineitem) WINDOW w AS (PARTITION BY file, name ORDER BY ordinal, parent)) WHERE name='' OR (r>1 AND last=parent)""")
def _repeated_symbols(spark, d):
    name = F.expr("CASE l_suppkey%4 WHEN 0 THEN '' ELSE 's'||(l_suppkey%4) END")
    return relations.repeated_symbols(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ordinal"), name.alias("name"), F.col("l_returnflag").alias("parent")))


@query("fl08_symbols", "SELECT p_partkey FROM part WHERE p_type IN ('STANDARD','PROMO') AND p_size%2=0 AND regexp_matches(p_name,'^[a-m]')")
def _symbols(spark, d):
    s = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("kind"), (F.col("p_size") % 2 == 0).alias("exported"), F.col("p_name").alias("name"))
    return s.filter(relations.symbol_matches(kinds=["STANDARD", "PROMO"], exported=True, pattern="^[a-m]")).select("p_partkey")


@query("fl11_changes_on_paths", """SELECT o_orderkey, path, old_path FROM (SELECT o_orderkey, 'f'||o_custkey AS path, CASE WHEN o_orderkey%3=0 THEN 'f'||(o_custkey+1) END AS old_path FROM orders) WHERE path IN (SELECT 'f'||c_custkey FROM customer WHERE c_acctbal<0) OR old_path IN (SELECT 'f'||c_custkey FROM customer WHERE c_acctbal<0)""")
def _on_paths(spark, d):
    changes = table(spark, d, "orders").select("o_orderkey", F.expr("'f'||o_custkey").alias("path"), F.expr("CASE WHEN o_orderkey%3=0 THEN 'f'||(o_custkey+1) END").alias("old_path"))
    return relations.on_paths(changes, table(spark, d, "customer").filter("c_acctbal < 0").select(F.expr("'f'||c_custkey").alias("path")))


@query("df13_reconcile", """SELECT o_orderpriority AS bucket, path, CASE WHEN o_orderkey%2=0 OR path LIKE '%.json' THEN 'remove' ELSE 'keep' END AS action FROM (SELECT *, 'p'||o_orderkey||CASE WHEN o_orderkey%3=0 THEN '.json' ELSE '.md' END AS path FROM orders) WHERE o_custkey%5>0 AND o_orderstatus<>'F'""")
def _reconcile(spark, d):
    o = table(spark, d, "orders").withColumn("path", F.expr("'p'||o_orderkey||CASE WHEN o_orderkey%3=0 THEN '.json' ELSE '.md' END")).withColumn("bucket", F.col("o_orderpriority"))
    previous = o.select("bucket", "path", (F.col("o_custkey") % 5 > 0).alias("exists"), (F.col("o_orderkey") % 2 == 0).alias("generated"))
    return relations.reconcile(previous, o.filter("o_orderstatus = 'F'").select("bucket", "path"))


@query("gr18_alphabetical_order")
def _alphabetical(spark, d):
    p = table(spark, d, "part").withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))))
    e = p.filter("p_size % k < 2").select(F.floor(F.col("p_partkey") / F.col("k")).alias("src"), F.col("p_partkey").alias("dst"), F.lit("prerequisite").alias("kind"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_partkey").alias("ordinal"))
    return relations.alphabetical_order(nodes, graph.dependency_edges(nodes, e))
