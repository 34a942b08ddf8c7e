"""Scalar functions and parsing projections over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import paths as P
from tessella.functions import text as X
from tessella.operators import markdown, pages
from tessella.plans.registry import query, table

STRIP = r"regexp_replace(regexp_replace({0},'^\s+',''),'\s+$','')"
SQL_MD = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '<script[^>]*>[\s\S]*?</script>','','g'),'<h1[^>]*>(.*?)</h1>',chr(10)||'# \1'||chr(10)||chr(10),'g'),
 '<a\s+href="([^"]*)"[^>]*>([^<]*)</a>','[\2](\1)','g'),'<p>',chr(10)||chr(10),'g'),'<[^>]+>','','g')"""


def page_markdown(spark, d):
    """The pages table as Markdown: an input for the Markdown operators, not an operator itself."""
    html = F.col("html")
    for pattern, by in (
        (r"<script[^>]*>[\s\S]*?</script>", ""),
        ("<h1[^>]*>(.*?)</h1>", "\n# $1\n\n"),
        (r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>', "[$2]($1)"),
        ("<p>", "\n\n"),
        ("<[^>]+>", ""),
    ):
        html = F.regexp_replace(html, pattern, by)
    return table(spark, d, "pages").select("page_id", "url", html.alias("md"))


@query("sf01_strip_html", r"""SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM (SELECT page_id,
 trim(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),'\s+',' ','g')) AS t FROM pages)""")
def _strip_html(spark, d):
    t = table(spark, d, "pages").select("page_id", X.strip_html("html").alias("t"))
    return t.select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("long").alias("n_chars"))


@query("sf02_truncate", """SELECT doc_id, CASE WHEN length(text)<=120 THEN text
 WHEN strpos(h,' ')>0 AND length(h)-strpos(reverse(h),' ')>0 THEN substr(h,1,length(h)-strpos(reverse(h),' ')) ELSE h END AS short
 FROM (SELECT doc_id, text, substr(text,1,120) AS h FROM documents)""")
def _truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_words("text", 120).alias("short"))


_E = "replace(replace(replace(replace({0},'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;')"


@query("sf03_escape", f"""SELECT page_id, sha256(replace({_E.format('html')},'''','&#39;')) AS as_html,
 sha256(replace({_E.format('html')},'''','&apos;')) AS as_xml, replace({_E.format('url')},'''','&#39;') AS as_attribute FROM pages""")
def _escape(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.sha2(X.escape_html("html"), 256).alias("as_html"), F.sha2(X.escape_xml("html"), 256).alias("as_xml"),
        X.escape_html("url").alias("as_attribute"),
    )


def _sql_redact(c):
    for p in X.SECRET_PATTERNS:
        c = f"regexp_replace({c},'{p}','{X.REDACTED}','g')"
    return c


@query("sf05_redact", f"SELECT doc_id, sha256(r) AS redacted_hash, r <> text AS changed FROM (SELECT doc_id, text, {_sql_redact('text')} AS r FROM documents)")
def _redact(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", X.redact("text").alias("r"))
    return t.select("doc_id", F.sha2("r", 256).alias("redacted_hash"), (F.col("r") != F.col("text")).alias("changed"))


@query("sf06_secret_names", f"""SELECT doc_id, regexp_matches(text,'{X.SECRET_ENV_NAMES}') AS env, regexp_matches(text,'{X.SECRET_CONFIG_KEYS}') AS config,
 CASE WHEN regexp_matches(lang,'{X.SECRET_CONFIG_KEYS}') AND length(source)>0 THEN '[REDACTED]' ELSE source END AS shown FROM documents""")
def _secret_names(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.is_secret_env_name("text").alias("env"), X.is_secret_config_key("text").alias("config"),
        X.sanitize_config_value("lang", "source").alias("shown"),
    )


_SEM = r"""array_to_string(list_filter(list_transform(list_filter(string_split_regex(regexp_replace({0},'/\*[\s\S]*?\*/','','g'),'\r?\n'),
 lambda l: NOT (regexp_matches(l,'^[^"'']*//') AND len(regexp_extract_all(l,'["''`]'))%2=0)), lambda l: regexp_replace(regexp_replace(l,'^\s+',''),'\s+$','')),
 lambda l: l<>''), chr(10))"""


@query("sf07_sf10_sf13_hashes", f"""SELECT doc_id, substr(sha256(text),1,16) AS hash16, sha1(text) AS sha1, substr(sha256({_SEM.format('text')}),1,16) AS semantic FROM documents""")
def _hashes(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.hash16("text").alias("hash16"), F.sha1("text").alias("sha1"), X.semantic_hash("text").alias("semantic")
    )


@query("sf08_hash_files", """SELECT source, substr(sha256(string_agg(doc_id::VARCHAR||':'||text, chr(10) ORDER BY doc_id::VARCHAR)),1,16) AS combined FROM documents WHERE source IS NOT NULL GROUP BY source""")
def _hash_files(spark, d):
    return pages.combined_hash(table(spark, d, "documents").filter("source is not null"), "source", F.col("doc_id").cast("string"), F.col("text"))


_FNV = "lower(lpad(printf('%X', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0},''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h,c)*16777619)&4294967295)),8,'0'))"


@query("sf09_sf32_fnv_ids", f"SELECT p_partkey, {_FNV.format('p_name')} AS fnv, 'part:'||{_FNV.format(chr(40)+chr(112)+'_name||'+chr(39)+'|'+chr(39)+'||p_brand)')} AS stable_id FROM part")
def _fnv(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fnv1a32("p_name").alias("fnv"), X.stable_id("part", "p_name", "p_brand").alias("stable_id"))


@query("sf12_strip_semantics", f"SELECT conv_id, turn, {_SEM.format('t')} AS code FROM (SELECT conv_id, turn, replace(text,'. ','.'||chr(10)||'  // note'||chr(10)||'/* x */ ') AS t FROM conversations)")
def _semantics(spark, d):
    t = F.replace("text", F.lit(". "), F.lit(".\n  // note\n/* x */ "))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_semantics(t).alias("code"))


_H1 = r"regexp_extract(html,'<h1>([\s\S]*?)</h1>',1)"


@query("sf14_slugify", rf"""SELECT page_id, regexp_replace(regexp_replace({STRIP.format('lower(t)')},'[^\w\s-]','','g'),'\s+','-','g') AS heading,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t),'[^\w\s-]','','g'),'[\s_]+','-','g'),'^-+',''),'-+$','') AS file,
 regexp_replace(regexp_replace(regexp_replace(lower(t),'[^a-z0-9]+','-','g'),'^-+',''),'-+$','') AS page FROM (SELECT page_id, {_H1} AS t FROM pages)""")
def _slugify(spark, d):
    t = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"<h1>([\s\S]*?)</h1>", 1).alias("t"))
    return t.select("page_id", X.slugify_heading("t").alias("heading"), X.slugify_file("t").alias("file"), X.slugify_page("t").alias("page"))


_CAP = "upper(substr(w,1,1))||substr(w,2)"


@query("sf15_titles", f"""SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(s,'[-_]+'), lambda w: w<>''), lambda w: CASE WHEN regexp_full_match(w,'[A-Z0-9]+') THEN w ELSE {_CAP} END),' ') AS title_case,
 array_to_string(list_transform(string_split_regex(s,'[-_]'), lambda w: {_CAP}),' ') AS titleized, upper(substr(s,1,1))||substr(s,2) AS capitalized
 FROM (SELECT p_partkey, replace(p_name,' ','-')||'_'||p_type||'--'||p_size AS s FROM part)""")
def _titles(spark, d):
    s = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_type"), F.lit("--"), F.col("p_size"))
    t = table(spark, d, "part").select("p_partkey", s.alias("s"))
    return t.select("p_partkey", X.title_case("s").alias("title_case"), X.titleize("s").alias("titleized"), X.capitalize("s").alias("capitalized"))


_URLPATH = r"regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','')"


def _url_path():
    return F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")


@query("sf16_sf17_paths", rf"""SELECT page_id, regexp_extract(p,'[^/]*$') AS base, CASE WHEN strpos(p,'/')=0 THEN '.' ELSE regexp_replace(p,'/[^/]*$','') END AS dir,
 lower(regexp_extract(regexp_extract(p,'[^/]*$'),'.(\.[^.]+)$',1)) AS ext, CASE WHEN strpos(p,'/')=0 THEN '' ELSE regexp_extract(p,'^[^/]*') END AS top FROM (SELECT page_id, {_URLPATH} AS p FROM pages)""")
def _paths(spark, d):
    t = table(spark, d, "pages").select("page_id", _url_path().alias("p"))
    return t.select("page_id", P.basename("p").alias("base"), P.dirname("p").alias("dir"), P.extension("p").alias("ext"), P.top_dir("p").alias("top"))


@query("sf16_pr14_resolve")
def _resolve(spark, d):
    t = table(spark, d, "pages").select("page_id", F.col("url"), _url_path().alias("p"))
    up = F.concat(F.lit("../x/./"), F.col("page_id"), F.lit("/index.md#part"))
    return t.select("page_id", P.resolve_target(P.dirname("p"), up).alias("target"), P.relative_path(P.dirname("p"), F.lit("docs/a/b.md")).alias("relative"),
                    P.normalize_path(F.concat("p", F.lit("/.././y"))).alias("normal"), P.is_within(F.lit("blog"), "p").alias("inside"))


@query("sf18_sr13_file_kinds", """SELECT p_partkey, coalesce(map_extract(MAP {'.ts':'typescript','.py':'python','.md':'markdown','.json':'json','.css':'css'}, ext)[1],'unknown') AS language,
 CASE WHEN base='package.json' THEN 'manifest' WHEN base='tsconfig.json' THEN 'config' WHEN ext='.md' THEN 'documentation' WHEN ext='.png' THEN 'asset' ELSE 'source' END AS kind
 FROM (SELECT p_partkey, ['package.json','tsconfig.json','a.md','b.png','c.ts','d.py','e.css','f'][p_partkey%8+1] AS base,
 ['.json','.json','.md','.png','.ts','.py','.css',''][p_partkey%8+1] AS ext FROM part)""")
def _file_kinds(spark, d):
    names = F.array(*[F.lit(x) for x in ("package.json", "tsconfig.json", "a.md", "b.png", "c.ts", "d.py", "e.css", "f")])
    path = F.concat(F.lit("src/"), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", P.language_of(path).alias("language"), P.file_kind(path).alias("kind"))


@query("sf19_examples", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(t,chr(13)||chr(10),chr(10)),'(?m)[ \t]+$','','g'),'\n{3,}',chr(10)||chr(10),'g'),'^\n+',''),'\s+\z','') AS body
 FROM (SELECT conv_id, turn, chr(10)||replace(text,'.','.  '||chr(10)||chr(10)||chr(10)||chr(10)) AS t FROM conversations)""")
def _examples(spark, d):
    t = F.concat(F.lit("\n"), F.replace("text", F.lit("."), F.lit(".  \n\n\n\n")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_example(t).alias("body"))


@query("sf19_dedent", """SELECT conv_id, turn, text AS body FROM conversations WHERE role = 'user'""")
def _dedent(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'")
    indented = F.concat(F.lit("   "), F.replace("text", F.lit("\n"), F.lit("\n   ")))
    return t.select("conv_id", "turn", X.dedent_example(indented).alias("body"))


_SPEC = "CASE p_partkey%6 WHEN 0 THEN '@'||lower(p_type)||'/'||p_size||'/x' WHEN 1 THEN './'||p_name WHEN 2 THEN '#'||p_name WHEN 3 THEN lower(p_type)||'/sub' WHEN 4 THEN '' ELSE '@solo' END"


def _specifiers(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", f"{_SPEC} AS s")


@query("sf21_sr17_specifiers", f"""SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN '@'||lower(p_type)||'/'||p_size WHEN 3 THEN lower(p_type) END AS package,
 CASE p_partkey%6 WHEN 0 THEN 'package' WHEN 1 THEN 'module' WHEN 3 THEN CASE WHEN lower(p_type)='economy' THEN 'workspace' ELSE 'package' END ELSE 'unknown' END AS class FROM part""")
def _packages(spark, d):
    return _specifiers(spark, d).select("p_partkey", X.package_name("s").alias("package"), X.classify_specifier("s", ["economy"]).alias("class"))


@query("sf20_sf29_small", """SELECT o_orderkey, lower(regexp_extract(o_orderpriority,'^[^\\s]+')) AS language, greatest(0e0, least(1e0, o_totalprice/2e5-5e-1)) AS clamped FROM orders""")
def _small(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.language_from_info("o_orderpriority").alias("language"), X.clamp(F.col("o_totalprice") / 200000.0 - 0.5).alias("clamped"))


@query("sf22_versions", """WITH v AS (SELECT p_partkey, p_size AS a, p_partkey%10 AS b FROM part) SELECT p_partkey, a||'.'||b||'.3' AS version, CASE WHEN (a, b, 3)<(25, 4, 3) THEN -1 ELSE 1 END AS "order",
 a=25 AS caret, a=25 AND b=4 AS tilde, a>=30 AS least, a=7 AND b=7 AS exact, false AS wrong FROM v""")
def _versions(spark, d):
    v = F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 10, F.lit(3))
    return table(spark, d, "part").select(
        "p_partkey", v.alias("version"), X.compare_versions(v, F.lit("25.4.3-beta")).alias("order"),
        *[X.satisfies_version(v, F.lit(r)).alias(n) for n, r in (("caret", "^25.0.0"), ("tilde", "~25.4"), ("least", ">=30"), ("exact", "7.7.3"), ("wrong", ">x"))],
    )


@query("sf23_exports", """SELECT p_partkey, replace(p_name,' ','_')||',alias'||p_size||',plain' AS names FROM part""")
def _exports(spark, d):
    src = F.concat(F.lit("export async function "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("() {}\nexport { inner as alias"), F.col("p_size"), F.lit(", plain } from 'x';"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.export_names(src), ",").alias("names"))


@query("sf24_sf25_links", rf"""SELECT page_id, u.t AS target, regexp_replace(regexp_replace(regexp_replace(u.t,'^/+',''),'/+$',''),'(?i)\.(md|mdx)$','') AS normal
 FROM (SELECT page_id, unnest(regexp_extract_all({SQL_MD},'\[[^\]]*\]\(([^)]+)\)',1)) AS t FROM pages) u""")
def _links(spark, d):
    t = page_markdown(spark, d).select("page_id", F.explode(X.markdown_targets("md")).alias("target"))
    return t.select("page_id", "target", X.normalize_target("target").alias("normal"))


@query("sf26_sf28_reading", r"""SELECT doc_id, w AS words, greatest(1, ceil(w/200.0))::BIGINT AS minutes, ceil(length(text)/4.0)::BIGINT AS tokens
 FROM (SELECT doc_id, text, len(list_filter(string_split_regex(text,'\s+'), lambda x: x<>''))::BIGINT AS w FROM documents)""")
def _reading(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"), X.token_estimate("text").alias("tokens"))
    return t.select("doc_id", "words", X.reading_minutes("words").alias("minutes"), "tokens")


@query("sf30_calendar", """SELECT o_orderkey, d, coalesce(strftime(try_cast(d AS DATE),'%Y-%m-%d')=d, false) AS valid FROM (SELECT o_orderkey,
 CASE o_orderkey%4 WHEN 0 THEN strftime(o_orderdate,'%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate,'%Y')||'-02-30' WHEN 2 THEN '2026-13-99' ELSE strftime(o_orderdate,'%Y-%m-%d')||'x' END AS d FROM orders)""")
def _calendar(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, day).when(k == 1, F.concat(F.substring(day, 1, 4), F.lit("-02-30"))).when(k == 2, "2026-13-99").otherwise(F.concat(day, F.lit("x")))
    return table(spark, d, "orders").select("o_orderkey", text.alias("d"), X.is_calendar_date(text).alias("valid"))


@query("sf33_sf34_signatures", """SELECT p_partkey, 'function:'||p_name||'(a:'||p_brand||',b:number?):Promise<'||p_type||'>' AS signature, 'Promise,'||p_type AS refs FROM part""")
def _signatures(spark, d):
    t = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("Promise<"), "p_type", F.lit(">")).alias("return_type"),
        F.array(F.struct(F.lit("a").alias("name"), F.col("p_brand").alias("type"), F.lit(True).alias("required")),
                F.struct(F.lit("b").alias("name"), F.lit("number").alias("type"), F.lit(False).alias("required"))).alias("parameters"),
    )
    return t.select("p_partkey", pages.signature().alias("signature"), F.array_join(X.type_references("return_type"), ",").alias("refs"))


@query("pr01_normalize", r"""SELECT doc_id, source||'/'||lang||'-page/'||doc_id AS slug, '/'||source||'/'||lang||'-page/'||doc_id AS route, CASE WHEN source='src1' THEN 'blog' ELSE 'documentation' END AS kind,
 doc_id::VARCHAR AS title, substr(sha256(b),1,16) AS body_hash, w AS word_count, greatest(1,ceil(w/200.0))::BIGINT AS minutes FROM (SELECT *, len(list_filter(string_split_regex(b,'\s+'), lambda x: x<>''))::BIGINT AS w FROM (
 SELECT doc_id, source, lang, regexp_replace(regexp_replace(regexp_replace(replace(text,chr(13)||chr(10),chr(10)),'\n{3,}',chr(10)||chr(10),'g'),'^\s+',''),'\s+$','')||chr(10) AS b FROM documents))""")
def _normalize(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("-page/"), "doc_id", F.lit(".md")).alias("path"), "text")
    return pages.normalize_documents(t, "path", "text", blog_dir="src1").select(
        "doc_id", "slug", "route", "kind", "title", X.hash16("body").alias("body_hash"), "word_count", "minutes"
    )


@query("pr09_description", r"""SELECT doc_id, CASE WHEN length(t)<=160 THEN t ELSE regexp_replace(CASE WHEN strpos(h,' ')>0 AND length(h)-strpos(reverse(h),' ')>=80 THEN substr(h,1,length(h)-strpos(reverse(h),' ')) ELSE h END,'\s+$','') END AS description
 FROM (SELECT *, substr(t,1,160) AS h FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(text,chr(10))[1],'`([^`]*)`','\1','g'),
 '!\[([^\]]*)\]\([^)]*\)','\1','g'),'\[([^\]]*)\]\([^)]*\)','\1','g'),'[#*_~\[\]()>]','','g'),'^\s+',''),'\s+$','') AS t FROM documents))""")
def _description(spark, d):
    return table(spark, d, "documents").select("doc_id", X.describe(F.element_at(F.split("text", "\n"), 1)).alias("description"))


@query("pr20_pr12_tones", """SELECT conv_id, turn, CASE WHEN starts_with(lower(t),'warning') THEN 'warning' WHEN starts_with(lower(t),'deprecated') THEN 'deprecated' WHEN starts_with(lower(t),'tip') THEN 'tip' ELSE 'note' END AS tone
 FROM (SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN 'Warning: ' WHEN 1 THEN 'DEPRECATED ' WHEN 2 THEN 'tip ' ELSE '' END||text AS t FROM conversations)""")
def _tones(spark, d):
    k = F.col("turn") % 4
    t = F.concat(F.when(k == 0, "Warning: ").when(k == 1, "DEPRECATED ").when(k == 2, "tip ").otherwise(""), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", X.callout_tone(t).alias("tone"))


@query("pr25_html_headings", r"""SELECT page_id, i AS ordinal, levels[i]::INT AS level, ids[i] AS id, trim(regexp_replace(texts[i],'<[^>]+>','','g')) AS text FROM (
 SELECT page_id, regexp_extract_all(h,'<h([1-6])\s+(?:id="([^"]*)")?[^>]*>([\s\S]*?)</h[1-6]>',1) AS levels, regexp_extract_all(h,'<h([1-6])\s+(?:id="([^"]*)")?[^>]*>([\s\S]*?)</h[1-6]>',2) AS ids,
 regexp_extract_all(h,'<h([1-6])\s+(?:id="([^"]*)")?[^>]*>([\s\S]*?)</h[1-6]>',3) AS texts FROM (SELECT page_id, replace(html,'<h1>','<h1 id="top" class="t">') AS h FROM pages)), unnest(range(1,len(levels)+1)) AS r(i)""")
def _headings(spark, d):
    t = table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<h1>"), F.lit('<h1 id="top" class="t">')).alias("html"))
    return pages.html_headings(t, "page_id", "html")


@query("pr26_html_links", r"""SELECT page_id, i AS ordinal, urls[i] AS url, trim(regexp_replace(texts[i],'<[^>]+>','','g')) AS text, regexp_matches(urls[i],'^(https?|mailto):') AS is_external FROM (
 SELECT page_id, regexp_extract_all(html,'<a\s+href="([^"]*)"[^>]*>([\s\S]*?)</a>',1) AS urls, regexp_extract_all(html,'<a\s+href="([^"]*)"[^>]*>([\s\S]*?)</a>',2) AS texts FROM pages), unnest(range(1,len(urls)+1)) AS r(i)""")
def _html_links(spark, d):
    return pages.html_links(table(spark, d, "pages"), "page_id", "html")


@query("pr27_title", rf"""SELECT page_id, CASE WHEN t='' THEN 'Untitled' ELSE t END AS title FROM (SELECT page_id, regexp_extract({SQL_MD},'(?m)^#\s+(.+)$',1) AS t FROM pages)""")
def _title(spark, d):
    return page_markdown(spark, d).select("page_id", X.markdown_title("md").alias("title"))


@query("pr28_markdown_description")
def _md_description(spark, d):
    return page_markdown(spark, d).select("page_id", X.markdown_description("md").alias("description"))


@query("pr29_toc")
def _toc(spark, d):
    t = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<p>([A-Z][a-z]+)", '<h2 id="$1">$1</h2><p>$1').alias("html"))
    return pages.table_of_contents(pages.html_headings(t, "page_id", "html"), "page_id", depth=3)


@query("pr31_strip_markdown", r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,'`([^`]*)`','\1','g'),'\[([^\]]*)\]\([^)]*\)','\1','g'),'\*\*(.*?)\*\*','\1','g'),'~~(.*?)~~','\1','g') AS plain
 FROM (SELECT conv_id, turn, '**'||role||'** `code` [label](x.md) ~~old~~ '||replace(replace(text,'_',' '),'*',' ') AS t FROM conversations)""")
def _strip_markdown(spark, d):
    body = F.replace(F.replace("text", F.lit("_"), F.lit(" ")), F.lit("*"), F.lit(" "))
    t = F.concat(F.lit("**"), "role", F.lit("** `code` [label](x.md) ~~old~~ "), body)
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_markdown(t).alias("plain"))


@query("pr17_blocks")
def _blocks(spark, d):
    b = markdown.blocks(page_markdown(spark, d), ["page_id"], "md")
    return b.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


@query("pr16_pr34_headings_fences")
def _fences(spark, d):
    b = markdown.blocks(page_markdown(spark, d), ["page_id"], "md")
    return markdown.headings(b, ["page_id"])


@query("pr30_search_text")
def _search_text(spark, d):
    b = markdown.blocks(page_markdown(spark, d), ["page_id"], "md")
    return markdown.search_text(b, ["page_id"]).select("page_id", X.hash16("content").alias("content_hash"))


@query("pr32_rewrite_links")
def _rewrite(spark, d):
    t = page_markdown(spark, d)
    known = t.select(F.explode(X.markdown_targets("md")).alias("url")).distinct().select("url", F.concat(F.lit("/site"), "url").alias("to"))
    return markdown.rewrite_links(t, ["page_id"], "md", known).select("page_id", X.hash16("md").alias("md_hash"))


@query("pr36_cli", """SELECT p_partkey, 'tool' AS command, lower(p_type)||','||p_name AS arguments, '--size,-v' AS flags FROM part""")
def _cli(spark, d):
    line = F.concat(F.lit("$ tool "), F.lower("p_type"), F.lit(' "'), F.col("p_name"), F.lit('" --size -v'))
    t = table(spark, d, "part").select("p_partkey", markdown.cli_parts(line).alias("c"))
    return t.select("p_partkey", "c.command", F.array_join("c.arguments", ",").alias("arguments"), F.array_join("c.flags", ",").alias("flags"))


@query("pr46_pr49_search_rows", rf"""SELECT page_id, h AS title, url, regexp_extract(url,'//([^/?#]*)',1) AS category, CASE WHEN length(t)<=500 THEN t WHEN strpos(x,' ')>0 AND length(x)-strpos(reverse(x),' ')>0 THEN substr(x,1,length(x)-strpos(reverse(x),' ')) ELSE x END AS content
 FROM (SELECT *, substr(t,1,500) AS x FROM (SELECT page_id, url, {_H1} AS h, trim(regexp_replace(regexp_replace(html,'<[^>]+>','','g'),'\s+',' ','g')) AS t FROM pages))""")
def _search_rows(spark, d):
    t = table(spark, d, "pages").select("page_id", "url", "html", F.regexp_extract("html", r"<h1>([\s\S]*?)</h1>", 1).alias("title"), F.regexp_extract("url", "//([^/?#]*)", 1).alias("category"))
    return pages.search_rows(t, ["page_id", "title", "url", "category"], "html")


@query("pr47_pr48_feeds", rf"""SELECT page_id, 'https://site.test/'||page_id AS url, 'weekly' AS change_frequency, CASE WHEN regexp_extract(url,'//([^/?#]*)',1) LIKE 'blog%' THEN 8e-1 WHEN page_id=0 THEN 1e0 ELSE 6e-1 END AS priority, {_H1} AS title FROM pages""")
def _feeds(spark, d):
    t = table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("/"), "page_id").alias("slug"), F.regexp_extract("html", r"<h1>([\s\S]*?)</h1>", 1).alias("title"),
        F.when(F.regexp_extract("url", "//([^/?#]*)", 1).startswith("blog"), "guides").otherwise("other").alias("category"),
    )
    root = F.when(F.col("page_id") == 0, F.lit(1.0))
    rows = pages.sitemap_rows(t, "https://site.test/", ["page_id", "title"])
    return rows.select("page_id", "url", "change_frequency", F.when(F.col("priority") == 0.6, F.coalesce(root, "priority")).otherwise(F.col("priority")).alias("priority"), "title")


@query("pr54_locale", r"""SELECT page_id, CASE WHEN p LIKE '%/fr/%' THEN 'fr' WHEN p LIKE '%/de/%' THEN 'de' ELSE 'en' END AS locale FROM (SELECT page_id, regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p FROM pages)""")
def _locale(spark, d):
    return table(spark, d, "pages").select("page_id", P.locale_of(_url_path(), ["en", "fr", "de"]).alias("locale"))
