"""Queries of composition: conversations as pages whose blocks are turns, in four layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import composition as C
from tessella.plans.registry import query, table

_KIND = "CASE WHEN turn % 3 = 0 THEN 'heading' ELSE 'paragraph' END"
_LEVEL = "CASE WHEN turn = 0 THEN 1 WHEN turn % 3 = 0 THEN 2 END"
#: layer, condition, ordinal, kind, level, text
_SIDES = (
    ("previous", "conv_id % 6 <> 1", "2 * turn", _KIND, _LEVEL, "text"),
    ("generated", "conv_id % 9 <> 4 AND (conv_id + turn) % 11 <> 0", "2 * turn", _KIND, _LEVEL, "concat(text, CASE WHEN (conv_id * 3 + turn) % 5 = 0 THEN ' (new)' ELSE '' END)"),
    ("user", "conv_id % 4 <> 0 AND (conv_id + turn) % 13 <> 5", "2 * turn", _KIND, _LEVEL, "concat(text, CASE WHEN (conv_id + 2 * turn) % 7 = 0 THEN ' (mine)' ELSE '' END)"),
    ("user", "conv_id % 4 <> 0 AND (conv_id + turn) % 8 = 3", "2 * turn + 1", "'paragraph'", "NULL", "concat('note ', turn)"),
    ("ai", "conv_id % 3 = 0 AND turn < 2", "turn", _KIND, _LEVEL, "CASE WHEN turn = 0 THEN text ELSE 'hint' END"),
)


def _layers(spark, d):
    c = table(spark, d, "conversations")
    sides = [
        c.filter(where).selectExpr("conv_id AS slug", f"'{layer}' AS layer", f"CAST({o} AS bigint) AS ordinal", f"{k} AS kind", f"CAST({n} AS int) AS level", f"{t} AS text")
        for layer, where, o, k, n, t in _SIDES
    ]
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out


def _pages(spark, d):
    return table(spark, d, "conversations").selectExpr("conv_id AS slug").distinct().selectExpr(
        "slug", "slug % 10 = 7 AS protected", "CASE WHEN slug % 5 = 0 THEN concat('U', slug) END AS user_title", "CASE WHEN slug % 2 = 0 THEN concat('G', slug) END AS generated_title"
    )


_L = " UNION ALL ".join(
    f"SELECT conv_id AS slug, '{layer}' AS layer, CAST({o} AS bigint) AS ordinal, {k} AS kind, CAST({n} AS int) AS level, {t} AS text FROM conversations WHERE {where}" for layer, where, o, k, n, t in _SIDES
)
# greedy look-up of the previous blocks in the user's by recursion, then what the generator has left
_COMPOSED = f"""WITH RECURSIVE l0 AS ({_L}), l AS (SELECT *, row_number() OVER (PARTITION BY slug, layer ORDER BY ordinal)-1 AS i, concat_ws('|', kind, level, text) AS f FROM l0),
 pg AS (SELECT DISTINCT conv_id AS slug, conv_id%10=7 AS protected FROM conversations),
 n AS (SELECT pg.slug, protected, count(*) FILTER (layer='user') AS nu, count(*) FILTER (layer='generated') AS ng, count(*) FILTER (layer='previous') AS np FROM pg LEFT JOIN l ON l.slug=pg.slug GROUP BY ALL),
 mp AS (SELECT *, CASE WHEN np>0 THEN 'previous' ELSE 'generated' END AS side FROM n WHERE nu>0 AND ng>0 AND NOT protected),
 pv AS (SELECT l.* FROM l JOIN mp ON l.slug=mp.slug AND l.layer=mp.side),
 m AS (SELECT slug, -1 AS i, -1 AS pos FROM mp UNION ALL SELECT m.slug, m.i+1, min(u.i) FROM m JOIN pv ON pv.slug=m.slug AND pv.i=m.i+1 LEFT JOIN l u ON u.slug=m.slug AND u.layer='user' AND u.i>m.pos AND u.f=pv.f WHERE m.pos IS NOT NULL GROUP BY m.slug, m.i),
 k AS (SELECT slug, max(i)+1 AS k, max(pos)+1 AS ends FROM m WHERE pos IS NOT NULL GROUP BY slug),
 lost AS (SELECT pv.slug, pv.i, pv.f, EXISTS (SELECT 1 FROM l g WHERE g.slug=pv.slug AND g.layer='generated' AND g.f=pv.f) AS there FROM pv JOIN k USING (slug) JOIN mp USING (slug) WHERE pv.i>=k.k AND k.ends<mp.nu),
 clash AS (SELECT slug, min(i) AS i FROM lost WHERE NOT there GROUP BY slug),
 a AS (SELECT k.slug, k.k-1 AS i, least(k.k, mp.ng) AS after FROM k JOIN mp USING (slug) UNION ALL SELECT a.slug, a.i+1, coalesce(min(g.i+1), a.after) FROM a JOIN lost ON lost.slug=a.slug AND lost.i=a.i+1 LEFT JOIN clash ON clash.slug=a.slug LEFT JOIN l g ON g.slug=a.slug AND g.layer='generated' AND g.i>=a.after AND g.f=lost.f WHERE clash.i IS NULL OR lost.i<clash.i GROUP BY a.slug, a.i, a.after),
 fl AS (SELECT slug, max(after) AS after FROM a GROUP BY slug),
 e AS (SELECT l.slug, 0 AS seg, l.i, l.layer, l.i AS li, 'user-authored' AS ownership FROM l JOIN n USING (slug) WHERE l.layer='user' AND (n.protected OR n.ng=0)
  UNION ALL SELECT l.slug, 0, l.i, l.layer, l.i, 'generated' FROM l JOIN n USING (slug) WHERE l.layer='generated' AND n.nu=0
  UNION ALL SELECT l.slug, 0, l.i, CASE WHEN m.i<mp.ng THEN 'generated' ELSE 'user' END, CASE WHEN m.i<mp.ng THEN m.i ELSE l.i END, CASE WHEN m.i IS NULL THEN 'user-authored' ELSE 'generated' END FROM l JOIN mp USING (slug) LEFT JOIN m ON m.slug=l.slug AND m.pos=l.i AND m.i>=0 WHERE l.layer='user'
  UNION ALL SELECT l.slug, 1, l.i, l.layer, l.i, 'generated' FROM l JOIN fl USING (slug) WHERE l.layer='generated' AND l.i>=fl.after),
 ai AS (SELECT l.slug, 2, l.i, l.layer, l.i, 'ai-generated' FROM l JOIN n USING (slug) WHERE l.layer='ai' AND NOT (n.protected AND n.nu>0) AND (n.nu=0 OR NOT EXISTS (SELECT 1 FROM e JOIN l x ON x.slug=e.slug AND x.layer=e.layer AND x.i=e.li WHERE e.slug=l.slug AND x.f=l.f))),
 al AS (SELECT * FROM e UNION ALL SELECT * FROM ai),
 composed AS (SELECT al.slug, row_number() OVER (PARTITION BY al.slug ORDER BY seg, al.i)-1 AS "index", al.layer, l.ordinal, ownership, l.kind, l.level, l.text FROM al JOIN l ON l.slug=al.slug AND l.layer=al.layer AND l.i=al.li),
 titled AS (SELECT slug, coalesce(CASE WHEN nu>0 AND slug%5=0 THEN 'U'||slug END, CASE WHEN ng>0 AND NOT (protected AND nu>0) AND slug%2=0 THEN 'G'||slug END, CAST(slug AS varchar)) AS title FROM n)
"""


@query("df07_composition", _COMPOSED + "SELECT * FROM composed")
def _composition(spark, d):
    return C.compose(_layers(spark, d), _pages(spark, d))


@query("df07_page_sources", _COMPOSED + """SELECT t.slug, t.title, count(c.slug) AS n_blocks, CASE WHEN n.protected AND n.nu>0 THEN 'user' WHEN count(*) FILTER (c.ownership='ai-generated')>0 THEN 'ai' WHEN count(c.slug)=count(*) FILTER (c.ownership='user-authored') THEN 'user' ELSE 'compiler' END AS source
 FROM titled t JOIN n USING (slug) LEFT JOIN composed c USING (slug) GROUP BY t.slug, t.title, n.protected, n.nu""")
def _page_sources(spark, d):
    return C.composed_pages(_layers(spark, d), _pages(spark, d))


@query("df07_conflicts", _COMPOSED + """SELECT pv.slug, 'DOC_CONTENT_CONFLICT' AS code, 'warning' AS severity, pv.ordinal, CASE WHEN kind='heading' THEN text ELSE substr(text,1,60) END AS near FROM k JOIN clash USING (slug) JOIN pv ON pv.slug=k.slug AND pv.i=k.k""")
def _conflicts(spark, d):
    return C.conflicts(_layers(spark, d), _pages(spark, d))


@query("df08_overrides", _COMPOSED + """, h AS (SELECT conv_id AS slug, lower(text) AS name FROM conversations WHERE turn=3 AND conv_id%5=1),
 r AS (SELECT conv_id AS slug, text AS t FROM conversations WHERE turn=1 AND conv_id%7=2),
 b1 AS (SELECT c.*, t.title AS old, CASE WHEN c.slug%3=0 THEN 'T'||c.slug ELSE t.title END AS title, CASE WHEN c.slug%3=0 AND kind='heading' AND level=1 AND c."index"=(SELECT min(x."index") FROM composed x WHERE x.slug=c.slug AND x.kind='heading' AND x.level=1) THEN 'T'||c.slug ELSE text END AS t FROM composed c JOIN titled t USING (slug)),
 b2 AS (SELECT * FROM b1 b WHERE NOT EXISTS (SELECT 1 FROM b1 s JOIN h ON h.slug=s.slug AND h.name=lower(s.t) WHERE s.slug=b.slug AND s.kind='heading' AND s."index"<=b."index" AND NOT EXISTS (SELECT 1 FROM b1 x WHERE x.slug=b.slug AND x.kind='heading' AND x."index">s."index" AND x."index"<=b."index" AND x.level<=s.level))),
 b3 AS (SELECT b.slug, b.title, 1 AS seg, b."index" AS i, ownership, CASE WHEN f.i IS NULL THEN kind ELSE 'code' END AS kind, CASE WHEN f.i IS NULL THEN level END AS level, CASE WHEN f.i IS NULL THEN b.t ELSE 'again' END AS text FROM b2 b LEFT JOIN (SELECT b2.slug, min("index") AS i FROM b2 JOIN r ON r.slug=b2.slug AND r.t=b2.t AND b2.kind='paragraph' GROUP BY 1) f ON f.slug=b.slug AND f.i=b."index"),
 p AS (SELECT slug, CASE WHEN slug%3=0 THEN 'T'||slug ELSE title END AS title FROM titled),
 b4 AS (SELECT * FROM b3 UNION ALL SELECT slug, title, 0, 0, 'user-authored', 'paragraph', NULL, 'before' FROM p WHERE slug%8=0 UNION ALL SELECT slug, title, 2, 0, 'user-authored', 'paragraph', NULL, 'after 1' FROM p WHERE slug%8=0 UNION ALL SELECT slug, title, 2, 1, 'user-authored', 'heading', 2, 'after 2' FROM p WHERE slug%8=0)
 SELECT slug, title, CASE WHEN slug%4=1 THEN 'about '||slug END AS description, row_number() OVER (PARTITION BY slug ORDER BY seg, i)-1 AS "index", ownership, kind, level, text FROM b4""")
def _overrides(spark, d):
    c, pages, layers = table(spark, d, "conversations"), _pages(spark, d), _layers(spark, d)
    block = lambda kind, level, text: F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), F.lit(text).alias("text"))
    swap = lambda key, kind, text: F.struct(key.alias("key"), F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(text).alias("text"))
    once = F.substring(C.fingerprint(F.lit("callout"), F.lit(None).cast("int"), F.lit("once")), 1, 12)
    at = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    ops = c.groupBy(F.col("conv_id").alias("slug")).agg(at(3).alias("t3"), at(1).alias("t1")).select(
        "slug", F.expr("CASE WHEN slug % 3 = 0 THEN concat('T', slug) END AS title"), F.expr("CASE WHEN slug % 4 = 1 THEN concat('about ', slug) END AS description"),
        F.when((F.col("slug") % 5 == 1) & F.col("t3").isNotNull(), F.array("t3")).alias("hide"),
        F.when((F.col("slug") % 7 == 2) & F.col("t1").isNotNull(), F.array(swap(F.concat(F.lit("paragraph:"), "t1"), "callout", "once"), swap(once, "code", "again"))).alias("replacements"),
        F.when(F.col("slug") % 8 == 0, F.array(block("paragraph", None, "before"))).alias("before"),
        F.when(F.col("slug") % 8 == 0, F.array(block("paragraph", None, "after 1"), block("heading", 2, "after 2"))).alias("after"),
    )
    return C.apply_overrides(C.compose(layers, pages), C.composed_pages(layers, pages).select("slug", "title"), ops)
