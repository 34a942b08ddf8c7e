"""Queries of incremental work: documents in two versions, events as cache entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import incremental as I
from tessella.operators.common import _shared_dir
from tessella.plans.registry import query, table

# the document that ends in 1 is gone in the second version and its text has come to the one before it
_FIRST = "SELECT doc_id AS file, CASE WHEN doc_id % 10 = 1 THEN concat('r', doc_id) ELSE {h} END AS hash, doc_id % 6 > 0 AS handled FROM documents WHERE doc_id % 10 > 0"
_SECOND = "SELECT doc_id AS file, CASE WHEN doc_id % 10 = 0 THEN concat('r', doc_id + 1) WHEN doc_id % 50 = 13 THEN concat({h}, 'x') ELSE {h} END AS hash, doc_id % 6 > 0 AS handled FROM documents WHERE doc_id % 10 <> 1"
_DEPENDS = "SELECT doc_id AS file, doc_id - doc_id % 100 + (doc_id * 7 + 3) % 100 AS dependency FROM documents WHERE doc_id % 3 > 0"


def _spark(spark, d, text):
    return spark.sql(text.format(h="sha2(coalesce(text, ''), 256)", t="{t}").replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))


def _duck(text):
    return text.format(h="sha256(coalesce(text, ''))")


_PLAN = f"""WITH RECURSIVE v1 AS ({_duck(_FIRST)}), v2 AS ({_duck(_SECOND)}), dep AS ({_DEPENDS}),
 u AS (SELECT file, hash FROM v1 WHERE handled), ch AS (SELECT v2.file, v2.hash FROM v2 LEFT JOIN u USING (file) WHERE v2.handled AND u.hash IS DISTINCT FROM v2.hash),
 cl AS (SELECT file FROM ch UNION SELECT dep.file FROM cl JOIN dep ON dep.dependency=cl.file),
 rn AS (SELECT f.file, max(u.file) AS renamed_from FROM (SELECT hash, min(file) AS file FROM ch GROUP BY 1) f JOIN u USING (hash) WHERE u.file NOT IN (SELECT file FROM v2) GROUP BY 1),
 pl AS (SELECT coalesce(v2.file, u.file) AS file, CASE WHEN v2.file IS NULL THEN 'removed' WHEN NOT handled THEN 'skipped' WHEN cl.file IS NOT NULL THEN 'compile' ELSE 'cached' END AS action,
  CASE WHEN ch.file IS NOT NULL THEN 'changed' WHEN handled AND cl.file IS NOT NULL THEN 'affected' END AS reason, renamed_from
  FROM v2 FULL JOIN u ON u.file=v2.file LEFT JOIN ch ON ch.file=v2.file LEFT JOIN cl ON cl.file=v2.file LEFT JOIN rn ON rn.file=v2.file)"""


@query("in04_compile_plan", _PLAN + " SELECT * FROM pl")
def _compile_plan(spark, d):
    units = _spark(spark, d, _FIRST).filter("handled").select("file", "hash")
    return I.plan_compile(_spark(spark, d, _SECOND), units, _spark(spark, d, _DEPENDS))


@query("in01_update", _PLAN + """ SELECT v2.file, v2.hash, CASE WHEN action='compile' THEN 2 ELSE 1 END AS compiled_in, length(v2.hash)::bigint AS unit FROM v2 JOIN pl USING (file) WHERE action IN ('compile','cached')""")
def _update(spark, d):
    root = f"{_shared_dir(spark)}/state-{I.uuid.uuid4().hex}"
    build = lambda files: files.select("file", F.length("hash").cast("long").alias("unit"))
    none = _spark(spark, d, _DEPENDS).limit(0)
    I.update(_spark(spark, d, _FIRST), none, root, build)
    version, _ = I.update(_spark(spark, d, _SECOND), _spark(spark, d, _DEPENDS), root, build)
    return I.read_version(spark, root, version).select("file", "hash", "compiled_in", "unit")


@query("in05_in06_eviction", """WITH e AS (SELECT doc_id//3 AS key, doc_id*10+n_chars%10 AS "at", n_chars AS size, CASE WHEN doc_id%5>0 THEN doc_id%97 END AS checksum, CASE WHEN doc_id%11>0 THEN CASE WHEN doc_id%13=0 THEN -1 ELSE doc_id%97 END END AS actual FROM documents),
 n AS (SELECT key, max_by(struct_pack("at", size, checksum, actual), struct_pack("at", checksum, actual)) AS e FROM e GROUP BY 1), m AS (SELECT max("at") AS now, count(DISTINCT key) AS k, sum(size) AS s FROM e),
 f AS (SELECT key, e."at" AS "at", e.size AS size, CASE WHEN now-e."at">now*0.8 THEN 'expired' WHEN e.actual IS NULL OR e.checksum<>e.actual THEN 'corrupt' END AS fate FROM n, m),
 r AS (SELECT *, row_number() OVER w AS n, sum(size) OVER w AS b FROM f WHERE fate IS NULL WINDOW w AS (ORDER BY "at" DESC, key ROWS UNBOUNDED PRECEDING))
 SELECT key, "at", size, CASE WHEN n>k//2 OR b>s//6 THEN 'evicted' ELSE 'kept' END AS fate FROM r, m UNION ALL SELECT key, "at", size, fate FROM f WHERE fate IS NOT NULL""")
def _eviction(spark, d):
    e = table(spark, d, "documents").selectExpr(
        "doc_id div 3 AS key", "doc_id * 10 + n_chars % 10 AS at", "n_chars AS size", "CASE WHEN doc_id % 5 > 0 THEN doc_id % 97 END AS checksum",
        "CASE WHEN doc_id % 11 > 0 THEN CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 97 END END AS actual",
    )
    m = e.agg(F.max("at").alias("now"), F.count_distinct("key").alias("k"), F.sum("size").alias("s")).first()
    return I.evict(e, F.lit(m["now"]), F.lit(m["now"] * 0.8), m["k"] // 2, m["s"] // 6)
