"""Queries of components and of changed block text: conversations with tags written around their turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import components as C
from tessella.operators import markdown
from tessella.plans.registry import query, table

_NL = "chr(10)"
_OPEN = "'<Card title=\"T'||conv_id||'\" wide count={'||turn||' + {a: 1}}{...more}>'"
# a card, a note inside it that may not be closed, code that is no tag, a badge in a line, and a stray closing tag
_RAW = f"{_OPEN}||{_NL}||'text of '||role||{_NL}||'<Note kind='||chr(39)||'x y'||chr(39)||'>in'||CASE WHEN turn%2=0 THEN '</Note>' ELSE '' END||{_NL}||'</Card>'||{_NL}||'`<Code a=1>` and <Ui.Badge/>'||{_NL}||'```'||{_NL}||'<Fenced>'||{_NL}||'```'||{_NL}||CASE WHEN conv_id%3=0 THEN '</Lost>' ELSE '' END||{_NL}||text"


def _docs(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr(_RAW).alias("raw"))


_COMPONENTS = f"""WITH c AS (SELECT *, {_OPEN} AS o, turn%2=0 AS shut, length({_OPEN}) AS n, length(role) AS r FROM conversations),
 k AS (SELECT *, n+10+r AS note, n+10+r+20+CASE WHEN shut THEN 7 ELSE 0 END AS cend FROM c),
 x AS (SELECT conv_id, turn, 0 AS ordinal, 'Card' AS name, NULL AS parent, 0 AS depth, 0 AS "start", cend+7 AS "end", 1 AS line, true AS flow, '{{"count":"{{'||turn||' + {{a: 1}}}}","title":"T'||conv_id||'","wide":true}}' AS properties,
   'text of '||role||chr(10)||'<Note kind='||chr(39)||'x y'||chr(39)||'>in'||CASE WHEN shut THEN '</Note>' ELSE '' END AS content, NULL AS problem FROM k
  UNION ALL SELECT conv_id, turn, 1, 'Note', 0, 1, note, CASE WHEN shut THEN note+26 ELSE cend END, 3, true, '{{"kind":"x y"}}', 'in', CASE WHEN NOT shut THEN 'not closed' END FROM k
  UNION ALL SELECT conv_id, turn, 2, 'Ui.Badge', NULL, 0, cend+25, cend+36, 5, false, '{{}}', '', NULL FROM k
  UNION ALL SELECT conv_id, turn, 3, 'Lost', NULL, NULL, cend+54, cend+54, NULL, NULL, NULL, NULL, 'not opened' FROM k WHERE conv_id%3=0)"""


@query("pr21_pr22_components", _COMPONENTS + " SELECT * FROM x")
def _components(spark, d):
    found = C.components(_docs(spark, d), ["conv_id", "turn"], "raw")
    # the texts hold no tags of their own
    return found.withColumn("properties", F.to_json("properties"))


@query("pr22_properties", """SELECT conv_id, turn, 0 AS ordinal, 'Card' AS name, 'count' AS property, '{'||turn||' + {a: 1}}' AS value, 'expression' AS type FROM conversations UNION ALL SELECT conv_id, turn, 0, 'Card', 'title', 'T'||conv_id, 'text' FROM conversations
 UNION ALL SELECT conv_id, turn, 0, 'Card', 'wide', 'true', 'flag' FROM conversations UNION ALL SELECT conv_id, turn, 1, 'Note', 'kind', 'x y', 'text' FROM conversations""")
def _properties(spark, d):
    return C.property_rows(C.components(_docs(spark, d), ["conv_id", "turn"], "raw"), ["conv_id", "turn"])


@query("pr21_component_findings", """SELECT conv_id, turn, 2 AS ordinal, 'Ui.Badge' AS name, 'DOC_UNKNOWN_COMPONENT' AS code, NULL AS property FROM conversations UNION ALL SELECT conv_id, turn, 1, 'Note', 'DOC_MISSING_REQUIRED_PROP', 'id' FROM conversations
 UNION ALL SELECT conv_id, turn, 1, 'Note', 'DOC_UNCLOSED_COMPONENT', NULL FROM conversations WHERE turn%2=1 UNION ALL SELECT conv_id, turn, 3, 'Lost', 'DOC_STRAY_CLOSING_TAG', NULL FROM conversations WHERE conv_id%3=0""")
def _findings(spark, d):
    registered = spark.createDataFrame([("Card", ["title"]), ("Note", ["kind", "id"])], "name string, required array<string>")
    return C.check_components(C.components(_docs(spark, d), ["conv_id", "turn"], "raw"), ["conv_id", "turn"], registered)


_BLOCKS = "'# Head '||conv_id||chr(10)||chr(10)||'one'||turn||chr(10)||chr(10)||'- item a'||chr(10)||'- item b'||chr(10)||chr(10)||'> note'||chr(10)||chr(10)||'| h | k |'||chr(10)||'| - | - |'||chr(10)||'| c | '||role||' |'||chr(10)||chr(10)||'```js'||chr(10)||'code'||chr(10)||'```'"


@query("pr33_mapped_blocks", """SELECT conv_id, turn, 0 AS ordinal, 'heading' AS kind, '#Head '||conv_id||'#' AS text, '' AS parts FROM conversations UNION ALL SELECT conv_id, turn, 1, 'paragraph', '#one'||turn||'#', '' FROM conversations UNION ALL SELECT conv_id, turn, 2, 'list', NULL, '#item a#,#item b#' FROM conversations
 UNION ALL SELECT conv_id, turn, 3, 'callout', '#note#', '' FROM conversations UNION ALL SELECT conv_id, turn, 4, 'table', NULL, '#h#,#k#,#c#,#'||role||'#' FROM conversations UNION ALL SELECT conv_id, turn, 5, 'code', 'code', '' FROM conversations""")
def _mapped(spark, d):
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_BLOCKS).alias("raw"))
    parsed = markdown.blocks(docs, ["conv_id", "turn"], "raw")
    mapped = C.map_block_text(parsed, lambda t: F.concat(F.lit("#"), t, F.lit("#")))
    none = F.array().cast("array<string>")
    parts = F.concat(F.coalesce("items", none), F.coalesce("headers", none), F.coalesce(F.flatten("rows"), none))
    return mapped.select("conv_id", "turn", "ordinal", "kind", "text", F.array_join(parts, ",").alias("parts"))
