"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::bigint)"
    bits = "list_reduce(list_prepend(xor(c, b), [0::bigint,0,0,0,0,0,0,0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {bits}))"


def _leaf(n_chars: str) -> str:
    fields = [f"coalesce(strlen({v}::varchar)||':'||{v}::varchar, '-')" for v in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({'||'.join(fields)})"


#: A tree of every language level by level, a tree of the subroots, then both proofs folded.
OP12_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('='||lang, '') AS g, {_leaf('n_chars')} AS leaf, CASE WHEN {_crc32('doc_id::varchar')} % 7 = 0 THEN {_leaf('(n_chars+1)')} ELSE {_leaf('n_chars')} END AS told FROM documents),
 l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
 t AS (SELECT g, 0 AS lv, i, leaf AS h, n FROM l UNION ALL SELECT g, lv+1, i//2, sha256(string_agg(h, '' ORDER BY i)), any_value((n+1)//2) FROM t WHERE n>1 GROUP BY g, lv, i//2),
 sr AS (SELECT g, h, row_number() OVER (ORDER BY encode(g))-1 AS i, count(*) OVER () AS n FROM t WHERE n=1),
 u AS (SELECT 0 AS lv, i, h, n FROM sr UNION ALL SELECT lv+1, i//2, sha256(string_agg(h, '' ORDER BY i)), any_value((n+1)//2) FROM u WHERE n>1 GROUP BY lv, i//2),
 ht AS (SELECT g, max(lv) AS top FROM t GROUP BY g),
 s AS (SELECT l.doc_id, l.g, l.i, t.lv, x.h AS sib, (l.i >> t.lv) & 1 AS odd FROM l JOIN (SELECT DISTINCT g, lv FROM t WHERE n>1) t ON t.g=l.g LEFT JOIN t x ON x.g=l.g AND x.lv=t.lv AND x.i=xor(l.i >> t.lv, 1)
  UNION ALL SELECT l.doc_id, l.g, l.i, ht.top+v.lv, x.h, (sr.i >> v.lv) & 1 FROM l JOIN sr ON sr.g=l.g JOIN ht ON ht.g=l.g CROSS JOIN (SELECT DISTINCT lv FROM u WHERE n>1) v LEFT JOIN u x ON x.lv=v.lv AND x.i=xor(sr.i >> v.lv, 1)),
 f AS (SELECT g, i, 0 AS lv, told AS h FROM l UNION ALL SELECT f.g, f.i, f.lv+1, sha256(CASE WHEN s.odd=1 THEN coalesce(s.sib, '')||f.h ELSE f.h||coalesce(s.sib, '') END) FROM f JOIN s ON s.g=f.g AND s.i=f.i AND s.lv=f.lv),
 e AS (SELECT g, i, max_by(h, lv) AS h FROM f GROUP BY g, i), p AS (SELECT g, i, string_agg(coalesce(sib, ''), '' ORDER BY lv) AS p FROM s GROUP BY g, i), r AS (SELECT h AS root FROM u WHERE n=1)
 SELECT l.doc_id, l.leaf, sr.h AS subroot, root, sha256(coalesce(p.p, '')) AS proof_sha256, e.h AS folded_root, e.h=root AS verified FROM l JOIN sr ON sr.g=l.g JOIN e ON e.g=l.g AND e.i=l.i LEFT JOIN p ON p.g=l.g AND p.i=l.i, r"""

_EDITS = [  # state and initial (lower case, * any) to state, letters, cost
    *[(q, "*", q, "D", 3) for q in "Esua"],
    *[(q, "s", "s", "K", 0) for q in "E"],
    *[(q, "u", "u", letters + "K", cost) for q, letters, cost in (("E", "", 0), ("s", "", 0), ("a", "", 0), ("u", "I", 2))],
    *[(q, "a", "a", letters + "K", cost) for q, letters, cost in (("u", "", 0), ("E", "I", 2), ("s", "I", 2), ("a", "I", 2))],
    *[(q, "+", to, letters + "R", cost) for q, to, letters, cost in (("E", "u", "", 2), ("s", "u", "", 2), ("a", "u", "", 2), ("u", "a", "", 2), ("E", "a", "I", 4), ("s", "a", "I", 4), ("a", "a", "I", 4), ("u", "u", "I", 4))],
    *[(q, "u", "u", "IIK", 4) for q in "Es"], *[("E", "a", "a", "IIIK", 6)],
]
_RULES = ", ".join(f"('{q}','{c}','{to}','{letters}',{cost})" for q, c, to, letters, cost in _EDITS)

#: Damage, faults, a programme over the rows that keeps the least cost and edit string of each state, and the edits done.
OP11_SQL = f"""WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::varchar, ' ')||':'||coalesce(turn::varchar, ' ')")} % 20 AS how FROM conversations),
 c1 AS (SELECT conv_id, turn, CASE WHEN how=4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, how FROM c0 WHERE how>0),
 c2 AS (SELECT conv_id, turn, role, text FROM c1 UNION ALL SELECT conv_id, turn, role, text FROM c1 WHERE how=3),
 r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role)||':'||role||text)) AS i, substr(role, 1, 1) AS ini, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid FROM c2),
 r1 AS (SELECT *, solid='' AS blank, solid<>'' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i)>1 AS dup FROM r0),
 r AS (SELECT *, blank OR dup AS bad, NOT blank AND NOT dup AND right(solid, 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM r1),
 ids AS (SELECT DISTINCT conv_id FROM conversations),
 ru AS (SELECT * FROM (VALUES {_RULES}) v(q, c, z, letters, cost)),
 st AS (SELECT conv_id, 0 AS i, 'E' AS q, 0 AS cost, '' AS audit FROM ids
  UNION ALL SELECT s.conv_id, s.i+1, ru.z, min(struct_pack(c := s.cost+ru.cost+CASE WHEN r.cut AND ru.c<>'*' THEN 1 ELSE 0 END, a := s.audit||ru.letters)).c, min(struct_pack(c := s.cost+ru.cost+CASE WHEN r.cut AND ru.c<>'*' THEN 1 ELSE 0 END, a := s.audit||ru.letters)).a
   FROM st s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i=s.i+1 JOIN ru ON ru.q=s.q AND (ru.c='*' OR NOT r.bad AND (ru.c='+' OR ru.c=r.ini)) GROUP BY s.conv_id, s.i, ru.z),
 n AS (SELECT ids.conv_id, count(r.i) AS n FROM ids LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ids.conv_id),
 best AS (SELECT s.conv_id, min(struct_pack(c := cost+CASE q WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END, a := audit||CASE q WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END)) AS b FROM st s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.n=s.i GROUP BY s.conv_id),
 ch AS (SELECT conv_id, unnest(string_split(b.a, '')) AS letter, generate_subscripts(string_split(b.a, ''), 1) AS p FROM best WHERE b.a<>''),
 w AS (SELECT *, count(*) FILTER (letter<>'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM ch),
 o AS (SELECT w.conv_id, w.p, letter, r.role, CASE WHEN letter='I' THEN '' ELSE r.text END AS text, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.p)-1 AS k, first_value(letter='K' AND r.ini='s') OVER (PARTITION BY w.conv_id ORDER BY w.p) AS sys FROM w LEFT JOIN r ON letter<>'I' AND r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i=w.i WHERE letter<>'D'),
 h AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter='K' THEN role WHEN (k-CASE WHEN sys THEN 1 ELSE 0 END)%2=0 THEN 'user' ELSE 'assistant' END||':'||text, chr(10) ORDER BY p)) AS h FROM o GROUP BY conv_id),
 a AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (i>1 AND prev||ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
 SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.b.c, 0) AS cost, coalesce(best.b.a, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
 FROM ids LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM ids.conv_id"""

#: Rows for a table in which no id repeats.
OP13_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html,''))) AS payload_bytes, sha256(coalesce(html,'')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest AS digest, min(page_id) AS first FROM p GROUP BY 1)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes<100 OR page_id=first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN payload_bytes>=100 AND page_id<>first THEN first END AS refers_to FROM p JOIN f ON digest=payload_digest"""
