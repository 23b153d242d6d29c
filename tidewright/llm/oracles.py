"""DuckDB SQL of the operators that SQL can express. doc_id is taken to be unique, as it is in the given tables."""

from __future__ import annotations

import string

FOLDED = f"TRANSLATE({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = "REGEXP_EXTRACT_ALL(" + FOLDED + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination(window: int = 10) -> str:
    """Windows of the items joined with windows of the same size of the documents."""
    cut = "ARRAY_TO_STRING(ws[k:k + s - 1], ' ')"
    return f"""WITH d AS (SELECT doc_id, COALESCE({WORDS.format("text")}, []) AS ws FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
 ik AS (SELECT item, ws, LEAST({window}, LEN(ws)) AS s, UNNEST(RANGE(1, LEN(ws) - LEAST({window}, LEN(ws)) + 2)) AS k FROM i WHERE LEN(ws) > 0), iw AS (SELECT DISTINCT item, s, {cut} AS w FROM ik),
 dk AS (SELECT doc_id, ws, s, UNNEST(RANGE(1, LEN(ws) - s + 2)) AS k FROM d, (SELECT DISTINCT s FROM iw) WHERE LEN(ws) >= s), dw AS (SELECT doc_id, s, k, {cut} AS w FROM dk),
 hit AS (SELECT doc_id, dw.s, k, item FROM dw JOIN iw ON dw.w = iw.w AND dw.s = iw.s), pos AS (SELECT DISTINCT doc_id, UNNEST(RANGE(k, k + s)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hit)),
 n AS (SELECT doc_id, COUNT(*) AS n_hit FROM pos GROUP BY doc_id), m AS (SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
 SELECT d.doc_id, CAST(LEN(ws) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32(text: str) -> str:
    """Unsigned crc32 of a column of ASCII text."""
    codes = f"LIST_PREPEND(CAST(4294967295 AS BIGINT), LIST_TRANSFORM(STRING_SPLIT({text}, ''), lambda c: CAST(ASCII(c) AS BIGINT)))"
    return f"XOR(CAST(4294967295 AS BIGINT), LIST_REDUCE({codes}, lambda a, b: XOR(CAST([{', '.join(map(str, _crc_table()))}][CAST(1 + (XOR(a, b) & 255) AS INT)] AS BIGINT), a >> 8)))"


def _levels(name: str, start: str) -> str:
    """Recursive table of nodes (g, level, idx, h): runs of three become one while a group has more."""
    return f"""{name} AS ({start} UNION ALL SELECT g, level + 1, idx // 3, SHA256(STRING_AGG(h, '' ORDER BY idx)) FROM (SELECT *, COUNT(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, level, idx // 3)"""


def _steps(name: str) -> str:
    """(g, level, idx, l, r): what stands left and right of each node in its run; none for the last level."""
    side = lambda sign: f"(SELECT STRING_AGG(b.h, '' ORDER BY b.idx) FROM {name} b WHERE b.g IS NOT DISTINCT FROM a.g AND b.level = a.level AND b.idx // 3 = a.idx // 3 AND b.idx {sign} a.idx)"
    return f"SELECT a.g, a.level, a.idx, COALESCE({side('<')}, '') AS l, COALESCE({side('>')}, '') AS r FROM {name} a JOIN (SELECT g, MAX(level) AS top FROM {name} GROUP BY g) m ON m.g IS NOT DISTINCT FROM a.g WHERE a.level < m.top"


def merkle() -> str:
    """Levels by recursion, proofs by the steps of each leaf's way up, folded from the tampered leaf by recursion."""
    field = lambda c: f"COALESCE(CAST(STRLEN(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "SHA256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    odd = f"{crc32('CAST(doc_id AS VARCHAR)')} % 2 = 1"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, source AS g, {leaf("text")} AS leaf, CASE WHEN {odd} THEN {leaf("text")} ELSE {leaf("REPLACE(text, CHR(10), '')")} END AS other, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM documents),
 {_levels("low", "SELECT g, 0 AS level, idx, leaf AS h FROM leaves")},
 subs AS (SELECT g, h AS subroot, ROW_NUMBER() OVER (ORDER BY g NULLS FIRST) - 1 AS place FROM low WHERE (g, level) IN (SELECT (g, MAX(level)) FROM low GROUP BY g) OR (g IS NULL AND level = (SELECT MAX(level) FROM low WHERE g IS NULL))),
 {_levels("high", "SELECT 0 AS g, 0 AS level, place AS idx, subroot AS h FROM subs")},
 top AS (SELECT h AS root FROM high ORDER BY level DESC LIMIT 1), sl AS MATERIALIZED ({_steps("low")}), sh AS MATERIALIZED ({_steps("high")}),
 way AS (SELECT doc_id, leaves.g, sl.level, l, r FROM leaves JOIN sl ON sl.g IS NOT DISTINCT FROM leaves.g AND sl.idx = leaves.idx // CAST(POW(3, sl.level) AS BIGINT)
  UNION ALL SELECT doc_id, leaves.g, 1000 + sh.level, l, r FROM leaves JOIN subs ON subs.g IS NOT DISTINCT FROM leaves.g JOIN sh ON sh.idx = place // CAST(POW(3, sh.level) AS BIGINT)),
 steps AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM way), proof AS (SELECT doc_id, STRING_AGG(l || r, '' ORDER BY k) AS p, MAX(k) AS n FROM steps GROUP BY doc_id),
 fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, other AS h FROM leaves UNION ALL SELECT fold.doc_id, steps.k, SHA256(l || h || r) FROM fold JOIN steps ON steps.doc_id = fold.doc_id AND steps.k = fold.k + 1)
 SELECT leaves.doc_id, leaf, subroot, root, SHA256(COALESCE(p, '')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
 FROM leaves JOIN subs ON subs.g IS NOT DISTINCT FROM leaves.g CROSS JOIN top LEFT JOIN proof ON proof.doc_id = leaves.doc_id JOIN fold ON fold.doc_id = leaves.doc_id AND fold.k = COALESCE(proof.n, 0)"""


def conversation_repair() -> str:
    """A row at a time from all four states: edits of the row behind up to two insertions, the least of cost and audit for each state
    they end in. Costs are put before audits as digits, so that the least text is both."""
    blank = r"\x20\x09-\x0D"
    said = lambda c: f"COALESCE(CAST({c} AS VARCHAR), ' ')"
    k = crc32(f"({said('conv_id')} || ':' || {said('turn')})") + " % 20"
    due = "CASE WHEN {} = 2 THEN 'assistant' ELSE 'user' END"
    line = lambda role, text: f"CHR(10) || {role} || ':' || {text}"
    then = "CASE WHEN {} = 2 THEN 3 ELSE 2 END"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, {said("role")} AS role, {said("text")} AS text, {k} AS k FROM conversations),
 m AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN REGEXP_REPLACE(text, '[.!?]', '', 'g') ELSE text END AS text, UNNEST(RANGE(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
 o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy) AS i FROM m),
 f AS (SELECT *, SUBSTRING(role, 1, 1) AS one, CASE WHEN NOT REGEXP_MATCHES(text, '[^{blank}]') THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT REGEXP_MATCHES(text, '[.!?][{blank}]*$') THEN 'truncated' ELSE '' END AS fault,
  COALESCE(LAG(SUBSTRING(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || SUBSTRING(role, 1, 1), 'su') AS pair FROM o),
 c AS (SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE fault = 'blank') AS blank, COUNT(*) FILTER (WHERE fault = 'duplicate') AS duplicate, COUNT(*) FILTER (WHERE fault = 'truncated') AS truncated, COUNT(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, COUNT(*) AS size FROM f GROUP BY conv_id),
 walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, '0000000000' AS audit, '' AS said FROM c
  UNION ALL SELECT conv_id, i, state, MIN(audit), ARG_MIN(said, audit) FROM (
   SELECT w.conv_id, f.i, e.state, LPAD(CAST(CAST(SUBSTRING(w.audit, 1, 10) AS BIGINT) + e.cost AS VARCHAR), 10, '0') || SUBSTRING(w.audit, 11) || e.edits AS audit, w.said || e.new AS said
   FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1, LATERAL (
    WITH p(here, cost, edits, new) AS (SELECT w.state, 0, '', '' UNION ALL SELECT {then.format("w.state")}, 2, 'I', {line(due.format("w.state"), "''")} UNION ALL SELECT {then.format(f"({then.format('w.state')})")}, 4, 'II', {line(due.format("w.state"), "''")} || {line(due.format(f"({then.format('w.state')})"), "''")})
    SELECT here AS state, cost + 3 AS cost, edits || 'D' AS edits, new FROM p
    UNION ALL SELECT {then.format("here")}, cost + 2 + CAST(f.fault = 'truncated' AS INT), edits || 'R', new || {line(due.format("here"), "f.text")} FROM p WHERE f.fault IN ('', 'truncated')
    UNION ALL SELECT CASE WHEN f.one = 's' THEN 1 ELSE {then.format("here")} END, cost + CAST(f.fault = 'truncated' AS INT), edits || 'K', new || {line("f.role", "f.text")} FROM p WHERE f.fault IN ('', 'truncated') AND (f.one = SUBSTRING({due.format("here")}, 1, 1) OR (f.one = 's' AND here = 0))) e)
   GROUP BY conv_id, i, state),
 ends AS (SELECT w.conv_id, LPAD(CAST(CAST(SUBSTRING(audit, 1, 10) AS BIGINT) + t.cost AS VARCHAR), 10, '0') || SUBSTRING(audit, 11) || t.edits AS audit, said || t.new AS said FROM walk w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.size
  JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', CHR(10) || 'user:' || CHR(10) || 'assistant:'), (2, 2, 'I', CHR(10) || 'assistant:'), (3, 0, '', '')) t(state, cost, edits, new) ON t.state = w.state),
 best AS (SELECT conv_id, MIN(audit) AS audit, SUBSTRING(ARG_MIN(said, audit), 2) AS said FROM ends GROUP BY conv_id)
 SELECT a.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(CAST(SUBSTRING(audit, 1, 10) AS BIGINT), 0) AS cost, COALESCE(SUBSTRING(audit, 11), '') AS audit, SHA256(COALESCE(said, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": conversation_repair(), "op12_benchmark_decontamination": decontamination(), "op13_merkle_manifest": merkle()}
