"""DuckDB SQL for the queries that SQL can express."""

import re

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = s.doc_id
"""


OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (g))),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) a ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


OP6 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length('### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') || ': ')
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + length('</turn>') + 1 AS n
  FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


#: CRC-32 of the blob b, bit by bit.
CRC = """xor(list_reduce([4294967295] || flatten(list_transform(range(1, octet_length(b) + 1), lambda i:
    list_transform(range(8), lambda k: (('0x' || substr(hex(b), 2 * i - 1, 2))::BIGINT >> k) & 1))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295)"""


def _add(key: str, cost: str, edit: str) -> str:
    """SQL of a key with one more edit."""
    return f"CASE WHEN {key} = '9' THEN '9' ELSE CAST(CAST(left({key}, 9) AS INT) + {cost} AS VARCHAR) || substr({key}, 10) || '{edit}' END"


OP11 = (
    r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS kind
  FROM (SELECT *, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations)),
f AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '-' END AS r
  FROM f),
g AS (
  SELECT *, CASE WHEN cut = '' THEN 'b' WHEN again THEN 'd' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id),
-- cheapest (cost, edits) by state: a nothing yet, b after s, c after u, d after a; a key is cost + 10^8 and the edits, '9' for none; [key,cost,edit] stands for _add
best AS (
  SELECT conv_id, 0 AS i, '100000000' AS a, '9' AS b, '100000003I' AS c, '100000006II' AS d FROM facts
  UNION ALL
  SELECT conv_id, i, a, b, c, least(d, [c,3,I]) AS d
  FROM (SELECT conv_id, i, a, b, least(c, [a,3,I], [b,3,I], [d,3,I]) AS c, d
  FROM (
    SELECT m.conv_id, m.i + 1 AS i, [a,4,D] AS a,
      least([b,4,D], CASE WHEN ok AND r = 's' THEN [a,t,K] ELSE '9' END) AS b,
      least([c,4,D], CASE WHEN ok AND r = 'u' THEN least([a,t,K], [b,t,K], [d,t,K]) WHEN ok THEN least([a,t + 3,R], [b,t + 3,R], [d,t + 3,R]) ELSE '9' END) AS c,
      least([d,4,D], CASE WHEN ok AND r = 'a' THEN [c,t,K] WHEN ok THEN [c,t + 3,R] ELSE '9' END) AS d
    FROM best m JOIN (SELECT conv_id, i, r, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t FROM g) w
      ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND w.i = m.i + 1))),
won AS (
  SELECT facts.conv_id, least(a, d) AS w FROM best JOIN facts ON best.conv_id IS NOT DISTINCT FROM facts.conv_id AND i = n),
e AS (SELECT conv_id, CAST(left(w, 9) AS BIGINT) - 100000000 AS cost, substr(w, 10) AS audit FROM won),
steps AS (SELECT conv_id, j, substr(audit, j, 1) AS x, j - length(replace(left(audit, j), 'I', '')) AS skipped
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM e)),
turns AS (
  SELECT s.conv_id, j, x, g.role, g.text, sum(CASE WHEN x <> 'D' AND NOT (x = 'K' AND g.r = 's') THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id ORDER BY j) AS nth
  FROM steps s LEFT JOIN g ON x <> 'I' AND g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = j - skipped),
said AS (
  SELECT conv_id, string_agg((CASE WHEN x = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole
  FROM turns WHERE x <> 'D' GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("CRC", CRC)
)
OP11 = re.sub(r"\[([abcd]),([^,\]]+),([KRDI])\]", lambda m: _add(m[1], m[2], m[3]), OP11)


OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d) GROUP BY doc_id, f),
tf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM t) GROUP BY f),
crc AS MATERIALIZED (SELECT f, CRC % 10000 AS bucket FROM (SELECT f, encode(f) AS b FROM (SELECT f FROM df UNION SELECT f FROM tf))),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN crc USING (f) GROUP BY bucket),
u AS (SELECT bucket, sum(n) AS t FROM tf JOIN crc USING (f) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(n) FROM df), 0)::DOUBLE AS alls, coalesce((SELECT sum(n) FROM tf), 0)::DOUBLE AS allt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (alls + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (allt + 10000))))::BIGINT AS gain
  FROM s FULL JOIN u USING (bucket), sums),
weigh AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weigh USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
""".replace("CRC", CRC)


OP13 = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": OP11, "op12_importance_resampling": OP12, "op13_exact_dedup": OP13, "op6_chat_formatting": OP6, "op10_substring_dedup": OP10, "op4_minhash_near_dedup": OP4, "op7_winnowing_decontamination": OP7}
