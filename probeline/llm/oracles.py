"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANK = r"[^\x20\x09-\x0D]+"

#: Windows of 50 bytes as 100 hexadecimal digits; what is covered is found from each place's last removing window.
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(CASE WHEN i > last + 50 OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM r)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM p GROUP BY 1),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
t AS (SELECT e.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark),
bi AS (SELECT item_id, least(13, len(w)) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS total FROM b),
bw AS (SELECT DISTINCT item_id, n, s FROM (SELECT item_id, n, i, total, string_agg(word, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS s FROM bi) WHERE i + n - 1 <= total),
di AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS total FROM d),
dw AS (SELECT doc_id, n, i, s FROM (SELECT doc_id, n, i, total, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS s
       FROM di, (SELECT DISTINCT n FROM bw)) WHERE i + n - 1 <= total),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _BLANK)} AS w FROM documents),
i AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS total FROM d),
g AS (SELECT doc_id, md5(s) AS s FROM (SELECT doc_id, i, total, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM i) WHERE i + 4 <= total OR (total < 5 AND i = 1)),
e AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, m.b FROM c JOIN m ON m.a = c.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM c GROUP BY a) z ON z.a = d.doc_id
"""


_DIGITS = "'0123456789ABCDEF'"
OP9 = f"""
WITH RECURSIVE steps AS (SELECT range AS k, range AS v, 0 AS step FROM range(256) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM steps WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM steps WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
b AS (SELECT doc_id, len(x) + 1 AS size, list_transform(x, lambda h: (instr({_DIGITS}, h[1]) - 1) * 16 + instr({_DIGITS}, h[2]) - 1) AS bytes FROM d),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM b, crc),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
q AS (SELECT doc_id, size, text_crc32, CAST((2 * before + size) * 16 // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q
"""

_CONTROL = r"<\\*/s>|\[\\*(INST|/INST|ANSWER|ROLE|TEXT|/TEXT)\]"
OP10 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
u AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 ELSE 21 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS shown FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

ORACLES = {"op4_suffix_dedup": OP4, "op5_decontamination": OP5, "op7_ngram_jaccard": OP7, "op9_sharding": OP9, "op10_chat_format": OP10}
