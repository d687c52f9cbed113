"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from decisionlake.llm.bpe import op7_duckdb_bpe
from decisionlake.llm.chat import op5_chat_format
from decisionlake.llm.embedding import op6_cap_filters
from decisionlake.llm.jaccard import op3_bayes_jaccard
from decisionlake.llm.language import op9_language_id
from decisionlake.llm.lexical import op12_accumulator_search
from decisionlake.llm.license import op4_license_scan
from decisionlake.llm.manifest import op13_interval_manifest
from decisionlake.llm.mixing import op11_pivotal_mixing
from decisionlake.llm.packing import op2_kk_packing
from decisionlake.llm.quality import op1_mcd_quality
from decisionlake.llm.sharding import op8_jump_sharding
from decisionlake.llm.suffix import op10_bwt_merge

QUERIES = {
    f.__name__: f
    for f in (
        op1_mcd_quality, op2_kk_packing, op3_bayes_jaccard, op4_license_scan, op5_chat_format, op6_cap_filters,
        op7_duckdb_bpe, op8_jump_sharding, op9_language_id, op10_bwt_merge,
        op11_pivotal_mixing, op12_accumulator_search, op13_interval_manifest,
    )
}

#: Links to components: each node with the smallest node it reaches.
_REACH = """
reach AS (SELECT a, a AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
"""

ORACLE_SQL = {
    "op3_bayes_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 9 * k >= 4 * (p.n + q.n)),
nodes AS (SELECT doc_id AS a FROM documents),
{_REACH}
SELECT nodes.a AS doc_id, low AS class_id, coalesce(degree.n, 0) AS n_links, low = nodes.a AS kept
FROM nodes JOIN low USING (a) LEFT JOIN degree USING (a)
""",
    "op5_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
    regexp_replace(regexp_replace(text, '<(\\*)(s>|/s>|r>|t>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g') AS safe
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(safe) + CASE WHEN before IS NULL THEN 6 + length(role) WHEN before = role THEN 3 ELSE 10 + length(role) END) + 4)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op6_cap_filters": f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, list_max(list_transform(embedding::DOUBLE[], lambda e: abs(e))) AS m FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT vec_id, label, list_transform(x, lambda e: e / pow(2, floor(log2(m)))) AS x FROM fine WHERE m > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) >= 0.93 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))),
nodes AS (SELECT vec_id AS a FROM embeddings),
{_REACH}
SELECT nodes.a AS vec_id, coalesce(degree.n, 0) AS n_links, low AS component_id, low = nodes.a AS kept
FROM nodes JOIN low USING (a) LEFT JOIN degree USING (a)
""",
    "op12_accumulator_search": r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM size),
scale AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // l) AS m FROM size, corpus),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY t, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN scale USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 50
""",
    "op13_interval_manifest": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, n_chars IS NOT NULL AND doc_id IS NOT NULL AS can,
    coalesce(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || coalesce(octet_length(source::BLOB) || ':' || source, '-') || coalesce(octet_length(lang::BLOB) || ':' || lang, '-') AS head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT doc_id, g, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN can THEN sha256(head || length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS other FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree AS (
  SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY g ORDER BY i) AS after FROM tree WHERE n > 1) WHERE i % 2 = 0),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gi FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, gi AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS after FROM top WHERE n > 1) WHERE i % 2 = 0),
crc AS (SELECT range AS byte, range AS c, 0 AS k FROM range(256)),
steps AS (
  SELECT byte, c, k FROM crc
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
codes AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
told AS (
  SELECT p.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(p.doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: xor(a >> 8, codes.t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM placed p, codes),
walk AS (
  SELECT doc_id, g, 0 AS part, 0 AS level, i, t.n, leaf, CASE WHEN crc % 7 = 0 AND other IS NOT NULL THEN other ELSE leaf END AS fold, '' AS proof, i AS own
  FROM told JOIN tree t USING (g, i) WHERE t.level = 0
  UNION ALL
  SELECT doc_id, w.g, w.part, w.level + 1, w.i // 2, (w.n + 1) // 2, leaf, sha256(CASE WHEN w.i % 2 = 0 THEN fold || coalesce(s.h, '') ELSE s.h || fold END), proof || coalesce(s.h, ''), own
  FROM walk w LEFT JOIN tree s ON s.g = w.g AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (
  SELECT doc_id, own, g, subroot, leaf, fold, proof, 0 AS level, gi AS i, (SELECT count(*) FROM subroots) AS n FROM walk JOIN subroots USING (g) WHERE walk.n = 1
  UNION ALL
  SELECT doc_id, own, g, subroot, leaf, sha256(CASE WHEN c.i % 2 = 0 THEN fold || coalesce(s.h, '') ELSE s.h || fold END), proof || coalesce(s.h, ''), c.level + 1, c.i // 2, (c.n + 1) // 2
  FROM climb c LEFT JOIN top s ON s.level = c.level AND s.i = xor(c.i, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM climb, (SELECT h AS root FROM top WHERE n = 1) WHERE n = 1
""",
}
