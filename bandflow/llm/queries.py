"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and function of each operator's query.
OPERATORS = {
    "op1_near_duplicates": "neardup",
    "op2_language_id": "langid",
    "op3_html_text": "htmlmain",
    "op4_line_dedup": "linededup",
    "op5_secrets": "secrets",
    "op6_warc": "warc",
    "op7_jaccard_join": "jaccard_join",
    "op8_bpe": "bpe",
    "op9_mixing": "mixing",
    "op10_syncmers": "syncmers",
    "op11_alignment": "alignment",
    "op12_prefix_trie": "prefixtrie",
    "op13_decontamination": "decontaminate",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}
    return out | {"pipeline": import_module("corpus_pipeline").run}


# The smallest id that links lead to, for `links(a, b)` in both directions.
REACHED = "reached AS (SELECT a AS id, b AS far FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.far)"

ORACLES = {
    "op1_near_duplicates": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
{REACHED}, c AS (SELECT id, min(far) AS far FROM reached GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(far, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(far, vec_id)) AS kept FROM embeddings LEFT JOIN c ON id = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_warc": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS newest FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INTEGER, 1)), '') AS payload_digest,
CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to, CASE WHEN page_id < newest THEN NULL ELSE true END AS digest_ok FROM m""",
    "op7_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS e FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.e = q.e AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
{REACHED}, c AS (SELECT id, min(far) AS far FROM reached GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(far, doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON id = doc_id""",
}

# Lists of words of `documents` and of windows of `benchmark` as text.
ORACLES["op13_decontamination"] = """WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i : i + 9], ' '))) AS p FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM w, sizes WHERE len(w) >= n),
hits AS MATERIALIZED (SELECT r, i, p.n, item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM places) x JOIN p ON p.p = x.p AND p.n = x.n),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

# CRC-32 of an id's decimal text, bit by bit; prefixes as lists of MD5 of length-marked roles and texts.
ORACLES["op12_prefix_trie"] = """WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c FROM o), crc AS (SELECT c, 0 AS i, 4294967295::BIGINT AS r FROM ids
UNION ALL SELECT c, i + 1, list_reduce(range(8), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END, xor(r, ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT)) FROM crc WHERE i < length(c::VARCHAR)),
heads AS (SELECT c, CASE WHEN c % 20 = 0 THEN 0 ELSE xor(r, 4294967295::BIGINT) % 4 END AS h, c - c % 20 AS base FROM crc WHERE i = length(c::VARCHAR)),
t AS (SELECT c, 0 AS part, pos, role, text FROM heads JOIN o ON o.conv_id = base AND pos <= h UNION ALL SELECT c, 1, pos, role, text FROM heads JOIN o ON o.conv_id = c AND pos > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS pos, md5(length(role) || ':' || role || text) AS code, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM t),
f AS (SELECT ids.c, coalesce(list(code ORDER BY pos) FILTER (pos IS NOT NULL), []) AS codes, coalesce(list(words ORDER BY pos) FILTER (pos IS NOT NULL), []) AS words FROM ids LEFT JOIN n USING (c) GROUP BY ids.c),
p AS MATERIALIZED (SELECT c, d, md5(array_to_string(codes[1 : d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(codes[1 : d - 1], '')) END AS up, d = len(codes) AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(codes) + 1)) AS d FROM f)),
g AS MATERIALIZED (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
x AS (SELECT g.*, coalesce(n, 0) AS n_children FROM g LEFT JOIN kids USING (d, k)),
sums AS (SELECT p.d, p.k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM x JOIN p ON p.c = x.conv_id AND p.d <= x.d GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256 FROM x JOIN sums USING (d, k) LEFT JOIN x y ON y.d = x.d - 1 AND y.k = x.up"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
