"""SQL of those queries of this subpackage that SQL can express, over whole tables."""

from __future__ import annotations

#: Digests in base 32, five digits of the base 16 (20 bits) giving four.
_OP5 = """
WITH payload AS (
  SELECT page_id, encode(coalesce(html, '')) AS data FROM pages
), hashed AS (
  SELECT page_id, octet_length(data)::BIGINT AS payload_bytes, sha1(data) AS hex FROM payload
), digested AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM hashed
), grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM digested
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id != first_id THEN first_id END AS refers_to
FROM grouped
"""

#: Words of both sides by place; a window is ten words, or all of a shorter item.
_OP9 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item_words WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM doc_words CROSS JOIN sizes WHERE len(words) >= size)
), found AS (
  SELECT d.doc_id, d.size, d.i, w.item_id FROM doc_windows d JOIN item_windows w USING (size, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Sets of shingles, pairs that share one, links, and the least id reachable by them.
_OP3 = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, text, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: hash(array_to_string(list_slice(words, i, i + 4), ' ')))) END AS shingles FROM doc_words
), classes AS (
  SELECT min(doc_id) AS node, len(s) AS n, s FROM (SELECT doc_id, list_sort(shingles) AS s FROM sets WHERE len(shingles) > 0) GROUP BY s
), postings AS (
  SELECT node, n, unnest(s) AS shingle FROM classes
), shared AS (
  SELECT a.node AS a, b.node AS b, a.n AS n_a, b.n AS n_b, count(*) AS common
  FROM postings a JOIN postings b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 80 * (n_a + n_b - common)
), linked AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node, node AS root FROM classes
  UNION
  SELECT linked.b, reached.root FROM reached JOIN linked ON linked.a = reached.node WHERE reached.root < linked.b
), roots AS (
  SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.shingles) AND len(sets.shingles) > 0 LEFT JOIN roots USING (node)
"""

#: Integer parts, the first parts of the least ids, and rounds of nearest entries and floors of means.
_OP13_HEAD = """
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT vec_id, label, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS x FROM whole, (SELECT unnest(range(8)) AS p)
), book_0 AS MATERIALIZED (
  SELECT p, place - 1 AS e, x AS c
  FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS place FROM whole ORDER BY vec_id LIMIT 16) USING (vec_id)
)"""
_OP13_NEAREST = """, near_{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best
  FROM part JOIN book_{r} USING (p) GROUP BY ALL
)"""
_OP13_MOVED = """, mean_{r} AS (
  SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT part.p AS p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM part JOIN near_{r} USING (vec_id, p)) GROUP BY ALL
), moved_{r} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM mean_{r} GROUP BY ALL
), book_{next} AS MATERIALIZED (
  SELECT p, e, coalesce(moved_{r}.c, book_{r}.c) AS c FROM book_{r} LEFT JOIN moved_{r} USING (p, e)
)"""
_OP13_TAIL = """, coded AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near_6 GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book_6) AS codebooks_sha256
FROM coded
"""
_OP13 = _OP13_HEAD + "".join(_OP13_NEAREST.format(r=r) + _OP13_MOVED.format(r=r, next=r + 1) for r in range(6)) + _OP13_NEAREST.format(r=6) + _OP13_TAIL

#: The remainder of the CRC-32 of a conversation's number, bit by bit; prefixes of turns as lists.
_OP12 = r"""
WITH ordered AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS seq,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 6 AS h
  FROM ordered GROUP BY c
), rebuilt AS MATERIALIZED (
  SELECT a.c AS c, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) AS seq
  FROM whole a LEFT JOIN whole b ON b.c = a.c - a.c % 100
), node AS MATERIALIZED (
  SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(seq) = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM (SELECT c, seq, d, list_slice(seq, 1, d) AS key FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)) GROUP BY key, d
), child AS (
  SELECT list_slice(key, 1, d - 1) AS key, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), counted AS MATERIALIZED (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * length(node.key[node.d].text) END AS saved FROM node LEFT JOIN child USING (key, d)
), summed AS (
  SELECT list_slice(key, 1, top) AS key, top AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS top FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN summed s ON s.key = c.key AND s.d = c.d LEFT JOIN node p ON c.d > 0 AND p.d = c.d - 1 AND p.key = list_slice(c.key, 1, c.d - 1)
"""

ORACLE_SQL = {
    "op5_warc_normaliser": _OP5,
    "op9_positional_index": _OP9,
    "op3_ngram_jaccard_join": _OP3,
    "op12_prefix_intervals": _OP12,
    "op13_exponion_codes": _OP13,
}
