"""DuckDB SQL of the queries of this folder that SQL can express."""

from __future__ import annotations


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Operator 12: every round as two tables, assignments (m = distance * entries + entry) and codebook."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT t.vec_id, t.p, min((t.sq - 2 * list_inner_product(t.part, b.part) + b.sq)::BIGINT * {entries} + b.e) AS m
  FROM parts t JOIN b{k} b USING (p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.p, a.m % {entries} AS e, unnest(t.part)::BIGINT AS x, unnest(range(len(t.part))) AS i
        FROM a{k} a JOIN parts t USING (vec_id, p)) GROUP BY ALL),
b{k + 1} AS (
  SELECT p, e, part, list_inner_product(part, part) AS sq FROM (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS part FROM s{k} GROUP BY p, e
    UNION ALL SELECT b.p, b.e, b.part FROM b{k} b ANTI JOIN s{k} s ON s.p = b.p AND s.e = b.e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, p, part, list_inner_product(part, part) AS sq FROM (
    SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS part
    FROM kept, (SELECT unnest(range({parts})) AS p))),
b0 AS (
  SELECT p, e, part, sq FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part, sq FROM parts) WHERE e < {entries}),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(part::BIGINT[], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, d.codebooks_sha256
FROM coded c JOIN kept k USING (vec_id), digest d
"""


#: Operator 11: phrases of every place of every piece, counted as they stand.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
phrases AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM phrases WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.w, j, h.f AS l, t.f AS r,
         ((1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN phrases h ON h.lang = c.lang AND h.k = j AND h.phrase = array_to_string(c.w[1:j], ' ')
  JOIN phrases t ON t.lang = c.lang AND t.k = c.k - j AND t.phrase = array_to_string(c.w[j + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, 2 AS k, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS top
  FROM (SELECT *, unnest([1, 2]) AS s FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN inside i USING (lang, k, phrase) WHERE i.top IS NULL OR 100 * i.top < 50 * o.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
  FROM kept JOIN total USING (lang)) WHERE rank <= 2000
"""

#: Operator 2: all pairs of documents that share a shingle; the smallest id in reach.
NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""

#: Operator 8: turns in order, their digests and the length of the template around them.
CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN role
         ELSE '@' || replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') END AS title FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || title || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

#: Operator 9: all pairs of vectors.
GRID_JOIN = """
WITH RECURSIVE kept AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
"""


SQL: dict[str, str] = {"op2_ngram_join": NGRAM_JOIN, "op8_chat": CHAT, "op9_grid_join": GRID_JOIN, "op11_collocations": COLLOCATIONS,
                       "op12_vector_codes": _vector_codes()}
