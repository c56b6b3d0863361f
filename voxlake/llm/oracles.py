"""DuckDB SQL of the registered queries that SQL can express."""

ORACLES: dict[str, str] = {}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLES["op1_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

# Parts hold 128 turns here, and no part has repeated turns.
ORACLES["op2_chat_formatting"] = r"""
WITH m AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(regexp_replace(trim(coalesce(role, ''), ' '), '[\s<>|]+', '_', 'g'), ''), 'unknown') AS name,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (SELECT DISTINCT conv_id, name AS speaker FROM m WHERE name <> 'system'),
r AS (
  SELECT m.conv_id, speaker, coalesce(turn // 128, -1) AS part, turn, name, content,
         name <> 'system' AND name = speaker AS own,
         '<|im_start|>' || CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant'
              ELSE 'user name=' || name END || chr(10) AS opening,
         content || '<|im_end|>' AS body
  FROM m JOIN s ON m.conv_id = s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(opening) + length(body) + 1) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY turn, name, content
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(opening) AS start
  FROM r
)
SELECT conv_id, speaker, part, 0::BIGINT AS piece, count(*)::INT AS n_messages,
       string_agg(opening || body, chr(10) ORDER BY turn, name, content) || chr(10) AS text,
       coalesce(string_agg(start::BIGINT::VARCHAR || '-' || (start + length(body))::BIGINT::VARCHAR, ','
                ORDER BY turn, name, content) FILTER (WHERE own), '') AS spans
FROM p GROUP BY conv_id, speaker, part
"""

# Ranks, cuts and takes in one pass over sorted rows instead of histograms.
ORACLES["op8_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
  FROM d GROUP BY source
), b AS (SELECT *, source_size * 3 / weight::DOUBLE AS bound FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(source_size) OVER (ORDER BY bound, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) * 3)::DOUBLE
            / (sum(weight) OVER (ORDER BY bound, source IS NULL, source
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM b
), h AS (SELECT arg_min(level, bound) AS holds FROM l WHERE level <= bound),
t AS (
  SELECT source, source_size,
         least((source_size * 3)::DOUBLE, coalesce(holds * weight, (source_size * 3)::DOUBLE)) AS target
  FROM l, h
), lv AS (
  SELECT source, length(bin(size)) AS digits, sum(size)::BIGINT AS words FROM d GROUP BY ALL HAVING sum(size) > 0
), f AS (
  SELECT lv.source, digits,
         (target - coalesce((sum(words) OVER (PARTITION BY lv.source ORDER BY digits DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) * 3)
         / (sum(words * digits) OVER (PARTITION BY lv.source ORDER BY digits DESC
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS c
  FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source
), c AS (SELECT source, arg_max(c, digits) AS c FROM f WHERE c * digits <= 3 GROUP BY source),
e AS (
  SELECT d.*, source_size, target,
         CASE WHEN size > 0 THEN least(3.0::DOUBLE, coalesce(c, 3.0::DOUBLE) * length(bin(size))) ELSE 0.0::DOUBLE END AS copies,
         (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
), w AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS part FROM e),
r AS (SELECT *, CASE WHEN part > 0 THEN u / (1 - u) * (1 - part) / part END AS rank FROM w),
m AS (SELECT source, any_value(target) - sum(whole * size)::BIGINT AS missing FROM r GROUP BY source),
k AS (
  SELECT r.*, missing, (sum(size) OVER (PARTITION BY r.source ORDER BY rank NULLS LAST, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM r JOIN m ON r.source IS NOT DISTINCT FROM m.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rank IS NOT NULL AND upto - size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""

# All pairs that share a shingle, then reachability.
ORACLES["op10_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM s LEFT JOIN low ON doc_id = a
"""

# Every pair of vectors; the index finds the same links where its recall is full.
ORACLES["op9_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a
), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
       least(vec_id, coalesce(b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op13_ranked_search"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_TERMS}') AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLDED}, '{_TERMS}')) AS term FROM benchmark),
t AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  GROUP BY doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM t, s GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
