"""DuckDB SQL of the rows of op11 to op13."""

#: All anchors against all rows; ids are distinct, vectors finite and of one length each.
OP11 = """WITH
fine AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, len(embedding) AS n,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM fine a JOIN fine b ON a.id <> b.id AND a.n = b.n WHERE a.id % 100 = 0),
positives AS (
  SELECT a, b, score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
negatives AS (
  SELECT p.a, p.b AS positive, p.score AS positive_score, n.b AS negative, n.score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS rank
  FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT a AS anchor_id, positive AS positive_id, rank, negative AS negative_id, positive_score, score AS negative_score
FROM negatives WHERE rank <= 5"""

#: Windows and lines by their text; a row's number stands for it.
OP12 = r"""WITH
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
listed AS MATERIALIZED (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM docs),
words AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2, w3, w4) AS n
  FROM (SELECT r, i, w, lead(w) OVER p AS w1, lead(w, 2) OVER p AS w2, lead(w, 3) OVER p AS w3, lead(w, 4) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY r ORDER BY i))
  WHERE w4 IS NOT NULL),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS place FROM windows WHERE n > 1) GROUP BY r),
base AS (
  SELECT d.r, d.doc_id, d.host, d.text, CAST(len(w.words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM docs d JOIN listed w USING (r) LEFT JOIN covered c USING (r)),
lines AS MATERIALIZED (
  SELECT r, host, text, line, length(line) - length(replace(line, ' ', '')) + 1 AS words FROM (
    SELECT r, host, text, trim(regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS line FROM docs)
  WHERE line <> ''),
frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM lines GROUP BY ALL) JOIN (SELECT host, count(DISTINCT text) AS texts FROM docs GROUP BY ALL) USING (host)
  WHERE n > 10 AND 100 * n > 5 * texts),
gone AS (SELECT r, CAST(sum(words) AS BIGINT) AS words FROM lines JOIN frequent USING (host, line) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce(words, 0) AS words_removed,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - coalesce(words, 0)) >= 30 * n_words AS kept
FROM base LEFT JOIN gone USING (r)"""

#: Prefixes as lists of turns; crc32 bit by bit.
OP13 = """WITH
turns AS MATERIALIZED (SELECT conv_id AS c, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT c, list(t ORDER BY turn NULLS FIRST, t) AS ts FROM turns GROUP BY c),
hashed AS (
  SELECT c, ts, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), CAST(4294967295 AS BIGINT)) % 6 AS INTEGER) AS h FROM own),
whole AS MATERIALIZED (
  SELECT k.c, list_concat(coalesce(b.ts[1:k.h], []), k.ts[k.h + 1:]) AS ts FROM hashed k LEFT JOIN own b ON b.c = k.c - k.c % 100),
members AS MATERIALIZED (SELECT c, d, ts[1:d] AS p, len(ts) = d AS ends FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (
  SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY p, d),
below AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
each AS MATERIALIZED (SELECT n.*, coalesce(b.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * length(n.p[-1].text) END AS saved FROM nodes n LEFT JOIN below b ON b.p = n.p),
sums AS (
  SELECT a.p, count(*) FILTER (WHERE e.n_children = 0) AS n_leaves, CAST(sum(e.saved) AS BIGINT) AS saved_tokens
  FROM (SELECT e.*, e.p[1:k] AS top FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM each) e) e JOIN nodes a ON a.p = e.top GROUP BY a.p)
SELECT e.c AS conv_id, CAST(e.d AS BIGINT) AS depth, u.c AS parent_conv_id, e.n AS n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM each e JOIN sums s ON s.p = e.p LEFT JOIN nodes u ON e.d > 0 AND u.p = e.p[1:e.d - 1]"""
