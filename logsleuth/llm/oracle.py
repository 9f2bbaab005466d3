"""SQL for the registered queries that SQL can express, over the same tables."""

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i, line,
    translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone
  FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

EMBEDDING_LINKS = """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), components AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id) AS n_links,
  c.component_id, c.vec_id = c.component_id AS kept
FROM components c
"""


def quality_rules(stop_words: list[str]) -> str:
    """Measures and verdict of every document; ``stop_words`` in all counted spellings."""
    stop = ", ".join(f"'{w}'" for w in stop_words)
    blank = r"[\x20\x09-\x0D]+"
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) t(d) GROUP BY doc_id
), measures AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered c USING (doc_id)
), failed AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 50 THEN 'few_words' END,
    CASE WHEN n_words > 0 AND n_repeat_words > 0.5 * n_words THEN 'repeated_words' END,
    CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 'short_words' END,
    CASE WHEN n_words > 0 AND word_chars > 20 * n_words THEN 'long_words' END,
    CASE WHEN n_words > 0 AND n_symbols > 0.5 * n_words THEN 'many_symbols' END,
    CASE WHEN n_lines > 0 AND n_dup_lines > 0.5 * n_lines THEN 'repeated_lines' END,
    CASE WHEN n_words > 0 AND n_stop < 0.01 * n_words THEN 'no_stop_words' END
  ], lambda r: r IS NOT NULL) AS rules FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  list_contains(rules, 'few_words') OR list_contains(rules, 'repeated_words') AS base_failed,
  len(rules) = 0 AS kept, array_to_string(rules, ',') AS failed_rules
FROM failed
"""


FILTER_AUDIT = r"""
WITH RECURSIVE facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), fails AS (
  SELECT doc_id, part, [
    len(w) < 50,
    100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)
  ] AS fails
  FROM facts
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, list_sum(list_transform(fails, lambda f, i: CASE WHEN f THEN 1 << (i::INT - 1) ELSE 0 END))::INT AS mask,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT substr('ABCDE', i::INT, 1) AS letter, 1 << (i::INT - 1) AS bit FROM range(1, 6) t(i)
), orders AS (
  SELECT '' AS filter_order, 0 AS step, '' AS letter, 0 AS bit, 0 AS earlier, 0 AS used
  UNION ALL
  SELECT o.filter_order || l.letter, o.step + 1, l.letter, l.bit, o.used, o.used | l.bit
  FROM orders o JOIN letters l ON o.used & l.bit = 0
), steps AS (
  SELECT f.filter_order, s.step, s.letter, s.bit, s.earlier, s.used
  FROM orders f JOIN orders s ON f.step = 5 AND s.step > 0 AND starts_with(f.filter_order, s.filter_order)
), counted AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & used = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted
"""

RESAMPLE = r"""
WITH RECURSIVE registers AS (
  SELECT i AS byte, 0 AS step, i::UBIGINT AS r FROM range(0, 256) t(i)
  UNION ALL
  SELECT byte, step + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM registers WHERE step < 8
), bytes AS (SELECT list(r ORDER BY byte) AS t FROM registers WHERE step = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM texts
), features AS (
  SELECT side, id, unnest(w) AS feature FROM words
  UNION ALL
  SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
), counted AS (SELECT side, id, feature, count(*) AS n FROM features GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce(
    list_transform(range(1, length(hex(feature)), 2), lambda i: ('0x' || substr(hex(feature), i, 2))::UBIGINT),
    lambda r, b: xor(r >> 8, t[(xor(r, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), bytes
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM counted JOIN hashed USING (feature) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM buckets),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM buckets, totals
), weights AS (
  SELECT id AS doc_id, sum(n) AS n_features, sum(n * gain) AS total
  FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT AS h
  FROM words w LEFT JOIN weights ON w.id = weights.doc_id WHERE w.side = 'd'
), noisy AS (
  SELECT *, weight + floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20
)
SELECT n.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * r.n // 100 THEN rank END AS rank
FROM noisy n LEFT JOIN ranked r ON n.doc_id = r.doc_id
"""
