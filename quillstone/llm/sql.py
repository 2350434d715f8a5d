"""SQL (DuckDB) for the results of operators that SQL can express."""

OP4_SHARDING = """
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
  FROM documents
), prefixes AS (
  SELECT substr(bits, 1, d) AS shard, CAST(d AS INTEGER) AS depth, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n
  FROM hashed, range(0, 61) AS t(d) GROUP BY 1, 2
), large AS (
  SELECT shard, depth FROM prefixes WHERE shard_bytes > 1048576 AND n > 1
), leaves AS (
  SELECT p.shard, p.depth, p.shard_bytes FROM prefixes p
  LEFT JOIN large l ON l.shard = p.shard AND l.depth = p.depth
  LEFT JOIN large u ON u.shard = substr(p.shard, 1, p.depth - 1) AND u.depth = p.depth - 1
  WHERE l.shard IS NULL AND (p.depth = 0 OR u.shard IS NOT NULL)
)
SELECT h.doc_id, h.n_bytes, v.shard, v.depth, v.shard_bytes
FROM hashed h JOIN leaves v ON v.shard = substr(h.bits, 1, v.depth)
"""

OP6_MTREE = """
WITH clean AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 50 = 0 AND q.place <> c.place
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP11_PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), spoken AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
    SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM spoken GROUP BY lang
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase
    FROM spoken, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(ws) >= k
), counts AS (
    SELECT lang, phrase, k AS words, count(*) AS a FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100
), cuts AS (
    SELECT lang, phrase, words, a, string_split(phrase, ' ') AS ws, unnest(range(1, words)) AS k FROM counts WHERE words > 1
), scored AS (
    SELECT c.lang, c.phrase, c.words, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, c.k + 1, c.words), ' ')
    JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
    SELECT lang, a, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, words - 1), ' '), array_to_string(list_slice(string_split(phrase, ' '), 2, words), ' ')]) AS phrase
    FROM counts WHERE words > 2
), kept AS (
    SELECT * FROM lowest p WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = p.lang AND i.phrase = p.phrase AND 100 * i.a >= 100 * p.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

OP12_VARIANTS = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
    FROM runs, crc
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), gaps AS (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), wild AS (
    SELECT DISTINCT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS shape FROM gaps
), shorter AS (
    SELECT DISTINCT g.word, g.n, w.word AS other, w.n AS other_n FROM gaps g JOIN words w ON w.word = substr(g.word, 1, g.i - 1) || substr(g.word, g.i + 1)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM wild a JOIN wild b ON a.shape = b.shape AND a.word <> b.word
    UNION ALL SELECT word, other, other_n FROM shorter
    UNION ALL SELECT other, word, n FROM shorter
), best AS (
    SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), ends AS (
    SELECT a.word, coalesce(e.form, d.form, c.form, b.form, a.form, a.word) AS root
    FROM formed a LEFT JOIN formed b ON b.word = a.form LEFT JOIN formed c ON c.word = b.form LEFT JOIN formed d ON d.word = c.form LEFT JOIN formed e ON e.word = d.form
)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends ON ends.word = f.word
"""
