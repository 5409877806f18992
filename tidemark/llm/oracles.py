"""DuckDB SQL with the results of the queries that SQL can express."""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, trim({_LOWER.format('line')}, {_WS}) AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.*, coalesce(doc_id > first_doc, false) AS dropped FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
    UNION ALL
    SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP7 = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, source, coalesce(source, '') AS src, md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS order_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), sources AS (
  SELECT src, sum(n_tokens)::DOUBLE AS tokens FROM toks GROUP BY src
), totals AS (
  SELECT sum(tokens) AS whole, 0.98 * ln(count(*)::DOUBLE) AS goal FROM sources WHERE tokens > 0
), shares AS (
  SELECT tokens / whole AS p FROM sources, totals WHERE tokens > 0
), entropy AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1,
         CASE WHEN h >= goal THEN (low + high) / 2 ELSE low END,
         CASE WHEN h >= goal THEN high ELSE (low + high) / 2 END
  FROM (SELECT e.*, goal, (SELECT ln(sum(pow(p, (e.low + e.high) / 2))) - (e.low + e.high) / 2 * sum(pow(p, (e.low + e.high) / 2) * ln(p)) / sum(pow(p, (e.low + e.high) / 2)) FROM shares) AS h
        FROM entropy e, totals WHERE step < 40)
), repeats AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1,
         CASE WHEN r <= 4.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN r <= 4.0 THEN (low + high) / 2 ELSE high END
  FROM (SELECT e.*, (SELECT max(pow(p, (e.low + e.high) / 2 - 1)) / sum(pow(p, (e.low + e.high) / 2)) FROM shares) AS r
        FROM repeats e WHERE step < 40)
), chosen AS (
  SELECT round(greatest(
    CASE WHEN (SELECT -sum(p * ln(p)) FROM shares) >= goal THEN 1.0 ELSE (SELECT low FROM entropy WHERE step = 40) END,
    CASE WHEN (SELECT max(1 / p) / count(*) FROM shares) <= 4.0 THEN 0.0 ELSE (SELECT high FROM repeats WHERE step = 40) END), 6) AS a
  FROM totals
), weights AS (
  SELECT src, tokens::BIGINT AS whole_src, CASE WHEN tokens > 0 THEN pow(tokens / whole, a) ELSE 0 END AS w FROM sources, totals, chosen
), given AS (
  SELECT src, whole_src, w / (SELECT sum(w) FROM weights) AS weight,
         floor(w / (SELECT sum(w) FROM weights) * (SELECT whole FROM totals) + 1e-6)::BIGINT AS budget
  FROM weights
), ordered AS (
  SELECT toks.*, weight, whole_src, budget, CASE WHEN whole_src > 0 THEN budget // whole_src ELSE 0 END AS passes,
         sum(n_tokens) OVER (PARTITION BY src ORDER BY order_key ROWS UNBOUNDED PRECEDING) AS upto
  FROM toks JOIN given USING (src)
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight,
       CASE WHEN whole_src > 0 THEN passes + (upto <= budget - passes * whole_src)::INT ELSE 0 END::INT AS copies,
       ('0x' || substr(order_key, 1, 3))::INT AS block
FROM ordered
"""

OP8 = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP9 = """
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), long_pieces AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 2 * (8192 + 99)) AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0), 8192)) AS p FROM t)
), pieces AS (
  SELECT doc_id, p + q AS p, substr(h, 2 * q + 1, 2 * (256 + 99)) AS h FROM (SELECT doc_id, p, h, unnest(range(0, least(8192, greatest(length(h) // 2 - 99, 0)), 256)) AS q FROM long_pieces)
), starts AS (
  SELECT doc_id, p + o AS s, md5_number(substr(h, 2 * o + 1, 200)) AS w FROM (SELECT doc_id, p, h, unnest(range(0, least(256, greatest(length(h) // 2 - 99, 0)))) AS o FROM pieces)
), firsts AS (
  SELECT w, min((doc_id, s)) AS f FROM starts GROUP BY w HAVING count(*) > 1
), again AS (
  SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM starts JOIN firsts USING (w) WHERE (doc_id, s) <> f
), runs AS (
  SELECT *, sum((before IS NULL OR s > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM again
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL
  SELECT t.doc_id, coalesce(max(b), 0), any_value(length(h) // 2) FROM t LEFT JOIN spans USING (doc_id) GROUP BY t.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN t USING (doc_id) GROUP BY doc_id
), removed AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), cut AS (
  SELECT doc_id, text, n, array_to_string(u[1 : least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1 : greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 :], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

OP12 = rf"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark
), w AS (
  SELECT target, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), words AS (
  SELECT target, doc_id, unnest(w) AS word FROM w
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
), crc AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(length(h) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, tab
), counts AS (
  SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM words JOIN crc USING (word) GROUP BY bucket
), totals AS (
  SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals
), sums AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gain FROM words JOIN crc USING (word) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN floor(gain / n_features)::BIGINT ELSE 0 END AS weight,
         (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u
  FROM documents LEFT JOIN sums USING (doc_id)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM noisy WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM noisy LEFT JOIN ranked USING (doc_id)
"""

OP13 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, body, min(page_id) OVER (PARTITION BY body) AS original FROM p
)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to
FROM h
"""

ORACLES: dict[str, str] = {"op2_line_dedup": OP2, "op4_ngram_join": OP4, "op7_temperature_mixing": OP7, "op8_exact_topk": OP8, "op9_window_dedup": OP9, "op11_fill_middle": OP11, "op12_resampling": OP12, "op13_warc": OP13}
