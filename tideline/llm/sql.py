"""DuckDB twins of those queries that SQL can express."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS drawn, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM src
), s AS (
  SELECT *, cap / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w
), c AS (
  SELECT *, sum(cap) OVER o - cap AS before, all_weight - sum(weight) OVER o + weight AS open_weight
  FROM s WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), l AS (
  SELECT *, max((total - before) / open_weight) OVER () AS level FROM c
), t AS (
  SELECT source, source_size, least(cap, level * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(d.drawn || ':7'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken,
       floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT AS copies
FROM r
"""

OP3 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS normal
  FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i + 2], ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win JOIN (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1) USING (rid, s)
  ) GROUP BY rid
), hashed AS (
  SELECT rid, normal, list_transform(normal, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT) AS h FROM w
), five AS (
  SELECT rid, array_to_string(normal[i:i + 4], ' ') AS s, (h[i] * 1640531527 + h[i + 1] * 1181783497 + h[i + 2] * 2024237689 + h[i + 3] * 1399733957 + h[i + 4] * 1879048201) % 2147483647 AS v
  FROM (SELECT rid, normal, h, unnest(range(1, len(normal) - 3)) AS i FROM hashed WHERE len(normal) > 4)
), sketch AS (
  SELECT rid, host, coalesce(f.s, array_to_string(normal, ' ')) AS s FROM w LEFT JOIN (SELECT rid, arg_min(s, v) AS s FROM five GROUP BY rid) f USING (rid)
), raw AS (
  SELECT rid, host, i, l FROM (SELECT rid, host, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT l) AS n FROM raw GROUP BY rid
), lines AS (
  SELECT rid, host, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         array_to_string(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+'), ' ') AS s
  FROM raw
), above AS (
  SELECT a.host, a.line FROM (SELECT l.host, l.s AS line, count(DISTINCT k.s) AS holders FROM lines l JOIN sketch k USING (rid) GROUP BY l.host, l.s) a
  JOIN (SELECT host, count(DISTINCT s) AS documents FROM sketch GROUP BY host) h ON a.host IS NOT DISTINCT FROM h.host
  WHERE holders > 20 AND holders > documents * 0.02::DOUBLE
), gone AS (
  SELECT rid, sum(n) AS n FROM lines l JOIN above a ON l.host IS NOT DISTINCT FROM a.host AND l.s = a.line GROUP BY rid
), x AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.8::DOUBLE * n_words AND n_words - removed_words >= 50 AS kept
FROM x
"""

OP8 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (
  SELECT d.rid, d.i, d.n, b.item FROM dwin d JOIN win b USING (n, s)
), hw AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), hi AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY rid
)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

ORACLES = {"op1_mixing": OP1, "op3_quality_rules": OP3, "op8_decontamination": OP8}
