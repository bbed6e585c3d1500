"""The corpus queries as SQL for an independent engine (DuckDB dialect), for checking."""

from __future__ import annotations

from metricloom.llm.collocations import COVER, LEAST, MOST, TOP
from metricloom.llm.url_filter import RULES

RULE_ROWS = ", ".join(f"('{host}', '{path}')" for host, path, _ in RULES)

ORACLES: dict[str, str] = {
    "quality_statistics": r"""
  WITH ws AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  starts AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM ws WHERE len(w) >= 8)),
  twice AS (SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
  covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM twice) GROUP BY 1),
  lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM ws),
  facts AS (SELECT ws.doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM ws JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
  SELECT doc_id, n_words, coalesce(chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts
    """,
    "op6_warc": r"""
  WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
  r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to FROM r
    """,
    "op7_minhash_dedup": r"""
  WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM ws WHERE len(w) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
  joint AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT x, y FROM joint JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
  arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, a.y FROM reach r JOIN arcs a ON a.x = r.other)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
  FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
    """,
    "op8_substring_dedup": r"""
  WITH ws AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  starts AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM ws WHERE len(w) >= 20)),
  again AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
  words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM ws),
  marked AS (SELECT words.*, coalesce(max(again.i) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM words LEFT JOIN again USING (doc_id, i)),
  edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked),
  done AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM edged GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM ws d LEFT JOIN done USING (doc_id)
    """,
    "url_rules": rf"""
  WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  rules(h, r) AS (VALUES {RULE_ROWS}),
  fits AS (SELECT page_id, h || r AS rule FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || r) DESC) = 1)
  SELECT page_id, host, path, rule FROM p LEFT JOIN fits USING (page_id)
    """,
    "op11_collocations": rf"""
  WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws WHERE len(w) > 0),
  grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, {MOST + 1}) AS s(k) WHERE i + k - 1 <= len(w)),
  totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
  found AS (SELECT lang, k AS size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
  cand AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM found WHERE size > 1),
  cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS rest FROM cand c, range(1, {MOST}) AS s(k) WHERE k < size),
  scored AS (SELECT c.lang, c.phrase, c.a, h.a AS l, r.a AS r, n, k, (1000::HUGEINT * c.a * n) // (h.a::HUGEINT * r.a) AS score
    FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = c.head JOIN found r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang),
  cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inner_ AS (SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS inside
    FROM cand c, range(2, {MOST}) AS s(m), range(1, {MOST}) AS p(i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
  best AS (SELECT c.* FROM cut c LEFT JOIN inner_ x ON x.lang = c.lang AND x.phrase = c.phrase WHERE inside IS NULL OR 100 * inside < {COVER} * a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best QUALIFY rank <= {TOP}
    """,
    "op12_conversation_repair": r"""
  WITH RECURSIVE
  bits AS (SELECT i, 0 AS round, i::UBIGINT AS v FROM range(256) AS t(i)
    UNION ALL SELECT i, round + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE round < 8),
  crc AS (SELECT list(v ORDER BY i) AS step FROM bits WHERE round = 8),
  raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
  coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::UBIGINT)),
      lambda c, b: xor(c >> 8, step[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS code FROM raw, crc),
  hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
      CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS again FROM coded),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM hurt),
  marked AS (SELECT *, left(role, 1) AS ini, rtrim(text, E' \t\n\x0b\x0c\r') AS kept, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
  rows_ AS (SELECT *, CASE WHEN kept = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
      ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM marked),
  counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
      count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id),
  -- the least (cost, audit) by state after the rows so far: none, system, user, assistant; a far cost where there is no way
  best AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS n, {'c': 1000000000000::BIGINT, 'a': ''} AS s, {'c': 1000000000000::BIGINT, 'a': ''} AS u, {'c': 1000000000000::BIGINT, 'a': ''} AS y
      FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, list_min([{'c': n.c + 3, 'a': n.a || 'D'}]),
      list_min([{'c': s.c + 3, 'a': s.a || 'D'}, {'c': n.c + k_s, 'a': n.a || 'K'}]),
      list_min([{'c': u2.c + 3, 'a': u2.a || 'D'}, {'c': least(n.c, s.c, y2.c) + k_u, 'a': list_min([n, s, y2]).a || 'K'}, {'c': least(n.c, s.c, y2.c) + r, 'a': list_min([n, s, y2]).a || 'R'}]),
      list_min([{'c': y2.c + 3, 'a': y2.a || 'D'}, {'c': u2.c + k_a, 'a': u2.a || 'K'}, {'c': u2.c + r, 'a': u2.a || 'R'}])
    FROM (SELECT b.conv_id, x.i, b.n, b.s, w.u2, list_min([b.y, {'c': w.u2.c + 2, 'a': w.u2.a || 'I'}]) AS y2,
        CASE WHEN fault IN ('b', 'd') THEN 1000000000000 ELSE 2 + (fault = 't')::BIGINT END AS r,
        CASE WHEN fault IN ('b', 'd') OR ini <> 's' THEN 1000000000000 ELSE (fault = 't')::BIGINT END AS k_s,
        CASE WHEN fault IN ('b', 'd') OR ini <> 'u' THEN 1000000000000 ELSE (fault = 't')::BIGINT END AS k_u,
        CASE WHEN fault IN ('b', 'd') OR ini <> 'a' THEN 1000000000000 ELSE (fault = 't')::BIGINT END AS k_a
      FROM (SELECT conv_id, i, n, s, y, list_min([u, {'c': n.c + 2, 'a': n.a || 'I'}, {'c': s.c + 2, 'a': s.a || 'I'}, {'c': y.c + 2, 'a': y.a || 'I'}]) AS u2 FROM best) w
      JOIN best b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i
      JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1)),
  ends AS (SELECT conv_id, list_min([n, y, {'c': u.c + 2, 'a': u.a || 'I'}, {'c': s.c + 4, 'a': s.a || 'II'}]) AS e FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
  steps AS (SELECT conv_id, e.a AS audit, unnest(range(1, len(e.a) + 1)) AS t FROM ends),
  edits AS (SELECT conv_id, t, audit[t] AS edit, t - len(replace(left(audit, t), 'I', '')) AS extra FROM steps),
  made AS (SELECT e.conv_id, e.t, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.t) AS o, count(*) OVER (PARTITION BY e.conv_id) AS m
    FROM edits e LEFT JOIN rows_ x ON edit <> 'I' AND x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.t - e.extra WHERE edit <> 'D'),
  hashed AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (o + m) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY t)) AS h FROM made GROUP BY conv_id)
  SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, e.e.c AS cost, e.e.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
  FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
