"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'),
      '<(/?s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|</?SYS>>)', '<\\\1', 'g'),
      '\[(/?INST\])', '[\\\1', 'g') AS safe
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(safe) + 12 + 10 + 10)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP9 = """
WITH told AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM told),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f
  FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM firsts
"""



def license_sql() -> str:
    from themeloom.llm import licenses as lic

    rows = ", ".join(
        f"({i}, '{label}', {words})" for i, (label, words) in enumerate(lic.template_words(lic.TEMPLATES))
    )
    phrases = " UNION ALL ".join(
        "SELECT k, i - 1 AS spot, '" + label + "' AS label FROM spots WHERE "
        + " AND ".join(f"words[i + {j}] = '{word}'" for j, word in enumerate(phrase.split()))
        for phrase, label in lic.PHRASES
    )
    return rf"""
WITH templates(t, label, words) AS (VALUES {rows}),
worded AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), '{lic.UPPER}', '{lic.LOWER}'),
      '{lic.NOT_WORD}'), lambda x: x <> '') AS words
  FROM documents),
spots AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
places AS ({phrases}),
base AS (
  SELECT k, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM places GROUP BY k),
blocks AS (
  SELECT k, list_distinct(words[s + 1 : s + {lic.BLOCK}]) AS block
  FROM (SELECT k, words, unnest(range(0, greatest(len(words) - {lic.STEP}, 1), {lic.STEP})) AS s FROM worded)),
matches AS (
  SELECT k, label, len(list_intersect(templates.words, block)) / len(templates.words)::DOUBLE AS score
  FROM blocks, templates
  WHERE len(list_intersect(templates.words, block)) >= ceil({lic.CONTAINMENT} * len(templates.words))),
named AS (
  SELECT k, label, 1 AS b FROM places UNION ALL SELECT k, label, 0 FROM matches),
labelled AS (
  SELECT k, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (b = 1), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM named GROUP BY k),
best AS (SELECT k, max(score) AS score FROM matches GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM worded LEFT JOIN base USING (k) LEFT JOIN labelled USING (k) LEFT JOIN best USING (k)
"""


OP7 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents),
worded AS (
  SELECT doc_id, line_no, list_transform(
    list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda t: t <> ''),
    lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM lines),
shaped AS (
  SELECT doc_id, line_no, tokens, len(list_filter(tokens, lambda t: t <> '<*>')) AS words,
    len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf, array_to_string(tokens, ' ') AS shape
  FROM worded),
counted AS (SELECT * FROM shaped WHERE words >= 4),
shapes AS (
  SELECT leaf, shape, any_value(tokens) AS tokens, any_value(words) AS words, count(DISTINCT doc_id) AS n_docs
  FROM counted GROUP BY leaf, shape),
several AS (SELECT * FROM shapes WHERE leaf IN (SELECT leaf FROM shapes GROUP BY leaf HAVING count(*) > 1)),
spots AS (
  SELECT leaf, shape, words, n_docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
  FROM several),
constant AS (
  SELECT leaf, place, token FROM spots WHERE token <> '<*>'
  GROUP BY ALL HAVING sum(n_docs) >= 2),
general AS (
  SELECT leaf, shape, leaf || ' | ' || string_agg(place || ' ' || token, ' ' ORDER BY place) AS template
  FROM spots JOIN constant USING (leaf, place, token)
  GROUP BY leaf, shape, words HAVING count(*) >= 0.75 * words),
named AS (
  SELECT doc_id, line_no, coalesce(template, shape) AS template
  FROM counted LEFT JOIN general USING (leaf, shape)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY doc_id, line_no) AS r,
    min(doc_id) OVER (PARTITION BY template) AS lo, max(doc_id) OVER (PARTITION BY template) AS hi
  FROM named),
marked AS (
  SELECT doc_id, line_no, line, coalesce(lo < hi AND r > 1, false) AS gone
  FROM lines LEFT JOIN ranked USING (doc_id, line_no))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text,
  count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped
FROM marked GROUP BY doc_id
"""

OP2 = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, root = vec_id AS kept
FROM embeddings JOIN roots ON roots.x = vec_id LEFT JOIN counts ON counts.x = vec_id
"""

OP4 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM worded WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x)
SELECT worded.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id
FROM worded JOIN roots ON roots.x = worded.doc_id LEFT JOIN sizes ON sizes.doc_id = worded.doc_id
"""

OP11 = """
WITH told AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(octet_length(b)::BIGINT)) AS pos FROM told),
strings AS (SELECT doc_id, pos, b[pos + 1 : pos + 1] AS c,
  CASE WHEN pos + 50 <= octet_length(b) THEN b[pos + 1 : pos + 50] END AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS f FROM strings WHERE s IS NOT NULL GROUP BY s),
starts AS (
  SELECT doc_id, pos, c, CASE WHEN f < doc_id THEN pos END AS hit
  FROM strings LEFT JOIN firsts ON firsts.s = strings.s),
covered AS (
  SELECT doc_id, pos, c, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
    IS NOT NULL AS gone FROM starts),
edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS head FROM covered),
sums AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans,
    coalesce(string_agg(hex(c), '' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM edges GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN sums USING (doc_id)
"""
OP12 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tok AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
cells AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS d FROM tok GROUP BY ALL),
kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term HAVING sum(d) >= 10),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (
  SELECT lang, count(term) AS v, coalesce(sum(n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS total
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
masses AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM grid GROUP BY ALL),
shares AS (
  SELECT grid.lang, grid.source, term, grid.n,
    1 + (1000000000::HUGEINT * (grid.n + 2)) // (m.n + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 2)) // (l.n + 2 * v) AS q
  FROM grid JOIN masses m ON m.lang = grid.lang AND m.source = grid.source JOIN langs l ON l.lang = grid.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums ON sums.lang = g.lang AND sums.source = g.source AND sums.item = h.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT r, lang, unnest(range(len(p))) AS piece, unnest(p) AS t
  FROM (SELECT r, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS p FROM docs)),
words AS (
  SELECT lang, r, piece, unnest(range(len(w))) AS pos, unnest(w) AS a
  FROM (SELECT lang, r, piece, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM words
  WINDOW o AS (PARTITION BY r, piece ORDER BY pos)),
one AS (SELECT lang, a, count(*)::HUGEINT AS n FROM runs GROUP BY ALL),
two AS (SELECT lang, a, b, count(*)::HUGEINT AS n FROM runs WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, a, b, c, count(*)::HUGEINT AS n FROM runs WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT two.lang, two.a || ' ' || two.b AS phrase, two.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM two JOIN one x ON x.lang = two.lang AND x.a = two.a JOIN one y ON y.lang = two.lang AND y.a = two.b
  WHERE NOT EXISTS (
    SELECT 1 FROM three t WHERE t.lang = two.lang AND 100 * t.n >= 50 * two.n
      AND ((t.a = two.a AND t.b = two.b) OR (t.b = two.a AND t.c = two.b)))
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.n, 1, x.n, y.n
  FROM three t JOIN one x ON x.lang = t.lang AND x.a = t.a JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.n, 2, x.n, y.n
  FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b JOIN one y ON y.lang = t.lang AND y.a = t.c),
scored AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best),
sizes AS (SELECT lang, sum(n) AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

STATEMENTS = {
    "op1_chat_formatting": OP1, "op2_embedding_dedup": OP2, "op4_ngram_join": OP4, "op7_line_dedup": OP7,
    "op9_warc": OP9, "op10_license_scans": license_sql(), "op11_suffix_dedup": OP11,
    "op12_source_divergence": OP12, "op13_collocations": OP13,
}
