"""SQL for DuckDB that must give the rows of those operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

DECONTAMINATION = rf"""
WITH item_words AS (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark),
items AS (SELECT row_number() OVER () AS n, item_id, w, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
wanted AS (SELECT DISTINCT n, item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
           FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT n, count(*) AS n_shingles FROM wanted GROUP BY n),
doc_words AS (SELECT row_number() OVER () AS d, doc_id, {WORDS.format('text')} AS w FROM documents),
runs AS (SELECT DISTINCT d, doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
         FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
shared AS (SELECT d, n, doc_id, item_id, count(*) AS n_shared FROM runs JOIN wanted USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM shared JOIN sizes USING (n) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""

MIXTURE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM sizes),
roomy AS (SELECT *, 3.0::DOUBLE * source_size / weight AS room FROM weighed),
levels AS (SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS BIGINT) - 3.0::DOUBLE * CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM roomy WINDOW o AS (ORDER BY room, source NULLS LAST), b AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reached AS (SELECT arg_min(level, place) AS reached FROM levels WHERE level <= room),
targets AS (SELECT source, source_size, CASE WHEN room < reached THEN 3.0::DOUBLE * source_size ELSE reached * weight END AS target FROM levels, reached),
amounts AS (SELECT *, CASE WHEN size > 0 THEN len(ltrim(bin(size), '0')) ELSE 0 END AS amount FROM sized),
summed AS (SELECT source, amount, CAST(sum(size) AS BIGINT) AS words FROM amounts GROUP BY ALL),
known AS (SELECT s.source, amount, words, source_size, target FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE amount > 0),
leveled AS (SELECT *, (target - 3.0::DOUBLE * CAST(coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
    / CAST(sum(amount * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM known WINDOW o AS (PARTITION BY source ORDER BY amount DESC)),
chosen AS (SELECT *, arg_max(level, amount) FILTER (level * amount <= 3.0::DOUBLE) OVER (PARTITION BY source) AS reached FROM leveled),
copied AS (SELECT *, coalesce(least(3.0::DOUBLE, reached * amount), 3.0::DOUBLE) AS copies FROM chosen),
expected AS (SELECT source, amount, source_size, target, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS share,
    target - CAST(sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS BIGINT) AS lacks FROM copied),
drawn AS (SELECT a.*, source_size, target, certain, share, lacks,
  (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || digest || '|' || copy), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM amounts a JOIN expected e ON a.source IS NOT DISTINCT FROM e.source AND a.amount = e.amount),
ranked AS (SELECT *, CASE WHEN share > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS rank FROM drawn),
taking AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source
  ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS here FROM ranked)
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN rank IS NOT NULL AND here + size / 2 <= lacks THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM taking
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM amounts a JOIN targets t ON a.source IS NOT DISTINCT FROM t.source WHERE amount = 0
"""

CHAT = r"""
WITH clean AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
    replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS said FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY speaker, said) AS part FROM clean),
speakers AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM clean WHERE speaker <> 'system'),
seen AS (SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
         FROM numbered JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
headed AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || regexp_replace(speaker, '[^\p{L}\p{N}_.-]', '_', 'g') ELSE '' END || chr(10) AS head FROM seen),
pieces AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS piece FROM headed),
placed AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, part
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pieces)
SELECT conv_id, perspective, turn, part, speaker, role, piece, start, start + length(piece) AS "end",
  CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN start + length(piece) END AS mask_end
FROM placed
"""

MERKLE = r"""
WITH RECURSIVE crc AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
given AS (SELECT row_number() OVER () AS d, doc_id, lang, CAST(n_chars AS HUGEINT) AS n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(xor(list_reduce(list_transform(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x))), lambda x: CAST(x AS BIGINT)),
      lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) % 7 = 0, false) AS hit
  FROM documents, crc_table),
leaves AS (SELECT d, doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN hit THEN 1 ELSE 0 END), '-') || tail) AS tried FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
up AS (SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM up WHERE len(nodes) > 1),
tops AS (SELECT lang, max(level) AS height, arg_max(nodes, level)[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_place FROM up GROUP BY lang),
upper AS (SELECT 0 AS level, list(subroot ORDER BY lang_place) AS nodes FROM tops
  UNION ALL SELECT level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM upper WHERE len(nodes) > 1),
whole AS (SELECT arg_max(nodes, level)[1] AS root FROM upper),
steps AS (SELECT d, up.level AS step, (place >> up.level) & 1 AS side, nodes[xor(place >> up.level, 1) + 1] AS other
    FROM placed p JOIN up ON p.lang IS NOT DISTINCT FROM up.lang WHERE len(nodes) > 1
  UNION ALL SELECT d, height + upper.level, (lang_place >> upper.level) & 1, nodes[xor(lang_place >> upper.level, 1) + 1]
    FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang, upper WHERE len(nodes) > 1),
fold AS (SELECT d, 0 AS step, tried AS digest FROM leaves
  UNION ALL SELECT fold.d, fold.step + 1, sha256(CASE WHEN side = 1 THEN other || digest ELSE digest || coalesce(other, '') END)
    FROM fold JOIN steps ON fold.d = steps.d AND fold.step = steps.step),
ends AS (SELECT d, arg_max(digest, step) AS folded_root FROM fold GROUP BY d),
proofs AS (SELECT d, sha256(string_agg(coalesce(other, ''), '' ORDER BY step)) AS proof FROM steps GROUP BY d)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang JOIN ends USING (d) LEFT JOIN proofs USING (d), whole
"""

NEGATIVES = r"""
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE alike),
hard AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM near p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE place <= 5)
SELECT * FROM hard WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_decontamination": DECONTAMINATION, "op4_mixture": MIXTURE, "op8_chat": CHAT, "op11_merkle": MERKLE,
                           "op13_negatives": NEGATIVES}
