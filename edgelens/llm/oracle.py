"""Check SQL of the operators that SQL can state, for DuckDB."""

from __future__ import annotations

_WORDS = """regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
          UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

# A mark, or what is left of one, has backslashes after its first character; writing adds one.
_WRITTEN = r"""regexp_replace(regexp_replace(regexp_replace({0},
    '(\[\\*)(/?INST\])', '\1\\\2', 'g'), '(<\\*)(/s>)', '\1\\\2', 'g'),
    '(<\\*)(\|endoftext\|>)', '\1\\\2', 'g')"""

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(length({_WRITTEN.format("role")}) + length({_WRITTEN.format("text")}) + length('[INST][/INST]</s>')) AS BIGINT)
    AS formatted_chars
FROM c GROUP BY conv_id
"""

COLLOCATIONS = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p, unnest(pieces) AS t(piece)),
f AS (SELECT lang, w[i : i + k - 1] AS words, count(*) AS f
      FROM w, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
cand AS (SELECT * FROM f WHERE len(words) > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, x.f AS l, y.f AS r, k,
    1000000 * CAST(c.f AS HUGEINT) * c.f // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cand AS c, unnest(range(1, len(c.words))) AS t(k)
  JOIN f AS x ON x.lang = c.lang AND x.words = c.words[1 : k]
  JOIN f AS y ON y.lang = c.lang AND y.words = c.words[k + 1 : len(c.words)]),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
covered AS (
  SELECT DISTINCT s.lang, s.words FROM cand AS s JOIN cand AS b ON b.lang = s.lang AND len(b.words) = len(s.words) + 1
    AND s.words IN (b.words[1 : len(s.words)], b.words[2 : len(b.words)]) AND 100 * b.f >= 50 * s.f),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM weakest ANTI JOIN covered USING (lang, words))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {
    "op5_decontaminate": DECONTAMINATE.strip(),
    "op6_embeddings": EMBEDDINGS.strip(),
    "op11_chat": CHAT.strip(),
    "op12_collocations": COLLOCATIONS.strip(),
}
