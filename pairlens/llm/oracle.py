"""SQL of the links of embeddings, of the quality rules, of phrases and of the repair of conversations, for an engine with RE2 patterns."""

from __future__ import annotations

from pairlens.llm import conversations as d
from pairlens.llm import quality as q
from pairlens.llm.common import SPACE, WORD


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(line, {_text(pattern)}))"


_NOTICES = " OR ".join(f"contains(lower(line), {_text(p)})" for p in q.BOILERPLATE)
_ENDS = "[" + q.MARKS + q.UNMARKED + "][" + q.CLOSING.replace("]", r"\]") + r"]*[\x20\x09-\x0D]*\z"

QUALITY_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) AS words FROM documents
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + {q.BASE_WINDOW - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {q.BASE_WINDOW - 2})) AS i FROM docs)
), twice AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1
), covered AS (
  SELECT rid, sum(least({q.BASE_WINDOW}, gap)) AS n FROM (SELECT rid, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), {q.BASE_WINDOW}) AS gap FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word, {_count(WORD)} AS n
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
), judged AS (
  SELECT *, has_word AND (
    (n <= {q.SHORT_LINE} AND NOT regexp_matches(line, {_text(_ENDS)}))
    OR {_count(q.SYMBOLS + "+")} > n * {q.MAX_SYMBOLS_A_WORD}
    OR {_count("[!?]+")} > greatest(n * {q.MAX_SHOUTS_A_WORD}, 2)
    OR {_count(q.SEPARATORS)} > greatest(n * {q.MAX_SEPARATORS_A_WORD}, 1)
    OR (n <= {q.SHORT_LINE // 3} AND regexp_matches(lower(line), {_text(q.MENU)}))
    OR (n <= {3 * q.SHORT_LINE} AND ({_NOTICES}))
  ) AS fails FROM lines
), by_doc AS (
  SELECT rid, count(*) FILTER (has_word) - count(DISTINCT line) FILTER (has_word) AS n_dup_lines,
    greatest(0, coalesce(sum(length(line) + 1) FILTER (NOT fails), 0) - 1) AS left_chars
  FROM judged GROUP BY rid
), counted AS (
  SELECT doc_id, text, left_chars, len(words) AS n_words, length(regexp_replace(text, {_text(SPACE)}, '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs JOIN by_doc USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words) AND length(text) - left_chars <= {q.MAX_LOST} * length(text) AS kept
FROM counted
"""

# The damage and the report of op13, for an engine with recursive tables. crc32 is written out: its argument is ASCII.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(concat(coalesce(conversations.conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ord(x)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT))"""
_GO = {  # by state: cost of deleting, of keeping and of the other role, from costs v after a turn
    state: f"least({d.DELETE} + v[{state + 1}], CASE WHEN fault NOT IN (1, 2) THEN {d.REROLE} + late + v[{d.AFTER[state] + 1}] END, "
    + "".join(f"CASE WHEN fault NOT IN (1, 2) AND initial = '{i}' THEN late + v[{to[state] + 1}] END, " for i, to in d.KEPT.items() if state in to)
    + "NULL)"
    for state in range(4)
}
_NAME = "CASE s WHEN 2 THEN 'assistant' ELSE 'user' END"

REPAIR_SQL = rf"""
WITH RECURSIVE convs AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS cid FROM (SELECT DISTINCT conv_id FROM conversations)
), hit AS (
  SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM conversations JOIN convs ON conversations.conv_id IS NOT DISTINCT FROM convs.conv_id
), turns AS (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM hit WHERE kind <> 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i FROM turns
), judged AS MATERIALIZED (
  SELECT cid, turn, role, text, i, role[1:1] AS initial, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
    WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
  FROM placed
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN fault = 3 THEN {d.TRUNCATED} ELSE 0 END AS late FROM judged
), sizes AS (
  SELECT cid, (SELECT count(*) FROM rows_ WHERE rows_.cid = convs.cid) AS n FROM convs
), back(cid, i, v) AS (
  SELECT cid, n + 1, {list(d.END)}::BIGINT[] FROM sizes
  UNION ALL
  SELECT cid, i, [least(b[1], {d.INSERT} + b[3], {2 * d.INSERT} + b[4]), least(b[2], {d.INSERT} + b[3], {2 * d.INSERT} + b[4]), least(b[3], {d.INSERT} + b[4]), least(b[4], {d.INSERT} + b[3])]
  FROM (SELECT rows_.cid, rows_.i, [{", ".join(_GO[s] for s in range(4))}] AS b FROM back JOIN rows_ ON rows_.cid = back.cid AND rows_.i = back.i - 1)
), costs AS MATERIALIZED (
  SELECT cid, i, v FROM back
), walk(cid, i, s, audit, made) AS (
  SELECT cid, 1::BIGINT, 0, '', []::VARCHAR[] FROM sizes
  UNION ALL
  SELECT cid, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
    CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN kept WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
    CASE e WHEN 'D' THEN made WHEN 'I' THEN list_append(made, {_NAME} || ':') WHEN 'K' THEN list_append(made, role || ':' || text) ELSE list_append(made, {_NAME} || ':' || text) END
  FROM (
    SELECT *, CASE WHEN v[s + 1] = {d.DELETE} + w[s + 1] THEN 'D' WHEN v[s + 1] = {d.INSERT} + v[CASE s WHEN 2 THEN 4 ELSE 3 END] THEN 'I'
      WHEN fault NOT IN (1, 2) AND v[s + 1] = late + w[kept + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT walk.*, now.v, next.v AS w, role, text, fault, late,
        CASE WHEN initial = 's' AND s = 0 THEN 1 WHEN initial = 'u' AND s <> 2 THEN 2 WHEN initial = 'a' AND s = 2 THEN 3 END AS kept
      FROM walk JOIN costs now ON now.cid = walk.cid AND now.i = walk.i LEFT JOIN costs next ON next.cid = walk.cid AND next.i = walk.i + 1 LEFT JOIN rows_ ON rows_.cid = walk.cid AND rows_.i = walk.i
      WHERE next.i IS NOT NULL OR s IN (1, 2)
    )
  )
), ends AS (
  SELECT walk.cid, audit, made FROM walk JOIN sizes ON sizes.cid = walk.cid WHERE i = n + 1 AND s IN (0, 3)
), counts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY i) || initial AS pair FROM rows_) GROUP BY cid
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, v[1]::BIGINT AS cost, audit, sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM convs JOIN ends USING (cid) JOIN costs ON costs.cid = convs.cid AND costs.i = 1 LEFT JOIN counts ON counts.cid = convs.cid
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words CROSS JOIN range(1, 5) AS sizes(m))
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), candidates AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT) // (x.a::HUGEINT + y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM candidates CROSS JOIN range(2, 4) AS sizes(s) WHERE s < m) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
) JOIN totals USING (lang) WHERE rank <= 2000
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), valid AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM vectors
  UNION
  SELECT reached.vec_id, links.b FROM reached JOIN links ON links.a = reached.other
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reached GROUP BY vec_id
"""
