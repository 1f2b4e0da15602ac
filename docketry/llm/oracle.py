"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"'[^\x20\x09-\x0D]+'"

SIZES = f"""
sized AS (
 SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
 FROM documents),
ranked AS (
 SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
 FROM sized GROUP BY source),
ordered AS (
 SELECT *, 3 * source_size AS cap, row_number() OVER o AS nth, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS released,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
 FROM ranked WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
levelled AS (
 SELECT coalesce(arg_min(CAST(total - released AS DOUBLE) / CAST(open_weight AS DOUBLE), nth) FILTER (
   WHERE CAST(total - released AS DOUBLE) / CAST(open_weight AS DOUBLE) * weight <= cap), 0) AS level FROM ordered),
targets AS (
 SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
 FROM ranked, levelled),
placed AS (
 SELECT s.doc_id, s.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS each_,
  sum(s.size) OVER w AS upto, sum(s.size) OVER (PARTITION BY s.source, s.place) AS own
 FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
 WINDOW w AS (PARTITION BY s.source ORDER BY s.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

MIXING = f"""WITH {SIZES}
SELECT doc_id, size, source_size, target,
 CAST(size * (each_ + CASE WHEN 2 * upto - own <= 2 * (target - each_ * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed"""

LINES = f"""
lines AS (
 SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
 FROM documents),
wide AS (
 SELECT trim(raw, {WS}) AS line, min(doc_id) AS keeper FROM lines WHERE trim(raw, {WS}) <> ''
 GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, '')) >= CASE WHEN len(regexp_extract_all(line, {WORD})) <= 3 THEN 10 ELSE 5 END),
marked AS (
 SELECT l.doc_id, l.raw, l.pos, trim(l.raw, {WS}) <> '' AS full_, w.keeper IS NOT NULL AND w.keeper <> l.doc_id AS gone
 FROM lines l LEFT JOIN wide w ON trim(l.raw, {WS}) = w.line),
cleaned AS (
 SELECT doc_id, CAST(count(*) FILTER (full_) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  count(*) FILTER (gone) > 0 AND count(*) FILTER (full_) = count(*) FILTER (gone) AS emptied,
  coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
 FROM marked GROUP BY doc_id)"""

LINE_DEDUP = f"WITH {LINES} SELECT doc_id, n_lines, n_removed, emptied, sha256(text) AS text_sha256 FROM cleaned"


def without(text: str, chars: str) -> str:
    quoted = chars.replace("'", "''")
    return f"len(translate({text}, '{quoted}', ''))"


def _space_less(text: str) -> str:
    return rf"len(regexp_replace({text}, '[\x20\x09-\x0D]', '', 'g'))"


def quality() -> str:
    from docketry.llm import quality_rules as Q

    end, nav, notice = (p.replace("'", "''") for p in (Q.LINE_END, Q.NAVIGATION, Q.BOILERPLATE))
    n_words = "(len(s) - " + _space_less("s") + " + 1)"
    fails = f"""(len(s) - {without('s', Q.LINE_SYMBOLS)} > {_space_less('s')} * {Q.MAX_SYMBOL_SHARE}
  OR (len(s) - len(replace(s, '!!', ''))) / 2 > {n_words} * {Q.MAX_SHOUT_SHARE}
  OR ({n_words} <= {Q.SHORT_WORDS} AND (NOT regexp_matches(s, '{end}') OR regexp_matches(s, '{nav}')))
  OR ({n_words} <= {Q.NOTICE_WORDS} AND regexp_matches(s, '{notice}')))"""
    return f"""WITH
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, trim(raw, {WS}) AS s, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM d)),
line_sums AS (
 SELECT doc_id, count(*) FILTER (s <> '') - count(DISTINCT raw) FILTER (s <> '') AS dup,
  coalesce(sum({_space_less('raw')}) FILTER (s = '' OR NOT {fails}), 0) AS left_chars
 FROM lines GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(text, {WORD}) AS w FROM d),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
base AS (
 SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST({_space_less('d.text')} AS BIGINT) AS word_chars,
  CAST(len(d.text) - {without('d.text', Q.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(l.dup AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, l.left_chars
 FROM d JOIN w USING (doc_id) JOIN line_sums l USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
  AND (word_chars = 0 OR 1 - CAST(left_chars AS DOUBLE) / word_chars <= {Q.MAX_LOST}) AS kept
FROM base"""


CHAT = r"""WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(len(role) + 24 + len(regexp_replace(text,
  '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|/?SYS>|</?SYS>>)', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

NGRAM_JOIN = f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
 SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
 WHERE CAST(shared.n AS DOUBLE) / (x.n + y.n - shared.n) >= 0.8),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = c.doc_id) AS n_links, class_id = doc_id AS kept FROM classes c"""

EMBEDDINGS = """WITH RECURSIVE
v AS (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
 SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = p.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts p"""

SQL = {"op1_ngram_join": NGRAM_JOIN, "op4_embedding_dedup": EMBEDDINGS, "op2_line_dedup": LINE_DEDUP, "op5_mixing": MIXING, "op6_quality_rules": quality(), "op8_chat": CHAT}
