"""SQL spellings of the input tables and regex helpers shared by the comparison queries."""

from __future__ import annotations

from docketry.fixtures import SCANS_SQL

NB, NE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: str) -> str:
    """Unicode digit and space classes for RE2; word boundaries are spelled by ``bounded``."""
    p = p.replace(r"\d", r"\p{Nd}").replace(r"\D", r"\P{Nd}").replace(r"\/", "/")
    return p.replace(r"[-\s]", r"[-\s\x{1c}-\x{1f}\x{85}\p{Z}]").replace(r"[/\-\s]", r"[/\-\s\x{1c}-\x{1f}\x{85}\p{Z}]").replace(
        r"[:\s]", r"[:\s\x{1c}-\x{1f}\x{85}\p{Z}]")


def bounded(t: str, p: str, i: bool = False) -> str:
    """First match of ``p`` between word boundaries, or null."""
    opt = "'i'" if i else "''"
    return f"nullif(regexp_extract({t}, {q(NB + '(' + re2(p) + ')' + NE)}, 2, {opt}), '')"


def hit(t: str, p: str, i: bool = False, group: int = 0) -> str:
    opt = "'i'" if i else "''"
    return f"nullif(regexp_extract({t}, {q(re2(p))}, {group}, {opt}), '')"


def has(t: str, p: str, i: bool = False) -> str:
    opt = "'i'" if i else "''"
    return f"coalesce(regexp_matches({t}, {q(re2(p))}, {opt}), false)"


def has_bounded(t: str, p: str, i: bool = False) -> str:
    opt = "'i'" if i else "''"
    return f"coalesce(regexp_matches({t}, {q(NB + '(?:' + re2(p) + ')' + NE)}, {opt}), false)"


SP = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SP}+|{SP}+$', '', 'g')"


def norm_space(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SP}+', ' ', 'g'))"


SCANS = "scans AS (" + SCANS_SQL.replace("{customer}", "customer") + ")"
TEXTS = SCANS + """,
texts AS (SELECT 'scan' AS src, doc_id, text FROM scans
          UNION ALL SELECT 'doc' AS src, doc_id, text FROM documents)"""

OCR_LINES = """ocr_lines AS (
 SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS line_no, unnest(p) AS text
 FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"""

WORD_CELLS = OCR_LINES + """,
toks AS (
 SELECT doc_id, line_no, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS word_no, unnest(p) AS text
 FROM (SELECT doc_id, line_no, string_split(text, ' ') AS p FROM ocr_lines)),
word_cells AS (
 SELECT doc_id, 0 AS page, line_no, word_no, text,
  CAST(10 + 60 * word_no AS INTEGER) AS "left",
  CAST(100 + 40 * line_no + (doc_id * 7 + line_no * 3 + word_no * 5) % 9 AS INTEGER) AS top,
  50 AS width, CAST(20 + (word_no * 3 + doc_id) % 7 AS INTEGER) AS height,
  CAST((doc_id + word_no) % 128 AS DOUBLE) / 128.0 AS confidence,
  CAST(line_no AS BIGINT) * 1000000 + word_no AS word_id
 FROM toks WHERE text <> '')"""

TSV = WORD_CELLS + """,
tsv AS (
 SELECT doc_id, line_no // 3 AS block_num, 0 AS par_num, line_no, line_no % 3 AS line_num, word_no, "left", top, width, height,
  CASE WHEN word_no % 11 = 0 THEN -1.0::DOUBLE ELSE confidence * 100 END AS conf, text
 FROM word_cells)"""

BOXES = """boxes AS (
 SELECT l_orderkey AS page_id, l_partkey * 10000000000 + l_suppkey * 10 + l_linenumber AS box_no,
  CAST((l_partkey * 13) % 600 AS INTEGER) AS x, CAST((l_suppkey * 29) % 800 AS INTEGER) AS y,
  CAST(40 + (l_partkey * 7) % 200 AS INTEGER) AS w, CAST(20 + (l_suppkey * 11) % 150 AS INTEGER) AS h,
  ['table', 'text_block', 'photo'][l_linenumber % 3 + 1] AS kind, CAST(l_quantity AS INTEGER) AS n_words,
  l_tax * 5000 AS variance, l_discount * 200 AS colourfulness,
  CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 997 AS DOUBLE) / 997.0 AS score
 FROM lineitem)"""

FRAMES = """frames AS (
 SELECT user_id % 8 AS camera_id, user_id AS track_id,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS frame_idx, ts,
  CAST((event_id * 7919) % 400 AS DOUBLE) / 1000 AS ear,
  CAST((event_id * 31) % 640 AS INTEGER) AS cx, CAST((event_id * 17) % 480 AS INTEGER) AS cy,
  CAST(80 + event_id % 200 AS INTEGER) AS bw,
  CAST((event_id * 104729) % 100 AS DOUBLE) / 160 AS mouth_w_ratio,
  CAST((event_id * 1299709) % 100 AS DOUBLE) / 250 AS mouth_open_ratio,
  (event_id * 613) % 1000 < 120 AS is_fake,
  CAST((event_id * 97) % 500 AS INTEGER) AS bright_px, CAST((event_id * 53) % 3 * 1000 AS INTEGER) AS mouth_px
 FROM events)"""

FACES = """numbered AS (
 SELECT event_id, ts, user_id % 8 AS camera_id,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS row_no FROM events),
faces AS (
 SELECT camera_id, step + (row_no - 1) // 80 * 14 + 1 AS frame_idx, CAST(det AS INTEGER) AS det_no, ts,
  CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(w AS INTEGER) AS w, CAST(w + 10 AS INTEGER) AS h,
  CAST(x + w // 2 AS INTEGER) AS cx, CAST(y + (w + 10) // 2 AS INTEGER) AS cy,
  CAST((event_id * 7919) % 400 AS DOUBLE) / 1000 AS ear, CAST((event_id * 104729) % 100 AS DOUBLE) / 160 AS mouth_w_ratio,
  CAST((event_id * 1299709) % 100 AS DOUBLE) / 250 AS mouth_open_ratio, (event_id * 613) % 1000 < 120 AS is_fake
 FROM (SELECT *, 100 + 320 * det + (step * 3) % 60 + CASE WHEN event_id % 17 = 0 THEN 90 ELSE 0 END AS x,
              120 + (step * 5) % 80 + CASE WHEN event_id % 23 = 0 THEN 70 ELSE 0 END AS y,
              60 + event_id % 90 AS w
       FROM (SELECT *, (row_no - 1) // 2 AS step, (row_no - 1) % 2 AS det FROM numbered)))"""

OBJECTS = """objects AS (
 SELECT user_id % 8 AS camera_id, event_id // 5 + 1 AS frame_idx, CAST(event_id % 5 AS INTEGER) AS obj_no,
  [0, 62, 63, 67, 2][event_id * 13 % 5 + 1] AS class_id,
  ['person', 'tv', 'laptop', 'cell phone', 'car'][event_id * 13 % 5 + 1] AS class_name,
  CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS conf,
  CAST(event_id * 11 % 150 AS INTEGER) AS x1, CAST(event_id * 7 % 90 AS INTEGER) AS y1,
  CAST(event_id * 11 % 150 + 60 + event_id % 180 AS INTEGER) AS x2,
  CAST(event_id * 7 % 90 + 50 + event_id % 140 AS INTEGER) AS y2
 FROM events)"""

FILES = """files AS (
 SELECT source || '/Scan #' || doc_id || ' (' || lang || ').v1' || CASE
   WHEN lang = 'en' THEN '.PNG' WHEN lang = 'fr' THEN '.tiff' WHEN lang = 'de' THEN '.Pdf'
   WHEN source = 'src1' THEN '.gif' ELSE '' END AS path,
  make_timestamp((1704067200 + doc_id) * 1000000) AS modificationTime, n_chars AS length, doc_id, lang, source
 FROM documents)"""

ENGINE_RUNS = """engine_runs AS (
 SELECT doc_id, 'alpha' AS engine, 1 AS priority,
   CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'abc' ELSE text END AS full_text,
   0.1::DOUBLE * (doc_id % 17) AS duration_sec, CAST(NULL AS VARCHAR) AS error FROM documents
 UNION ALL SELECT doc_id, 'beta', 2, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE replace(text, 'e', 'c') END,
   0.2::DOUBLE * (doc_id % 13), CASE WHEN doc_id % 10 = 0 THEN 'engine failed' END FROM documents
 UNION ALL SELECT doc_id, 'gamma', 3, CASE WHEN doc_id % 20 = 0 THEN '  ' ELSE text || chr(10) || 'gamma' END,
   0.05::DOUBLE * (doc_id % 11), NULL FROM documents)"""
