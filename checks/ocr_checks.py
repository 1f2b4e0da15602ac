"""Comparison queries for OCR shaping, engine comparison, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlbase import ENGINE_RUNS, FILES, OCR_LINES, SCANS, TSV, WORD_CELLS, strip
from checks.text_checks import SCORES, shown
from docketry import fixtures as X
from docketry.functions import geometry as G
from docketry.functions import text as T
from docketry.operators import classify as K
from docketry.operators import lines as L
from docketry.operators import ocr as O
from docketry.plans import documents as P
from docketry.schemas import ANNOTATION, ANNOTATION_TEXTS
from docketry.sources import readers as R
from docketry.sources import sinks as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def poly(c):
    """Polygon as text, for comparison."""
    return F.array_join(F.transform(c, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")


def rect(x1, y1, x2, y2):
    return f"{x1} || ',' || {y1} || ' ' || {x2} || ',' || {y1} || ' ' || {x2} || ',' || {y2} || ' ' || {x1} || ',' || {y2}"


# --- responses ---------------------------------------------------------------------------------

_BLOCKS = f"""{WORD_CELLS},
lines2 AS (SELECT doc_id, line_no, ocr_lines.text AS line, len(string_split(ocr_lines.text, ' ')) - 1 AS last FROM ocr_lines
  WHERE trim(ocr_lines.text, ' ') <> '' AND doc_id % 24 <> 23),
paras AS (SELECT doc_id, line_no, line, last, line_no // 3 AS b, doc_id % 6 AS shape FROM lines2)"""


@query("s2_read_annotations", f"""WITH {_BLOCKS}, n AS (SELECT doc_id, count(DISTINCT b) AS n_blocks, count(*) AS n_paras FROM paras GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.doc_id % 24 = 23 THEN NULL WHEN d.doc_id % 48 = 7 THEN 'search' ELSE ['fullTextAnnotation', 'data', 'results.Data.responses', 'search'][d.doc_id % 4 + 1] END AS wrapper,
 CASE WHEN d.doc_id % 24 <> 23 AND d.doc_id % 3 = 0 THEN length(text) END AS text_chars,
 CAST(CASE WHEN d.doc_id % 24 <> 23 AND d.doc_id % 6 <> 4 THEN coalesce(n_blocks, 0) END AS INTEGER) AS n_blocks,
 CAST(CASE WHEN d.doc_id % 24 <> 23 AND d.doc_id % 6 = 4 THEN coalesce(n_paras, 0) END AS INTEGER) AS n_top
FROM documents d LEFT JOIN n USING (doc_id)""")
def s2(spark, sf):
    a = O.read_annotations(X.annotations(spark, sf))
    count = lambda c: F.when(c.isNotNull(), F.size(c))
    return a.select("doc_id", "wrapper", F.length("fta.text").cast("bigint").alias("text_chars"),
                    count(F.col("fta.pages")[0]["blocks"]).alias("n_blocks"), count(F.col("fta.paragraphs")).alias("n_top"))


@query("s2_rejected_responses", "SELECT doc_id FROM documents WHERE doc_id % 24 = 23")
def s2r(spark, sf):
    return O.rejected(O.read_annotations(X.annotations(spark, sf))).select("doc_id")


def _fta(spark, sf, schema=ANNOTATION):
    return O.read_annotations(X.annotations(spark, sf), schema=schema).filter("fta IS NOT NULL").select("doc_id", "fta")


_PNUM = """pn AS (SELECT *, CAST(CASE WHEN shape = 4 THEN 1 ELSE dense_rank() OVER (PARTITION BY doc_id ORDER BY b) END AS INTEGER) AS block_no,
 CAST(CASE WHEN shape = 4 THEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) ELSE row_number() OVER (PARTITION BY doc_id, b ORDER BY line_no) END AS INTEGER) AS para_no,
 CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS seq FROM paras WHERE shape IN (0, 1, 4))"""
_PTEXT = "CASE WHEN shape = 1 THEN line ELSE regexp_replace(trim(line, ' '), ' +', ' ', 'g') END"


@query("o7_explode_paragraphs", f"WITH {_BLOCKS}, {_PNUM} SELECT doc_id, 1 AS page_no, block_no, para_no, seq FROM pn")
def o7(spark, sf):
    return O.explode_paragraphs(_fta(spark, sf)).select("doc_id", "page_no", "block_no", "para_no", "seq")


@query("o8_paragraph_text", f"WITH {_BLOCKS}, {_PNUM} SELECT doc_id, seq, {_PTEXT} AS text FROM pn")
def o8(spark, sf):
    return O.explode_paragraphs(_fta(spark, sf)).select("doc_id", "seq", O.paragraph_text(F.col("para")).alias("text"))


@query("o9_paragraph_confidence", f"""WITH {_BLOCKS}, {_PNUM},
wc AS (SELECT doc_id, line_no, CASE WHEN word_no % 5 <> 0 THEN 1 WHEN word_no % 7 = 0 THEN length(text) ELSE 0 END AS n,
  CASE WHEN word_no % 5 <> 0 THEN confidence WHEN word_no % 7 = 0 THEN 0.5::DOUBLE * length(text) ELSE 0 END AS v FROM word_cells),
s AS (SELECT doc_id, line_no, sum(v) / nullif(sum(n), 0) AS c FROM wc GROUP BY ALL)
SELECT pn.doc_id, seq, CASE WHEN pn.line_no % 5 = 0 THEN 0.9::DOUBLE WHEN shape IN (0, 4) THEN c END AS confidence
FROM pn LEFT JOIN s ON s.doc_id = pn.doc_id AND s.line_no = pn.line_no""")
def o9(spark, sf):
    return O.explode_paragraphs(_fta(spark, sf)).select("doc_id", "seq", O.paragraph_confidence(F.col("para")).alias("confidence"))


_LBOX = rect("10", "(100 + 40 * line_no)", "(60 + 60 * last)", "(130 + 40 * line_no)")
_WBOX = rect('"left"', "top", '("left" + width)', "(top + height)")


@query("o10_explode_words", f"""WITH {_BLOCKS},
toks2 AS (
 SELECT doc_id, line_no, word_no, text, {_WBOX} AS box, CASE WHEN word_no % 5 <> 0 THEN confidence END AS confidence FROM word_cells
  WHERE doc_id % 24 <> 23 AND (doc_id % 6 IN (0, 2) OR (doc_id % 6 = 4 AND word_no % 7 <> 0))
 UNION ALL SELECT doc_id, line_no, 0, {strip('line')}, {_LBOX}, CASE WHEN line_no % 5 = 0 THEN 0.9::DOUBLE END FROM paras WHERE shape IN (1, 3))
SELECT doc_id, 0 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) - 1 AS INTEGER) AS word_no, text, box, confidence FROM toks2""")
def o10(spark, sf):
    return O.explode_words(_fta(spark, sf)).select("doc_id", "page", "word_no", "text", poly(F.col("vertices")).alias("box"), "confidence")


@query("o11_simplified_paragraphs", f"""WITH {_BLOCKS},
e AS (SELECT doc_id, line_no, CASE WHEN shape IN (1, 3) THEN line ELSE regexp_replace(trim(line, ' '), ' +', ' ', 'g') END AS text, {_LBOX} AS box FROM paras WHERE shape <> 5
  UNION ALL SELECT doc_id, b, string_agg(line, chr(10) ORDER BY line_no), {rect('0', '(b * 120)', '900', '(b * 120 + 119)')} FROM paras WHERE shape = 5 GROUP BY doc_id, b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS seq, text, box FROM e""")
def o11(spark, sf):
    return O.simplified_paragraphs(_fta(spark, sf)).select("doc_id", "seq", "text", poly(F.col("bounding_box")).alias("box"))


@query("o15_combined_text", f"""WITH {_BLOCKS}, {_PNUM},
t AS (SELECT doc_id, string_agg(printf('--- paragraph_%03d (page 1 block %d) ---', seq, block_no) || chr(10) || {_PTEXT} || chr(10) || chr(10), '' ORDER BY seq) AS transcript,
  string_agg({_PTEXT} || chr(10) || chr(10), '' ORDER BY seq) AS plain FROM pn GROUP BY doc_id)
SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN nullif(d.text, '') END, plain, '') AS full_text, coalesce(transcript, '') AS transcript
FROM documents d LEFT JOIN t USING (doc_id) WHERE d.doc_id % 24 <> 23""")
def o15(spark, sf):
    return O.combined_text(_fta(spark, sf, ANNOTATION_TEXTS))


@query("o1_zip_word_arrays", f"""WITH {WORD_CELLS},
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, word_no) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM word_cells)
SELECT doc_id, CAST(k - 1 AS INTEGER) AS word_no, {strip('text')} AS text,
 {rect('(10 + 60 * word_no)', '(100 + 40 * line_no)', '(60 + 60 * word_no)', '(100 + 40 * line_no + 20 + doc_id % 7 + (doc_id % 7) % 2)').replace(
  '(60 + 60 * word_no)', '(60 + 60 * word_no)').replace('(100 + 40 * line_no + 20 + doc_id % 7 + (doc_id % 7) % 2)', 'CAST(round_even(100.5 + 40 * line_no + 20 + doc_id % 7, 0) AS BIGINT)').replace(
  '(10 + 60 * word_no)', 'CAST(round_even(10.5 + 60 * word_no, 0) AS BIGINT)').replace('(60 + 60 * word_no)', 'CAST(round_even(60.5 + 60 * word_no, 0) AS BIGINT)').replace(
  '(100 + 40 * line_no)', 'CAST(round_even(100.5 + 40 * line_no, 0) AS BIGINT)')} AS box,
 CASE WHEN doc_id % 2 = 1 OR k < n THEN confidence END AS confidence
FROM n WHERE doc_id % 3 <> 0 OR k < n""")
def o1(spark, sf):
    return O.zip_word_arrays(X.word_arrays(spark, sf)).select("doc_id", "word_no", "text", poly(F.col("vertices")).alias("box"), "confidence")


# --- engines -----------------------------------------------------------------------------------

def _fallback_sql(n):
    return f"""WITH {ENGINE_RUNS}, ok AS (SELECT * FROM engine_runs WHERE length({strip('full_text')}) >= {n})
SELECT d.doc_id, o.engine, o.full_text FROM documents d LEFT JOIN (SELECT doc_id, arg_min(engine, priority) AS engine, arg_min(full_text, priority) AS full_text FROM ok GROUP BY 1) o USING (doc_id)"""


@query("o2_engine_fallback", _fallback_sql(4))
def o2(spark, sf):
    return O.engine_fallback(X.engine_runs(spark, sf))


@query("o2v_engine_fallback_any_text", _fallback_sql(1))
def o2v(spark, sf):
    return O.engine_fallback(X.engine_runs(spark, sf), 1)


@query("o3_engine_compare", f"""WITH {ENGINE_RUNS} SELECT doc_id, """ + ", ".join(
    f"max(full_text) FILTER (engine = '{e}') AS {e}_text, max(duration_sec) FILTER (engine = '{e}') AS {e}_duration_sec, max(error) FILTER (engine = '{e}') AS {e}_error"
    for e in ("alpha", "beta", "gamma")) + " FROM engine_runs GROUP BY doc_id")
def o3(spark, sf):
    return O.engine_compare(X.engine_runs(spark, sf), ["alpha", "beta", "gamma"])


@query("o4_engine_report", f"""WITH {ENGINE_RUNS}
SELECT doc_id, string_agg('=== ' || upper(engine) || ' ===' || chr(10) || printf('duration_sec: %.3f', duration_sec) || chr(10) || 'full_text:' || chr(10)
 || coalesce(nullif({strip('full_text')}, ''), '<no text>') || chr(10), chr(10) ORDER BY priority) AS report FROM engine_runs GROUP BY doc_id""")
def o4(spark, sf):
    return O.engine_report(X.engine_runs(spark, sf))


@query("o4_engine_durations", f"""WITH {ENGINE_RUNS}
SELECT engine, count(*) AS n, round(avg(duration_sec), 6) AS mean_sec, round(min(duration_sec), 6) AS min_sec, round(max(duration_sec), 6) AS max_sec,
 round(quantile_cont(duration_sec, 0.5), 6) AS median_sec, count(*) FILTER (length({strip('full_text')}) >= 1) AS n_with_text FROM engine_runs GROUP BY engine""")
def o4d(spark, sf):
    d = O.engine_durations(X.engine_runs(spark, sf))
    return d.select("engine", "n", "n_with_text", *[F.round(c, 6).alias(c) for c in ("mean_sec", "min_sec", "max_sec", "median_sec")])


@query("o5_union_missing_lines", f"""WITH {OCR_LINES},
a AS (SELECT doc_id, line_no, text FROM ocr_lines WHERE length(text) < 150),
b AS (SELECT doc_id, text, min(line_no) AS line_no FROM ocr_lines GROUP BY ALL),
e AS (SELECT doc_id, max(line_no) + 1 AS e FROM a GROUP BY 1)
SELECT doc_id, line_no, text, 'first' AS origin FROM a
UNION ALL SELECT b.doc_id, CAST(coalesce(e, 0) + line_no AS INTEGER), text, 'second' FROM b LEFT JOIN e USING (doc_id)
 WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.text = b.text)""")
def o5(spark, sf):
    """An extractor that only sees short lines, completed by one that sees all."""
    lines = X.ocr_lines(spark, sf).select("doc_id", "line_no", "text")
    return L.union_missing_lines(lines.filter(F.length("text") < 150), lines)


def _tsv_sql(sep, extra):
    return f"""WITH {TSV}
SELECT doc_id, CAST(block_num AS INTEGER) AS block_num, par_num, CAST(line_num AS INTEGER) AS line_num, min(line_no::BIGINT * 1000000 + word_no) AS first_seen,
 string_agg({strip('text')}, '{sep}' ORDER BY "left", word_no) AS text{extra} FROM tsv WHERE length({strip('text')}) > 0 GROUP BY doc_id, block_num, par_num, line_num"""


_TSV_BOX = """, min("left") AS x1, min(top) AS y1, max("left" + width) AS x2, max(top + height) AS y2, avg(conf) FILTER (conf >= 0) AS confidence"""


def _tsv(spark, sf):
    return X.tsv_words(spark, sf).withColumn("ord", F.col("line_no").cast("bigint") * 1000000 + F.col("word_no"))


@query("o6_group_tsv_lines", _tsv_sql(" ", _TSV_BOX))
def o6(spark, sf):
    return O.group_tsv_lines(_tsv(spark, sf), "ord")


@query("o6v_group_tsv_text_only", _tsv_sql(" ", ""))
def o6v(spark, sf):
    return O.group_tsv_lines(_tsv(spark, sf), "ord").drop("x1", "y1", "x2", "y2", "confidence")


@query("l15_table_rows", _tsv_sql(" | ", ""))
def l15(spark, sf):
    return O.group_tsv_lines(_tsv(spark, sf), "ord", " | ").drop("x1", "y1", "x2", "y2", "confidence")


@query("o14_doc_metrics", f"""WITH {WORD_CELLS},
w AS (SELECT doc_id, count(*) AS n FROM word_cells GROUP BY 1),
l AS (SELECT doc_id, text, list_filter([{strip('x')} for x in regexp_split_to_array(text, '[\\r\\n]+')], lambda y: y <> '') AS p FROM documents),
k AS (SELECT doc_id, line, min(pos) AS pos FROM (SELECT doc_id, trim(regexp_replace(unnest(p), '\\s+', ' ', 'g')) AS line, generate_subscripts(p, 1) AS pos FROM l) GROUP BY ALL),
kk AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS n FROM k GROUP BY 1)
SELECT l.doc_id, CAST(len(p) AS INTEGER) AS n_lines, CAST(length(text) AS INTEGER) AS n_chars, coalesce(kk.n, 0)::DOUBLE / greatest(1, length(text)) AS kept_share,
 coalesce(w.n, 0) AS n_words, coalesce(w.n, 0) AS n_boxes FROM l LEFT JOIN w USING (doc_id) LEFT JOIN kk USING (doc_id)""")
def o14(spark, sf):
    return O.doc_metrics(X.documents(spark, sf), X.words(spark, sf))


# --- polygons ----------------------------------------------------------------------------------

@query("o12_normalize_polygon", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 50) + 0.5::DOUBLE AS x, CAST(l_suppkey AS DOUBLE) AS y, 10.0::DOUBLE + l_linenumber AS w, 20.0::DOUBLE AS h FROM lineitem),
r AS (SELECT *, CAST(round_even(x, 0) AS INT) AS x1, CAST(round_even(x + w, 0) AS INT) AS x2, CAST(round_even(y, 0) AS INT) AS y1, CAST(round_even(y + h, 0) AS INT) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x1 || ',' || y1 || ' ' || x2 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x1 || ',' || y2 AS xywh,
 x1 || ',' || y1 || ' ' || x2 || ',' || y1 || ' ' || x2 || ',' || y2 || ' ' || x1 || ',' || y2 AS xyxy,
 x1 || ',' || y1 || ' ' || x2 || ',' || y1 || ' ' || x2 || ',' || y2 AS flat, x1 || ',' || y1 || ' ' || x2 || ',' || y2 AS pairs,
 '0,' || y1 || ' ' || x2 || ',' || y2 AS points, x2 || ',' || y2 AS points_zero FROM r""")
def o12(spark, sf):
    t = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ((F.col("l_partkey") % 50) + F.lit(0.5)).alias("x"), F.col("l_suppkey").cast("double").alias("y"),
        (F.lit(10.0) + F.col("l_linenumber")).alias("w"), F.lit(20.0).alias("h"))
    x, y = F.col("x"), F.col("y")
    x2, y2 = x + F.col("w"), y + F.col("h")
    pts = F.array(F.struct(F.lit(0.0).alias("x"), y.alias("y")), F.struct(x2.alias("x"), y2.alias("y")))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        poly(G.polygon_from_xywh(x, y, F.col("w"), F.col("h"))).alias("xywh"), poly(G.polygon_from_xyxy(F.array(x, y, x2, y2))).alias("xyxy"),
        poly(G.polygon_from_flat(F.array(x, y, x2, y, x2, y2))).alias("flat"),
        poly(G.polygon_from_pairs(F.array(F.array(x, y), F.array(x), F.array(x2, y2)))).alias("pairs"),
        poly(G.polygon_from_points(pts)).alias("points"), poly(G.polygon_from_points(pts, "zero")).alias("points_zero"))


@query("o13_parse_polygon_string", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_linenumber % 4 WHEN 0 THEN l_partkey || ',' || l_suppkey || ' ' || (l_partkey + 9) || ',' || (-l_suppkey)
   WHEN 1 THEN l_partkey || ',1 2,3 4,5 6,' || l_suppkey WHEN 2 THEN l_partkey || ',2;' || l_suppkey || ',4'
   ELSE l_partkey::VARCHAR END AS polys, CAST(CASE WHEN l_linenumber % 4 = 2 THEN 2 ELSE 1 END AS INTEGER) AS n FROM lineitem""")
def o13(spark, sf):
    """Two points on consecutive lines; four groups set apart by empty lines; two polygons; a number too long for a coordinate."""
    t = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_linenumber") % 4
    s = F.when(k == 0, F.format_string("[%d %d]\n[%d, -%d]", "l_partkey", "l_suppkey", F.col("l_partkey") + 9, "l_suppkey"))
    s = s.when(k == 1, F.format_string("[%d 1]\n\n[2 3]\n\n[4 5]\n\n[6 %d]", "l_partkey", "l_suppkey"))
    s = s.when(k == 2, F.format_string("[[%d 2]]\n\n[[%d 4]]", "l_partkey", "l_suppkey"))
    s = s.otherwise(F.format_string("[%d 99999999999%d]", "l_partkey", "l_suppkey"))
    p = G.polygons_from_string(s)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(F.transform(p, poly), ";").alias("polys"), F.size(p).alias("n"))


# --- sources and sinks -------------------------------------------------------------------------

@query("s1_scan_files", f"""WITH {FILES}
SELECT path, modificationTime, length, CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) ELSE '' END AS ext
FROM files WHERE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'tiff', 'bmp', 'pdf')""")
def s1(spark, sf):
    return R.allowed_files(X.files(spark, sf)).select("path", "modificationTime", "length", "ext")


@query("s3_payload", """SELECT doc_id, sha256(text) AS text_hash, sha256('data:image/png;base64,' || to_base64(encode(text))) AS uri_hash FROM documents""")
def s3(spark, sf):
    d = X.documents(spark, sf)
    uri = T.encode_data_uri(F.encode("text", "UTF-8"), F.lit("png"))
    d = d.select("doc_id", uri.alias("uri"))
    return d.select("doc_id", F.sha2(T.decode_payload(F.col("uri")), 256).alias("text_hash"), F.sha2("uri", 256).alias("uri_hash"))


@query("s4_results_json", f"""WITH {SCORES}
SELECT doc_id, best_type, CAST(score AS INTEGER) AS score FROM (SELECT best.doc_id, best_type, scores.score FROM best JOIN scores ON scores.doc_id = best.doc_id AND scores.doc_type = best_type) WHERE score > 0""")
def s4(spark, sf):
    return S.results_to_write(K.classify(X.scans(spark, sf))).select("doc_id", "best_type", "score")


@query("s5_route_results", f"""WITH {SCORES},
r AS (SELECT best.doc_id, best_type, coalesce(scores.score, 0) AS score, 'scan_' || best.doc_id || '.v1' AS stem FROM best LEFT JOIN scores ON scores.doc_id = best.doc_id AND scores.doc_type = best_type)
SELECT doc_id, CASE WHEN best_type <> 'UNKNOWN' THEN 'main' ELSE 'Others' END AS route, CASE WHEN best_type <> 'UNKNOWN' THEN stem ELSE 'other_' || stem END || '.json' AS out_name FROM r""")
def s5(spark, sf):
    k = S.with_top_score(K.classify(X.scans(spark, sf))).withColumn("file_name", F.concat(F.lit("scan "), F.col("doc_id").cast("string"), F.lit(".v1.png")))
    return S.route_results(k).select("doc_id", "route", "out_name")


@query("s5_route_under_minimum", f"""WITH {SCORES},
r AS (SELECT doc_id, arg_max(doc_type, score * 10 - type_ord) AS top_type, max(score) AS score FROM scores GROUP BY doc_id)
SELECT doc_id, top_type AS best_type, score, CASE WHEN score >= CASE top_type WHEN 'BANK_STATEMENT' THEN 4 ELSE 3 END THEN 'main' ELSE 'Others' END AS route,
 CASE WHEN score >= CASE top_type WHEN 'BANK_STATEMENT' THEN 4 ELSE 3 END THEN '' ELSE 'other_' END || 'scan_' || doc_id || '.v1.json' AS out_name FROM r""")
def s5m(spark, sf):
    """Documents under the type of their highest score, acceptable or not, so that the minimum decides their route."""
    k = K.classify(X.scans(spark, sf))
    top = F.array_max(F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["type_ord"]).alias("o"), s["doc_type"].alias("doc_type"))))
    k = k.select("doc_id", top.alias("t")).select("doc_id", F.col("t.doc_type").alias("best_type"), F.col("t.score").alias("score"))
    k = k.withColumn("file_name", F.concat(F.lit("scan "), F.col("doc_id").cast("string"), F.lit(".v1.png")))
    return S.route_results(k).select("doc_id", "best_type", "score", "route", "out_name")


@query("s9_label_rows", """SELECT l_orderkey, l_linenumber, l_partkey, 'img_' || l_orderkey || '.jpg' AS image, CAST(l_partkey % 600 AS INTEGER) AS x0, CAST(l_suppkey % 800 AS INTEGER) AS y0,
 CAST(l_partkey % 600 + 50 AS INTEGER) AS x1, CAST(l_suppkey % 800 + 40 AS INTEGER) AS y1, 640 AS width, CASE WHEN l_linenumber = 3 THEN NULL ELSE 480 END AS height FROM lineitem""")
def s9(spark, sf):
    t = X.table(spark, sf, "lineitem")
    row = F.format_string("img_%d.jpg,%d,%d,%d,%d,640,%s", "l_orderkey", F.col("l_partkey") % 600, F.col("l_suppkey") % 800,
                          F.col("l_partkey") % 600 + 50, F.col("l_suppkey") % 800 + 40, F.when(F.col("l_linenumber") == 3, "tall").otherwise("480"))
    return R.parse_label_rows(t.select("l_orderkey", "l_linenumber", "l_partkey", row.alias("value")))


@query("s10_stage_request", f"""WITH {SCORES}, {FILES}, j AS (SELECT f.*, b.best_type, sc.text, substr(sha256(path || '#' || length || '#run-1'), 1, 12) AS txn_id
  FROM files f JOIN best b USING (doc_id) JOIN scans sc USING (doc_id))
SELECT txn_id, strftime(modificationTime, '%Y%m%d_%H%M%S') AS "timestamp", path AS filename, best_type AS document_type, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
 CAST(length(text) AS INTEGER) AS n_chars, CAST(NULL AS VARCHAR) AS error FROM j""")
def s10(spark, sf):
    f = P.assign_txn(X.files(spark, sf), "run-1")
    docs = X.scans(spark, sf).join(f, "doc_id").select("doc_id", "text", "path", "modificationTime", "txn_id")
    d = docs.join(K.classify(docs.select("doc_id", "text")).select("doc_id", "best_type"), "doc_id")
    return P.stage_request(d).select("txn_id", "timestamp", "filename", "document_type", "n_lines", "n_chars", "error")


def _staged(spark, sf):
    f = P.assign_txn(X.files(spark, sf), "run-1")
    return X.scans(spark, sf).join(f, "doc_id")


_NAMED = f"""n0 AS (SELECT *, substr(sha256(path || '#' || length || '#run-1'), 1, 12) AS txn_id,
  regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9_.-]', '_', 'g') AS clean FROM files),
n1 AS (SELECT *, CASE WHEN regexp_matches(clean, '^\\.*[^.].*\\.[^.]*$') THEN regexp_extract(clean, '^(.*)\\.[^.]*$', 1) ELSE clean END AS stem FROM n0),
named AS (SELECT n1.*, sc.text, stem || '_' || txn_id AS base_dir, stem || '_' || strftime(modificationTime, '%Y%m%d_%H%M%S') AS stamped
  FROM n1 JOIN scans sc USING (doc_id))"""


@query("s10_detection", f"""WITH {SCANS}, {FILES}, {_NAMED}
SELECT txn_id, strftime(modificationTime, '%Y%m%d_%H%M%S') AS "timestamp", path AS filename,
 CASE WHEN doc_id % 9 = 0 THEN 0 ELSE len(w) END AS words_count, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE len(w) - (len(w) + 6) // 7 END AS boxes_count,
 base_dir || '/OCR_IMAGE/' || stamped || '.png' AS annotated_image_path, base_dir || '/OCR_SORTED/' || stamped || '.txt' AS sorted_text_path
FROM (SELECT *, string_split(replace(text, chr(10), ' '), ' ') AS w FROM named)""")
def s10d(spark, sf):
    """Scans with a word per token, every seventh without a box, and no words for some scans."""
    d = _staged(spark, sf)
    box = F.array(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")))
    w = d.filter("doc_id % 9 <> 0").select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("pos", "word"))
    return P.stage_detection(d, w.select("doc_id", F.when(F.col("pos") % 7 != 0, box).alias("vertices")))


@query("s10_response", f"""WITH {SCORES}, {FILES}, {_NAMED},
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM named),
unique_lines AS (SELECT doc_id, regexp_replace(trim(l), ' +', ' ', 'g') AS l, min(i) AS i FROM raw_lines GROUP BY ALL)
SELECT txn_id, best_type AS document_type, string_agg(l, chr(10) ORDER BY i) AS detected_text, any_value(base_dir) || '/OCR_SORTED/' || any_value(stamped) || '.txt' AS sorted_text_path
FROM named JOIN best USING (doc_id) JOIN unique_lines USING (doc_id) GROUP BY txn_id, best_type""")
def s10r(spark, sf):
    d = _staged(spark, sf)
    d = d.join(K.classify(d.select("doc_id", "text")).select("doc_id", "best_type"), "doc_id")
    return P.stage_response(d).withColumn("detected_text", F.array_join("detected_text", "\n"))


@query("s11_error_record", f"""WITH {ENGINE_RUNS}, {SCORES},
o AS (SELECT d.doc_id, (SELECT arg_min(engine, priority) FROM engine_runs e WHERE e.doc_id = d.doc_id AND length({strip('full_text')}) >= 4) AS engine,
  (SELECT max(error) FROM engine_runs e WHERE e.doc_id = d.doc_id) AS err FROM documents d)
SELECT o.doc_id, CASE WHEN engine IS NULL THEN 'ERROR' ELSE coalesce(best_type, 'UNKNOWN') END AS document_type,
 CASE WHEN engine IS NULL THEN coalesce(err, 'no engine returned text') END AS error FROM o LEFT JOIN best USING (doc_id)""")
def s11(spark, sf):
    runs = X.engine_runs(spark, sf)
    types = K.classify(X.scans(spark, sf)).select("doc_id", "best_type")
    return P.error_record(O.engine_fallback(runs), runs, types)


@query("m7_documents_from_lines", f"""WITH {OCR_LINES},
k AS (SELECT doc_id, {strip('text')} AS t, min(line_no) AS n FROM ocr_lines WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]') GROUP BY ALL)
SELECT doc_id, string_agg(t, chr(10) ORDER BY n) AS text, CAST(count(*) AS INTEGER) AS n_lines FROM k GROUP BY doc_id""")
def m7(spark, sf):
    d = P.documents_from_lines(X.ocr_lines(spark, sf))
    return d.select("doc_id", "text", F.size("lines").alias("n_lines"))


@query("c_classify_lines", f"WITH {SCORES} SELECT doc_id, best_type FROM best")
def c_lines(spark, sf):
    """The upload job: lines as an engine lists them, cleaned, joined and classified."""
    lines = X.scans(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return P.classify_lines(lines).select("doc_id", "best_type")


@query("c_read_and_classify", f"""WITH {SCORES},
st AS (SELECT doc_id, string_agg(doc_type || '=' || score, ',' ORDER BY type_ord) AS scores FROM scores GROUP BY doc_id)
SELECT doc_id, best_type, st.scores FROM best JOIN st USING (doc_id) WHERE doc_id % 20 <> 0""")
def c_read(spark, sf):
    """Scans that one of two engines could read, classified."""
    i, text = F.col("doc_id"), F.col("text")

    def run(engine, priority, full_text):
        return F.struct(F.lit(engine).alias("engine"), F.lit(priority).alias("priority"), full_text.alias("full_text"),
                        F.lit(0.1).alias("duration_sec"), F.lit(None).cast("string").alias("error"))

    runs = F.array(run("alpha", 1, F.when(i % 10 != 0, text)), run("gamma", 2, F.when(i % 20 == 0, "  ").otherwise(text)))
    d = X.scans(spark, sf).select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.*")
    s = F.transform("scores", lambda s: F.concat_ws("=", s["doc_type"], s["score"].cast("string")))
    return P.read_and_classify(d).select("doc_id", "best_type", F.array_join(s, ",").alias("scores"))


@query("c_read_and_classify_texts")
def c_read_texts(spark, sf):
    """Documents (even ids) as their engines read them, and scans (odd ids) that one engine read."""
    runs = X.engine_runs(spark, sf).withColumn("doc_id", 2 * F.col("doc_id"))
    scans = X.scans(spark, sf).select(
        (2 * F.col("doc_id") + 1).alias("doc_id"), F.lit("alpha").alias("engine"), F.lit(1).alias("priority"),
        F.col("text").alias("full_text"), F.lit(0.1).alias("duration_sec"), F.lit(None).cast("string").alias("error"))
    return shown(P.read_and_classify(runs.unionByName(scans)))
