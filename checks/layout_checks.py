"""Comparison queries for reading order and page regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlbase import BOXES, WORD_CELLS
from docketry import fixtures as X
from docketry.functions import geometry as G
from docketry.operators import layout as L
from docketry.plans import layout as PL
from docketry.sources import sinks as S

QUERIES, SQL = {}, {}
PAGE_W, PAGE_H = 840, 960


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


GEO = f"""{WORD_CELLS},
geo AS (SELECT doc_id, page, word_id, text, CAST("left" AS DOUBLE) AS x_left, CAST(top AS DOUBLE) AS y_top, CAST(top + height AS DOUBLE) AS y_bottom,
  top + height / 2 AS y_center, CAST(greatest(1, height) AS DOUBLE) AS height, "left" + width / 2 AS cx, top + height / 2 AS cy FROM word_cells),
tol AS (SELECT doc_id, page, median(height) AS median_height, CAST(greatest(10, round_even(median(height) * 0.6::DOUBLE, 0)) AS INTEGER) AS tolerance FROM geo GROUP BY ALL)"""


def geo(spark, sf):
    return L.word_boxes(X.words(spark, sf))


@query("l1_word_geometry", f"WITH {GEO} SELECT doc_id, word_id, x_left, y_top, y_bottom, y_center, height, cx, cy FROM geo")
def l1(spark, sf):
    return geo(spark, sf).drop("page", "text")


@query("l2_line_tolerance", f"WITH {GEO} SELECT doc_id, page, median_height, tolerance FROM tol")
def l2(spark, sf):
    return L.line_tolerance(geo(spark, sf))


# levels separated by more than the tolerance start afresh; inside such a stretch the rule is run level by level
LINES = f"""RECURSIVE {GEO},
lev AS (SELECT doc_id, page, y_center, count(*) AS n FROM geo GROUP BY ALL),
gap AS (SELECT lev.*, tolerance, CASE WHEN y_center - lag(y_center) OVER w > tolerance THEN 1 ELSE 0 END AS opens FROM lev JOIN tol USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y_center)),
seg AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y_center) AS s FROM gap),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, s ORDER BY y_center) AS k FROM seg),
fold AS (
 SELECT doc_id, page, s, k, y_center, tolerance, [{{'t': y_center * n, 'n': n}}] AS ls, 1 AS pos FROM num WHERE k = 1
 UNION ALL
 SELECT doc_id, page, s, k, y_center, tolerance,
  CASE WHEN pos > len(ls) THEN list_append(ls, {{'t': y_center * n, 'n': n}})
   ELSE list_transform(ls, lambda l, i: CASE WHEN i = pos THEN {{'t': l.t + y_center * n, 'n': l.n + n}} ELSE l END) END AS ls, pos
 FROM (SELECT c.doc_id, c.page, c.s, c.k, c.y_center, c.n, c.tolerance, f.ls,
    coalesce(list_position(list_transform(f.ls, lambda l: abs(c.y_center - l.t / l.n) <= c.tolerance), true), len(f.ls) + 1) AS pos
   FROM fold f JOIN num c ON c.doc_id = f.doc_id AND c.page = f.page AND c.s = f.s AND c.k = f.k + 1)),
placed AS (SELECT doc_id, page, y_center, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY s, pos) - 1 AS INTEGER) AS line_key FROM fold)"""


@query("l3_group_lines", f"WITH {LINES} SELECT doc_id, word_id, line_key FROM geo JOIN placed USING (doc_id, page, y_center)")
def l3(spark, sf):
    return L.group_lines(geo(spark, sf)).select("doc_id", "word_id", "line_key")


GAP = f"""{GEO}, lev AS (SELECT doc_id, page, y_center FROM geo GROUP BY ALL),
g AS (SELECT lev.*, CASE WHEN y_center - lag(y_center) OVER w > tolerance THEN 1 ELSE 0 END AS opens FROM lev JOIN tol USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y_center)),
placed AS (SELECT doc_id, page, y_center, CAST(sum(opens) OVER (PARTITION BY doc_id, page ORDER BY y_center) AS INTEGER) AS line_key FROM g)"""


@query("l3g_group_lines_gap", f"WITH {GAP} SELECT doc_id, word_id, line_key FROM geo JOIN placed USING (doc_id, page, y_center)")
def l3g(spark, sf):
    return L.group_lines_gap(geo(spark, sf)).select("doc_id", "word_id", "line_key")


@query("l3_line_agreement", f"""WITH {LINES}, pg AS (SELECT doc_id, page, y_center, CAST(s AS INTEGER) AS line_key FROM seg)
SELECT doc_id, page, count(*) AS n_words, count(*) FILTER (WHERE placed.line_key = pg.line_key) AS n_same FROM geo JOIN placed USING (doc_id, page, y_center) JOIN pg USING (doc_id, page, y_center) GROUP BY ALL""")
def l3a(spark, sf):
    g = geo(spark, sf)
    return L.line_agreement(L.group_lines(g), L.group_lines_gap(g))


_LT = "lt AS (SELECT doc_id, page, line_key, avg(y_center) AS center, trim(string_agg(text, ' ' ORDER BY {order}), ' ') AS text FROM {src} GROUP BY ALL)"
_OUT = "SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY center, line_key) AS INTEGER) AS line_ord, center, text FROM lt"


@query("l4_order_in_line", f"WITH {LINES}, {_LT.format(order='x_left, y_center, word_id', src='geo JOIN placed USING (doc_id, page, y_center)')} SELECT doc_id, page, line_key, text FROM lt")
def l4(spark, sf):
    g = L.group_lines(geo(spark, sf))
    w = F.sort_array(F.collect_list(F.struct("x_left", "y_center", "word_id", "text")))
    lines = g.groupBy("doc_id", "page", "line_key").agg(w.alias("ws"))
    return lines.select("doc_id", "page", "line_key", F.trim(F.array_join(F.col("ws")["text"], " ")).alias("text"))


@query("l5_baseline_order", f"""WITH {LINES},
g2 AS (SELECT *, coalesce(regr_slope(cy, cx) OVER w, 0) AS m, stddev_pop(cx) OVER w AS sd, count(*) OVER w AS c FROM geo JOIN placed USING (doc_id, page, y_center) WINDOW w AS (PARTITION BY doc_id, page, line_key)),
g3 AS (SELECT *, CASE WHEN c < 2 OR sd <= 1e-8 THEN x_left ELSE (cx + m * cy) / sqrt(1 + m * m) END AS proj FROM g2),
{_LT.format(order='proj, y_center, word_id', src='g3')} {_OUT}""")
def l5(spark, sf):
    return L.sorted_lines(L.group_lines(geo(spark, sf)), baseline=True)


_SORTED = f"WITH {LINES}, {_LT.format(order='x_left, y_center, word_id', src='geo JOIN placed USING (doc_id, page, y_center)')}"


@query("l6_sorted_lines", f"{_SORTED} {_OUT}")
def l6(spark, sf):
    return L.sorted_lines(L.group_lines(geo(spark, sf)))


@query("l6v_sorted_lines_by_top", f"""WITH {LINES}, lt AS (SELECT doc_id, page, line_key, avg(y_center) AS center, round_even(min(y_top), 0) AS top, trim(string_agg(text, ' ' ORDER BY x_left, y_center, word_id), ' ') AS text
  FROM geo JOIN placed USING (doc_id, page, y_center) GROUP BY ALL)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY top, line_key) AS INTEGER) AS line_ord, center, text FROM lt""")
def l6v(spark, sf):
    return L.sorted_lines(L.group_lines(geo(spark, sf)), keep_empty=True, by="top")


@query("s6_sorted_text", f"{_SORTED} SELECT doc_id, string_agg(text, chr(10) ORDER BY center, line_key) AS content FROM lt GROUP BY doc_id")
def s6(spark, sf):
    return S.document_text(L.sorted_lines(L.group_lines(geo(spark, sf))))


# --- boxes -------------------------------------------------------------------------------------

def iou_sql(a, b):
    inter = (f"greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x))::BIGINT * "
             f"greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))")
    return f"(({inter})::DOUBLE / ({a}w::BIGINT * {a}h + {b}w * {b}h - {inter}))"


_FILTERED = f"w * h >= 3000 AND w * h <= 30000 AND w >= 10 AND h >= 10 AND NOT (w > 0.98 * 200 AND h > 0.98 * 150)"


@query("l7_box_filter", f"WITH {BOXES} SELECT page_id, box_no FROM boxes WHERE {_FILTERED}")
def l7(spark, sf):
    return L.box_filter(X.boxes(spark, sf), 200, 150, 3000, 30000).select("page_id", "box_no")


@query("l7_area_ratio", f"WITH {BOXES} SELECT page_id, box_no FROM boxes WHERE w * h / {float(PAGE_W * PAGE_H)} >= 0.02")
def l7r(spark, sf):
    return L.area_ratio_filter(X.boxes(spark, sf), PAGE_W, PAGE_H).select("page_id", "box_no")


@query("l8_iou", f"""WITH {BOXES}, e AS (SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1)
SELECT a.page_id, a.box_no, {iou_sql('a.', 'e.')} AS iou FROM boxes a JOIN e USING (page_id)""")
def l8(spark, sf):
    """Each box against the extent of its page's boxes."""
    b = X.boxes(spark, sf).select("page_id", "box_no", *L.BOX)
    e = b.groupBy("page_id").agg(F.min("x").alias("e_x"), F.min("y").alias("e_y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("e_w"),
                                 (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("e_h"))
    j = b.join(e, "page_id")
    return j.select("page_id", "box_no", G.iou(L._box(), L._box("e_")).alias("iou"))


# one growing box per step: the next box in order that overlaps it joins, else the first unused box becomes the next seed
MERGE = """ord AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_no) AS k FROM {src}),
pg AS (SELECT page_id, list({{'no': box_no, 'x1': x, 'y1': y, 'x2': x + w, 'y2': y + h}} ORDER BY box_no) AS bs FROM {src} GROUP BY 1),
mg AS (
 SELECT page_id, bs[2:] AS rest, bs[1].no AS seed, bs[1] AS g, 1 AS i, 1 AS n, NULL::BIGINT AS done, NULL::STRUCT(no BIGINT, x1 INTEGER, y1 INTEGER, x2 INTEGER, y2 INTEGER) AS out_box, 0 AS out_n FROM pg
 UNION ALL
 SELECT page_id,
  CASE WHEN fin THEN rest[2:] WHEN hit THEN list_concat(rest[1:i - 1], rest[i + 1:]) ELSE rest END,
  CASE WHEN fin THEN rest[1].no ELSE seed END,
  CASE WHEN fin THEN rest[1] WHEN hit THEN {{'no': seed, 'x1': least(g.x1, b.x1), 'y1': least(g.y1, b.y1), 'x2': greatest(g.x2, b.x2), 'y2': greatest(g.y2, b.y2)}} ELSE g END,
  CASE WHEN fin THEN 1 WHEN hit THEN i ELSE i + 1 END, CASE WHEN fin THEN 1 WHEN hit THEN n + 1 ELSE n END,
  CASE WHEN fin THEN seed END, CASE WHEN fin THEN g END, CASE WHEN fin THEN n ELSE 0 END
 FROM (SELECT *, i > len(rest) AS fin, coalesce(inter::DOUBLE / ((g.x2 - g.x1)::BIGINT * (g.y2 - g.y1) + (b.x2 - b.x1)::BIGINT * (b.y2 - b.y1) - inter) > 0.1, false) AS hit
   FROM (SELECT *, rest[i] AS b, greatest(0, least(g.x2, rest[i].x2) - greatest(g.x1, rest[i].x1))::BIGINT * greatest(0, least(g.y2, rest[i].y2) - greatest(g.y1, rest[i].y1)) AS inter FROM mg WHERE g IS NOT NULL))),
merged AS (SELECT page_id, done AS box_no, out_box.x1 AS x, out_box.y1 AS y, out_box.x2 - out_box.x1 AS w, out_box.y2 - out_box.y1 AS h, out_n AS n_merged FROM mg WHERE done IS NOT NULL)"""


@query("l9_merge_overlaps", f"WITH RECURSIVE {BOXES}, {MERGE.format(src='boxes')} SELECT * FROM merged")
def l9(spark, sf):
    return L.merge_overlaps(X.boxes(spark, sf))


# a page's boxes with their labels: labels spread between overlapping boxes, then groups become their bounding boxes
_HIT = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))::BIGINT * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "((a.x2 - a.x1)::BIGINT * (a.y2 - a.y1) + (b.x2 - b.x1)::BIGINT * (b.y2 - b.y1))"
COMPONENTS = f"""mc AS (
 SELECT page_id, list({{'no': box_no, 'x1': x, 'y1': y, 'x2': x + w, 'y2': y + h, 'n': 1::BIGINT, 'l': box_no}} ORDER BY box_no) AS bs, false AS fin FROM boxes GROUP BY 1
 UNION ALL
 SELECT page_id, CASE WHEN list_transform(now, lambda b: b.l) = list_transform(bs, lambda b: b.l) THEN
   list_transform(list_sort(list_distinct(list_transform(now, lambda b: b.l))), lambda k: {{'no': k,
    'x1': list_min(list_transform(list_filter(now, lambda b: b.l = k), lambda b: b.x1)), 'y1': list_min(list_transform(list_filter(now, lambda b: b.l = k), lambda b: b.y1)),
    'x2': list_max(list_transform(list_filter(now, lambda b: b.l = k), lambda b: b.x2)), 'y2': list_max(list_transform(list_filter(now, lambda b: b.l = k), lambda b: b.y2)),
    'n': list_sum(list_transform(list_filter(now, lambda b: b.l = k), lambda b: b.n))::BIGINT, 'l': k}}) ELSE now END,
  list_transform(now, lambda b: b.l) = list_transform(bs, lambda b: b.no)
 FROM (SELECT page_id, bs, list_transform(bs, lambda a: {{'no': a.no, 'x1': a.x1, 'y1': a.y1, 'x2': a.x2, 'y2': a.y2, 'n': a.n,
   'l': list_min(list_transform(list_filter(bs, lambda b: a.no = b.no OR {_HIT} > 0 AND {_HIT}::DOUBLE / ({_AREA} - {_HIT}) > 0.1), lambda b: b.l))}}) AS now
  FROM mc WHERE NOT fin)),
parts AS (SELECT page_id, unnest(bs) AS b FROM mc WHERE fin)"""


@query("l9c_merge_components", f"WITH RECURSIVE {BOXES}, {COMPONENTS} SELECT page_id, b.no AS box_no, b.x1 AS x, b.y1 AS y, b.x2 - b.x1 AS w, b.y2 - b.y1 AS h, b.n AS n_merged FROM parts")
def l9c(spark, sf):
    return L.merge_components(X.boxes(spark, sf))


@query("l9p_overlap_pairs", f"""WITH {BOXES}
SELECT a.page_id, a.box_no AS a_box_no, b.box_no AS b_box_no, {iou_sql('a.', 'b.')} AS iou FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_no < b.box_no WHERE {iou_sql('a.', 'b.')} > 0.1""")
def l9p(spark, sf):
    return L.overlap_pairs(X.boxes(spark, sf))


ADJ = """o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, box_no) AS k, count(*) OVER (PARTITION BY page_id) AS c FROM boxes),
ad AS (
 SELECT page_id, k, c, x AS mx, y AS my, w AS mw, h AS mh, 1 AS r, 1 AS n FROM o WHERE k = 1
 UNION ALL
 SELECT page_id, k, c, CASE WHEN j THEN least(mx, x) ELSE x END, CASE WHEN j THEN least(my, y) ELSE y END,
  CASE WHEN j THEN greatest(mx + mw, x + w) - least(mx, x) ELSE w END, CASE WHEN j THEN greatest(my + mh, y + h) - least(my, y) ELSE h END,
  CASE WHEN j THEN r ELSE r + 1 END, CASE WHEN j THEN n + 1 ELSE 1 END
 FROM (SELECT o.*, mx, my, mw, mh, r, n, x < mx + mw + 10 AND y < my + mh + 10 AS j FROM ad JOIN o ON o.page_id = ad.page_id AND o.k = ad.k + 1)),
reg AS (SELECT page_id, r, arg_max(mx, k) AS x, arg_max(my, k) AS y, arg_max(mw, k) AS w, arg_max(mh, k) AS h, max(n) AS n_merged FROM ad GROUP BY ALL)"""


@query("l10_merge_adjacent", f"WITH RECURSIVE {BOXES}, {ADJ} SELECT page_id, x, y, w, h, n_merged FROM reg")
def l10(spark, sf):
    return L.merge_adjacent(X.boxes(spark, sf)).drop("strip", "region_no")


_PAD = f"""greatest(0, x - CAST(round_even(w * 0.02::DOUBLE, 0) AS INTEGER)) AS x1, greatest(0, y - CAST(round_even(h * 0.02::DOUBLE, 0) AS INTEGER)) AS y1,
 least({PAGE_W}, x + w + CAST(round_even(w * 0.02::DOUBLE, 0) AS INTEGER)) AS x2, least({PAGE_H}, y + h + CAST(round_even(h * 0.02::DOUBLE, 0) AS INTEGER)) AS y2"""


@query("l11_pad_clamp", f"WITH {BOXES} SELECT page_id, box_no, {_PAD} FROM boxes")
def l11(spark, sf):
    b = X.boxes(spark, sf)
    return b.select("page_id", "box_no", G.pad_clamp(*L._box(), F.lit(PAGE_W), F.lit(PAGE_H)).alias("p")).select("page_id", "box_no", "p.*")


@query("l12_suppress_overlaps", f"""WITH {BOXES} SELECT page_id, box_no FROM boxes a WHERE kind = 'text_block' AND NOT EXISTS (
 SELECT 1 FROM boxes b WHERE b.page_id = a.page_id AND b.kind = 'table' AND {iou_sql('a.', 'b.')} > 0.3)""")
def l12(spark, sf):
    b = X.boxes(spark, sf)
    return L.suppress_overlaps(b.filter("kind = 'text_block'"), b.filter("kind = 'table'")).select("page_id", "box_no")


@query("l13_photo_rule", f"WITH {BOXES} SELECT page_id, box_no FROM boxes WHERE n_words < 5 AND (variance > 200 OR colourfulness > 10)")
def l13(spark, sf):
    return L.photo_rule(X.boxes(spark, sf)).select("page_id", "box_no")


@query("l14_number_segments", f"""WITH {BOXES}
SELECT page_id, box_no, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'table' THEN 0 WHEN 'text_block' THEN 1 ELSE 2 END, y, x, box_no) AS id FROM boxes""")
def l14(spark, sf):
    return L.number_segments(X.boxes(spark, sf).withColumnRenamed("kind", "type")).select("page_id", "box_no", "id")


@query("l16_page_children", f"""WITH RECURSIVE {BOXES.replace('boxes AS', 'every AS')}, boxes AS (SELECT * FROM every WHERE w * h / {float(PAGE_W * PAGE_H)} >= 0.02), {ADJ},
p AS (SELECT DISTINCT l_orderkey AS page_id FROM lineitem)
SELECT p.page_id, coalesce(CAST(r AS BIGINT), 1) AS child_no, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1, coalesce(x2, {PAGE_W}) AS x2, coalesce(y2, {PAGE_H}) AS y2
FROM p LEFT JOIN (SELECT page_id, r, {_PAD} FROM reg) USING (page_id)""")
def l16(spark, sf):
    b = X.boxes(spark, sf)
    regions = L.merge_adjacent(L.area_ratio_filter(b, PAGE_W, PAGE_H))
    return L.page_children(b.select("page_id").distinct(), regions, PAGE_W, PAGE_H)


SEG = f"""RECURSIVE {BOXES}, tx AS (SELECT * FROM boxes WHERE kind = 'text_block' AND w * h >= 300 AND w >= 10 AND h >= 10 AND NOT (w > 0.98 * {PAGE_W} AND h > 0.98 * {PAGE_H})),
{MERGE.format(src='tx')},
seg AS (SELECT page_id, box_no, 'table' AS type, x, y, w, h, 0 AS o FROM boxes WHERE kind = 'table'
 UNION ALL SELECT page_id, box_no, 'text_block', x, y, w, h, 1 FROM merged a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page_id = a.page_id AND b.kind = 'table' AND {iou_sql('a.', 'b.')} > 0.3)
 UNION ALL SELECT page_id, box_no, 'photo', x, y, w, h, 2 FROM boxes WHERE kind = 'photo' AND w * h >= 1000 AND n_words < 5 AND (variance > 200 OR colourfulness > 10)),
sg AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o, y, x, box_no) AS id, type, x, y, w, h FROM seg)"""


@query("l_segment_pages", f"WITH {SEG} SELECT * FROM sg")
def segs(spark, sf):
    return PL.segment_pages(X.boxes(spark, sf), PAGE_W, PAGE_H)


@query("s7_tables_csv", f"WITH {SEG} SELECT 'page_' || page_id || '.png' AS filename, id AS segment, x || ' | ' || y || ' | ' || w || ' | ' || h AS \"row\" FROM sg WHERE type = 'table'")
def s7(spark, sf):
    """Rows handed to the CSV writer: one per table segment."""
    s = PL.segment_pages(X.boxes(spark, sf), PAGE_W, PAGE_H).filter("type = 'table'")
    return s.select(F.format_string("page_%d.png", "page_id").alias("filename"), F.col("id").alias("segment"),
                    F.concat_ws(" | ", *[F.col(c).cast("string") for c in L.BOX]).alias("row"))


@query("s8_manifest", f"""WITH {SEG} SELECT 'page_' || page_id || '.png' AS filename, count(*) AS n_segments,
 string_agg(id || ':' || type || ':' || x || ',' || y || ',' || w || ',' || h, ';' ORDER BY id) AS segments FROM sg GROUP BY page_id""")
def s8(spark, sf):
    m = PL.manifests(PL.segment_pages(X.boxes(spark, sf), PAGE_W, PAGE_H))
    one = lambda s: F.concat_ws(":", s["id"].cast("string"), s["type"], F.array_join(F.transform(s["bbox"], lambda v: v.cast("string")), ","))
    return m.select("filename", "n_segments", F.array_join(F.transform("segments", one), ";").alias("segments"))


NMS = f"""o AS (SELECT page_id, kind, box_no, x, y, w, h, row_number() OVER (PARTITION BY page_id, kind ORDER BY score DESC, box_no) AS k FROM boxes),
nm AS (
 SELECT page_id, kind, k, [{{'box_no': box_no, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM o WHERE k = 1
 UNION ALL
 SELECT o.page_id, o.kind, o.k, CASE WHEN len(list_filter(kept, lambda b: {iou_sql('b.', 'o.')} > 0.7)) > 0 THEN kept
   ELSE list_append(kept, {{'box_no': o.box_no, 'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}}) END
 FROM nm JOIN o ON o.page_id = nm.page_id AND o.kind = nm.kind AND o.k = nm.k + 1),
fin AS (SELECT page_id, kind, arg_max(kept, k) AS kept FROM nm GROUP BY ALL)"""


@query("v2n_nms", f"WITH RECURSIVE {BOXES}, {NMS} SELECT page_id, kind, unnest(kept).box_no AS box_no FROM fin")
def v2n(spark, sf):
    return L.nms(X.boxes(spark, sf))
