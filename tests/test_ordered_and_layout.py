import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import geometry as G
from docketry.operators import layout as L
from docketry.operators.graph import components
from docketry.operators import ocr as O
from docketry.operators.ordered import Rule, fold_sorted, ordered_scan


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_ordered_scan_equals_plain_windows(spark, size):
    """Any chunk size gives what one window over the whole key gives."""
    rng = random.Random(size)
    rows = []
    for key in range(3):
        pos = 0
        for _ in range(60):
            pos += rng.choice([1, 1, 2, 9])
            rows.append((key, pos, rng.random() < 0.6, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "k int, p bigint, f boolean, v int")
    got = ordered_scan(
        df, ["k"], ["p"], F.expr(f"p div {size}"), prev=["v"], runs={"run": F.col("f")}, counts={"n": F.col("f")},
        breaks={"far": lambda last, now: now["p"] - last["p"] > 1},
    )
    w = Window.partitionBy("k").orderBy("p")
    e = df.withColumns({"row_no": F.row_number().over(w), "prev_v": F.lag("v").over(w), "g": F.sum((~F.col("f")).cast("int")).over(w)})
    e = e.withColumn("n", F.sum(F.col("f").cast("int")).over(w))
    e = e.withColumn("far", F.sum(F.coalesce(F.col("p") - F.lag("p").over(w) > 1, F.lit(False)).cast("int")).over(w))
    first = F.when(F.col("g") == 0, F.lit(0)).otherwise(F.lit(1))
    e = e.withColumn("run_pos", F.when(F.col("f"), F.row_number().over(Window.partitionBy("k", "g").orderBy("p")) - first).otherwise(0))
    e = e.withColumn("run_before", F.coalesce(F.lag("run_pos").over(w), F.lit(0)))
    cols = ["k", "p", "f", "v", "row_no", "prev_v", "run_pos", "run_before", "n", "far"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, [r for r in e.select(*cols).collect()]))


def test_hot_key_is_spread(spark):
    df = spark.range(0, 40000).select(F.lit(1).alias("k"), F.col("id").alias("p"))
    plan = ordered_scan(df, ["k"], ["p"], F.expr("p div 1000"), counts={"n": F.col("p") % 2 == 0})
    assert plan.agg(F.max("row_no"), F.max("n")).first() == (40000, 20000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in text.split("Exchange hashpartitioning(")[1].split(")")[0]


class _Sum(Rule):
    def start(self):
        self.total = 0

    def row(self, v):
        self.total += v
        return ()

    def finish(self):
        return [(self.total,)]


def test_fold_keeps_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 100).select((F.col("id") % 3).alias("k"), "id")
        got = dict(fold_sorted(df, ["k"], ["id"], ["id"], _Sum, "k bigint, total bigint").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: sum(i for i in range(100) if i % 3 == k) for k in range(3)}


# --- lines -------------------------------------------------------------------------------------

def naive_lines(ws, multiplier=0.6, minimum=10):
    """Words (id, y, height) one by one: the first line whose running mean is near takes the word."""
    tol = max(minimum, round(statistics.median(h for _, _, h in ws) * multiplier))
    lines, out = [], {}
    for i, y, _ in sorted(ws, key=lambda t: (t[1], t[0])):
        for n, line in enumerate(lines):
            if abs(y - sum(line) / len(line)) <= tol:
                line.append(y)
                out[i] = n
                break
        else:
            lines.append([y])
            out[i] = len(lines) - 1
    return out


def boxes_df(spark, pages):
    rows = [(d, 0, i, str(i), float(i), y, h, float(i), y) for d, ws in pages.items() for i, y, h in ws]
    return spark.createDataFrame(rows, "doc_id bigint, page int, word_id bigint, text string, x_left double, y_center double, height double, cx double, cy double")


def test_lines_against_word_by_word_rule(spark):
    rng = random.Random(11)
    pages = {d: [(i, rng.randint(0, 400) / 2, float(rng.choice([8, 20, 21, 35]))) for i in range(rng.randint(1, 90))] for d in range(25)}
    got = {}
    for r in L.group_lines(boxes_df(spark, pages)).collect():
        got.setdefault(r["doc_id"], {})[r["word_id"]] = r["line_key"]
    for d, ws in pages.items():
        assert got[d] == naive_lines(ws), d


def test_tolerance_edges(spark):
    b = boxes_df(spark, {1: [(0, 0.0, 25.0), (1, 1.0, 25.0)], 2: [(0, 0.0, 10.0), (1, 1.0, 11.0)]})
    tol = {r["doc_id"]: r["tolerance"] for r in L.line_tolerance(b).collect()}
    assert tol == {1: 15, 2: 10}
    # a word exactly at the tolerance joins, one beyond it does not
    same = L.group_lines(boxes_df(spark, {1: [(0, 0.0, 10.0), (1, 10.0, 10.0)]})).select("line_key").distinct().count()
    other = L.group_lines(boxes_df(spark, {1: [(0, 0.0, 10.0), (1, 10.5, 10.0)]})).select("line_key").distinct().count()
    assert (same, other) == (1, 2)


def test_gap_variant_can_differ(spark):
    chain = {1: [(i, i * 8.0, 10.0) for i in range(6)]}
    exact, gap = L.group_lines(boxes_df(spark, chain)), L.group_lines_gap(boxes_df(spark, chain))
    assert exact.select("line_key").distinct().count() > gap.select("line_key").distinct().count() == 1
    agreement = L.line_agreement(exact, gap).first()
    assert agreement["n_words"] == 6 and 0 < agreement["n_same"] < 6


def test_order_in_line_and_baseline(spark):
    rows = [(1, 0, 0, "c", 30.0, 10.0, 10.0, 30.0, 13.0), (1, 0, 1, "a", 10.0, 10.0, 10.0, 10.0, 11.0), (1, 0, 2, "b", 20.0, 10.0, 10.0, 20.0, 12.0),
            (2, 0, 0, "x", 5.0, 1.0, 10.0, 5.0, 1.0), (2, 0, 1, "y", 5.0, 2.0, 10.0, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, word_id bigint, text string, x_left double, y_center double, height double, cx double, cy double")
    for baseline in (False, True):
        got = {r["doc_id"]: r["text"] for r in L.sorted_lines(L.group_lines(df), baseline).collect()}
        assert got == {1: "a b c", 2: "x y"}


# --- boxes -------------------------------------------------------------------------------------

def iou(a, b):
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, iw) * max(0, ih)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0


def naive_merge(bs, t=0.1):
    bs = [(x, y, x + w, y + h) for _, x, y, w, h in sorted(bs)]
    used, out = set(), []
    for i in range(len(bs)):
        if i in used:
            continue
        g = bs[i]
        for j in range(i + 1, len(bs)):
            if j not in used and iou(g, bs[j]) > t:
                g = (min(g[0], bs[j][0]), min(g[1], bs[j][1]), max(g[2], bs[j][2]), max(g[3], bs[j][3]))
                used.add(j)
        out.append((g[0], g[1], g[2] - g[0], g[3] - g[1]))
    return sorted(out)


def naive_adjacent(bs, gap=10):
    out = []
    for _, x, y, w, h in sorted(bs, key=lambda b: (b[2], b[1], b[0])):
        if out:
            mx, my, mw, mh = out[-1]
            if x < mx + mw + gap and y < my + mh + gap:
                nx, ny = min(mx, x), min(my, y)
                out[-1] = (nx, ny, max(mx + mw, x + w) - nx, max(my + mh, y + h) - ny)
                continue
        out.append((x, y, w, h))
    return sorted(out)


def naive_nms(bs, scores, t=0.7):
    kept = []
    for b in sorted(bs, key=lambda b: (-scores[b[0]], b[0])):
        r = (b[1], b[2], b[1] + b[3], b[2] + b[4])
        if all(iou(r, k) <= t for _, k in kept):
            kept.append((b[0], r))
    return sorted(n for n, _ in kept)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    out = {}
    for p in range(30):
        side = rng.choice([120, 400, 1500])
        out[p] = [(n, rng.randint(0, side), rng.randint(0, side), rng.randint(1, 120), rng.randint(1, 120)) for n in range(rng.randint(1, 40))]
    # touching boxes, containment, a chain in which the growing box reaches further, copies
    out[100] = [(0, 0, 0, 10, 10), (1, 10, 0, 10, 10), (2, 0, 10, 10, 10)]
    out[101] = [(0, 0, 0, 100, 100), (1, 10, 10, 50, 50)]
    out[102] = [(0, 0, 0, 20, 20), (1, 30, 0, 20, 20), (2, 10, 0, 30, 20)]
    out[103] = [(n, 5, 5, 10, 10) for n in range(5)]
    out[104] = [(0, 0, 0, 10, 10), (1, 0, 19, 10, 10), (2, 0, 39, 10, 10)]
    return out


def page_df(spark, pages):
    rows = [(p, n, x, y, w, h, "text", ((n * 7919) % 11) / 11.0) for p, bs in pages.items() for n, x, y, w, h in bs]
    return spark.createDataFrame(rows, "page_id bigint, box_no bigint, x int, y int, w int, h int, kind string, score double")


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r["page_id"], []).append((r["x"], r["y"], r["w"], r["h"]))
    return {p: sorted(v) for p, v in out.items()}


def test_merge_overlaps(spark, pages):
    assert by_page(L.merge_overlaps(page_df(spark, pages)).collect()) == {p: naive_merge(b) for p, b in pages.items()}


def test_merge_adjacent(spark, pages):
    assert by_page(L.merge_adjacent(page_df(spark, pages)).collect()) == {p: naive_adjacent(b) for p, b in pages.items()}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7])
def test_nms(spark, pages, threshold):
    got = {}
    for r in L.nms(page_df(spark, pages), threshold=threshold).collect():
        got.setdefault(r["page_id"], []).append(r["box_no"])
    scores = {n: ((n * 7919) % 11) / 11.0 for n in range(60)}
    assert {p: sorted(v) for p, v in got.items()} == {p: naive_nms(b, scores, threshold) for p, b in pages.items()}


@pytest.mark.parametrize("cell", [16, 128, 4000])
def test_overlap_pairs_any_grid(spark, pages, cell):
    got = {(r[0], r[1], r[2]) for r in L.overlap_pairs(page_df(spark, pages), 0.1, cell).select("page_id", "a_box_no", "b_box_no").collect()}
    want = set()
    for p, bs in pages.items():
        for a in bs:
            for b in bs:
                if a[0] < b[0] and iou((a[1], a[2], a[1] + a[3], a[2] + a[4]), (b[1], b[2], b[1] + b[3], b[2] + b[4])) > 0.1:
                    want.add((p, a[0], b[0]))
    assert got == want


def naive_components(bs, t):
    """Bounding boxes of connected boxes, again and again."""
    now = [(n, (x, y, x + w, y + h), 1) for n, x, y, w, h in bs]
    while True:
        root = {n: n for n, _, _ in now}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for i, (n, r, _) in enumerate(now):
            for m, q, _ in now[i + 1:]:
                if iou(r, q) > t:
                    a, b = find(n), find(m)
                    root[max(a, b)] = min(a, b)
        groups = {}
        for n, r, k in now:
            g = groups.setdefault(find(n), [r, 0])
            g[0] = (min(g[0][0], r[0]), min(g[0][1], r[1]), max(g[0][2], r[2]), max(g[0][3], r[3]))
            g[1] += k
        if len(groups) == len(now):
            return sorted((n, r[0], r[1], r[2] - r[0], r[3] - r[1], k) for n, r, k in now)
        now = [(n, g[0], g[1]) for n, g in groups.items()]


@pytest.mark.parametrize("threshold", [0.02, 0.3])
def test_merge_components(spark, pages, threshold):
    few = {p: b for p, b in pages.items() if p % 3 == 0 or p >= 100}
    got = {}
    for r in L.merge_components(page_df(spark, few), threshold).collect():
        got.setdefault(r["page_id"], []).append((r["box_no"], r["x"], r["y"], r["w"], r["h"], r["n_merged"]))
    assert {p: sorted(v) for p, v in got.items()} == {p: naive_components(b, threshold) for p, b in few.items()}


def test_components_of_chains_and_random_graphs(spark):
    rng = random.Random(3)
    order = rng.sample(range(1000), 300)
    edges = [(1, a, b) for a, b in zip(order, order[1:])] + [(1, 2000 + i, 2001 + i) for i in range(0, 40)]
    edges += [(2, rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    got = {(r.k, r.node): r.root for r in components(spark.createDataFrame(edges, "k int, a long, b long"), ["k"], "a", "b").collect()}
    root = {(k, n): (k, n) for k, a, b in edges for n in (a, b)}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a, b in edges:
        a, b = find((k, a)), find((k, b))
        root[max(a, b)] = min(a, b)
    assert got == {n: find(n)[1] for n in root}


def big_page(n, width, seed=1, step=9):
    """One connected strip: boxes along a line, each overlapping the next ones, in random order of score."""
    rng = random.Random(seed)
    return [(i, i * step, rng.randint(0, 5), width, 40) for i in range(n)]


@pytest.mark.parametrize("scores", ["random", "falling"])
@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_nms_of_one_connected_strip(spark, scores, threshold):
    bs = big_page(600, 60)
    score = {b[0]: random.Random(b[0]).random() if scores == "random" else 1 - b[0] / 1000 for b in bs}
    df = spark.createDataFrame([(1, *b, "text", score[b[0]]) for b in bs], page_df(spark, {}).schema)
    got = L.nms(df, threshold=threshold, strip=20).collect()
    assert sorted(r["box_no"] for r in got) == naive_nms(bs, score, threshold)


def test_nms_of_a_hundred_thousand_boxes(spark):
    n = F.col("id")
    df = spark.range(100_000).select(
        F.lit(1).cast("bigint").alias("page_id"), n.alias("box_no"), (n * 9).cast("int").alias("x"), (n % 5).cast("int").alias("y"),
        F.lit(60).alias("w"), F.lit(40).alias("h"), F.lit("text").alias("kind"), (F.xxhash64("id") % 100003 / 100003).alias("score"))
    kept = L.nms(df).count()
    assert 100_000 / 5 < kept < 100_000 / 1.5


def test_ten_thousand_equal_boxes(spark):
    rows = spark.range(10_000).select(
        F.lit(1).cast("bigint").alias("page_id"), F.col("id").alias("box_no"), *[F.lit(v).alias(c) for c, v in zip(L.BOX, (5, 5, 300, 300))])
    more = spark.createDataFrame([(1, 20_000, 5, 5, 300, 290), (1, 20_001, 900, 900, 5, 5)], rows.schema)
    got = [tuple(r) for r in L.overlap_classes(rows.unionByName(more)).select("a_box_no", "b_box_no", "a_count", "b_count").collect()]
    assert sorted(got) == [(0, 0, 10_000, 10_000), (0, 20_000, 10_000, 1)]
    merged = L.merge_components(rows.unionByName(more)).collect()
    assert sorted((r["box_no"], r["n_merged"]) for r in merged) == [(0, 10_001), (20_001, 1)]


def test_crowded_cells_are_split(spark):
    rng = random.Random(6)
    bs = [(n, rng.randint(100, 140), rng.randint(100, 140), rng.randint(1, 12), rng.randint(1, 12)) for n in range(300)] + [(300, 0, 0, 500, 500)]
    df = page_df(spark, {1: bs})
    split = {(r[0], r[1]) for r in L.overlap_classes(df, 0.1, 128, crowd=20).select("a_box_no", "b_box_no").collect()}
    assert split == {(r[0], r[1]) for r in L.overlap_classes(df, 0.1, 4000).select("a_box_no", "b_box_no").collect()} and len(split) > 100


def test_pieces_are_cut_until_nothing_separates(spark):
    # columns of rows of columns: every cut separates only the next level
    bs, n = [], 0
    for i in range(3):
        for j in range(3):
            for k in range(4):
                bs.append((n, 200 * i + (50 * k if j % 2 else 0), 300 * i + 60 * j + (0 if j % 2 else 14 * k), 40, 10))
                n += 1
    df = page_df(spark, {1: bs}).select("page_id", "box_no", *L.BOX)
    fine = L.split_pieces(df, ["page_id"], large=1).groupBy("piece").count().count()
    assert fine == len(bs) >= L.split_pieces(df, ["page_id"]).groupBy("piece").count().count()
    assert by_page(L.merge_overlaps(page_df(spark, {1: bs})).collect()) == {1: naive_merge(bs)}


def test_suppress_is_the_complement(spark, pages):
    df = page_df(spark, pages)
    tables, texts = df.filter("box_no % 3 = 0"), df.filter("box_no % 3 <> 0")
    kept = {(r["page_id"], r["box_no"]) for r in L.suppress_overlaps(texts, tables).collect()}
    rect = lambda b: (b[1], b[2], b[1] + b[3], b[2] + b[4])
    want = {(p, b[0]) for p, bs in pages.items() for b in bs if b[0] % 3 and not any(iou(rect(b), rect(t)) > 0.3 for t in bs if t[0] % 3 == 0)}
    assert kept == want


def test_pad_and_iou_edges(spark):
    df = spark.createDataFrame([(0, 0, 25, 75, 25, 75)], "x int, y int, w int, h int, pw int, ph int")
    box = tuple(F.col(c) for c in "xywh")
    r = df.select(G.pad_clamp(*box, F.col("pw"), F.col("ph")).alias("p"), G.iou(box, box).alias("same"),
                  G.iou((F.lit(0),) * 4, (F.lit(0),) * 4).alias("empty")).first()
    # 0.5 rounds to 0 and 1.5 to 2 (half to even); both ends stay on the page
    assert tuple(r["p"]) == (0, 0, 25, 75) and r["same"] == 1 and r["empty"] == 0
    r = df.select(G.pad_clamp(F.lit(10), F.lit(10), F.lit(25), F.lit(75), F.lit(100), F.lit(100)).alias("p")).first()
    assert tuple(r["p"]) == (10, 8, 35, 87)


def test_page_without_regions_is_its_own_child(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id bigint")
    df = page_df(spark, {1: [(0, 10, 10, 100, 100)]})
    rows = {r["page_id"]: (r["child_no"], r["x1"], r["x2"]) for r in L.page_children(pages, L.merge_adjacent(df), 500, 500).collect()}
    assert rows == {1: (1, 8, 112), 2: (1, 0, 500)}


# --- responses ---------------------------------------------------------------------------------

def test_annotation_places(spark):
    fta = '{"text": "t", "pages": []}'
    docs = [
        (1, '{"results": [{"Data": {"responses": [{"fullTextAnnotation": %s}]}}]}' % fta, "results.Data.responses"),
        (2, '{"fullTextAnnotation": %s}' % fta, "fullTextAnnotation"), (3, '{"data": {"fullTextAnnotation": %s}}' % fta, "data"),
        (4, '{"payload": {"fullTextAnnotation": %s}}' % fta, "payload"), (5, '{"results": [{"fullTextAnnotation": %s}]}' % fta, "results"),
        (6, fta, "bare"), (7, '{"a": [{"b": {"c": %s}}]}' % fta, "search"), (8, '{"a": 1}', None), (9, "not json", None), (10, None, None),
    ]
    df = spark.createDataFrame([(i, p) for i, p, _ in docs], "doc_id bigint, payload string")
    rows = O.read_annotations(df).collect()
    assert {r["doc_id"]: r["wrapper"] for r in rows} == {i: w for i, _, w in docs}
    assert all((r["fta"] is not None and r["fta"]["text"] == "t") == (r["wrapper"] is not None) for r in rows)
    assert {r["doc_id"] for r in O.rejected(O.read_annotations(df)).collect()} == {8, 9, 10}


def test_responses_from_batches(spark, tmp_path):
    """Responses are made in Arrow batches, of a text that is null, empty or blank, has quotes, escapes or wide characters alike."""
    import json
    from docketry import fixtures as X

    texts = ['say "hi" \\ there\n\n  two  blanks \U0001f600 z\u00e9\x01\nfour five six seven eight nine ten \t"\\x\nlast', "", " \n ", None]
    rows = [(n, t, "en", "s") for n in (0, 1, 2, 3, 4, 5, 7, 10, 15, 23, 47, 71, -2, None) for t in texts]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = X.annotations(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "to_json" not in plan
    rem = lambda a, b: -(-a % b) if a < 0 else a % b

    def box(x1, y1, x2, y2):
        return {"vertices": [{"x": x, "y": y} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]}

    def annotation(n, text):
        def word(i, j, w):
            y = 100 + 40 * i + rem(n * 7 + i * 3 + j * 5, 9)
            own = {"text": w} if j % 7 else {"symbols": [{"text": c, "confidence": 0.5} for c in w]}
            own |= {"confidence": rem(n + j, 128) / 128} if j % 5 else {}
            return own | {"boundingBox": box(10 + 60 * j, y, 60 + 60 * j, y + 20 + rem(j * 3 + n, 7))}

        paged, shape = n is not None and rem(n, 6) != 4, rem(n, 6) if n is not None else None
        if n is None or text is None:
            return {"pages": [{}]} if paged else {}
        ps, groups = [], {}
        for i, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if any(parts):
                p = ({"text": line} if shape in (1, 3) else {}) | ({"confidence": 0.9} if i % 5 == 0 else {})
                p |= {"words": [word(i, j, w) for j, w in enumerate(parts) if w]} if shape in (0, 2, 4) else {}
                ps.append(p | {"boundingBox": box(10, 100 + 40 * i, 60 * len(parts), 130 + 40 * i)})
                groups.setdefault(i // 3, []).append((line, ps[-1]))
        key = {0: "paragraphs", 1: "paragraphs", 2: "lines", 3: "lines"}.get(shape)
        blocks = [
            ({key: [p for _, p in g]} if key else {"text": "\n".join(x for x, _ in g)} if shape == 5 else {})
            | {"boundingBox": box(0, b * 120, 900, b * 120 + 119)} for b, g in groups.items()]
        return ({"text": text} if n % 3 == 0 else {}) | ({"pages": [{"blocks": blocks}]} if paged else {"paragraphs": ps})

    def wrapped(n, fta):
        if n is None or n % 48 == 7:
            return {"items": [{"odd": fta}]} if n is None else {"data": [{"note": {"text": "x"}}, {"fullTextAnnotation": fta}]}
        held = {"fullTextAnnotation": fta}
        return {0: held, 1: {"data": held}, 2: {"results": [{"Data": {"responses": [held]}}]}}.get(rem(n, 4), {"items": [{"odd": fta}]})

    key = lambda x: (str(x[0]), x[1])
    plain = lambda x: json.dumps(x, sort_keys=True)
    got = [(r["doc_id"], r["payload"]) for r in df.collect()]
    assert len(got) == len(rows)
    whole = sorted(((n, plain(json.loads(p))) for n, p in got if n not in (23, 47, 71)), key=key)
    assert whole == sorted(((n, plain(wrapped(n, annotation(n, t)))) for n, t, _, _ in rows if n not in (23, 47, 71)), key=key)
    assert {p for n, p in got if n == 23} == {'{"status": "failed"}'} and {p for n, p in got if n == 71} == {"[" * 60_000 + "]" * 60_000}
    assert {'{"data": {}, "cut": "}', '{"data": {"t":""}, "cut": ""text":""}'} <= {p for n, p in got if n == 47}


def test_batches_to_search_are_cut_by_payload(spark):
    """Every payload is sent, so that the bytes of a batch bound the rows that wait for it; only unusual ones are searched."""
    payloads = ['{"data": {"fullTextAnnotation": {"text": "a"}}}', '{"odd": [{"text": "b"}]}', "{", None]
    df = O.read_annotations(spark.createDataFrame(list(enumerate(payloads)), "doc_id int, payload string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "_search_json(payload#" in plan
    assert {r["doc_id"]: (r["wrapper"], r["fta"] and r["fta"]["text"]) for r in df.collect()} == {0: ("data", "a"), 1: ("search", "b"), 2: (None, None), 3: (None, None)}


def test_texts_are_read_without_boxes(spark):
    """A transcript is the same from an annotation read without boxes, and its query reads it that way."""
    import __spark_entry__ as entry
    from docketry.schemas import ANNOTATION_TEXTS

    word = '{"text": %s, "symbols": [{"text": "s", "confidence": 1}], "boundingBox": {"vertices": [{"x": 1, "y": 2}]}}'
    payloads = ['{"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [%s, %s]}, {"description": "d"}]}, {}]}]}}' % (word % '"w"', word % "null"),
                '{"data": {"fullTextAnnotation": {"text": "own", "paragraphs": [{"text": "p"}, null]}}}', '{"text": "t", "pages": null}', "{}", None]
    df = spark.createDataFrame(list(enumerate(payloads)), "doc_id int, payload string")
    rows = [sorted(map(tuple, O.combined_text(O.read_annotations(df, **how).filter("fta IS NOT NULL")).collect()), key=str) for how in ({}, {"schema": ANNOTATION_TEXTS})]
    assert rows[0] == rows[1] and rows[0][0][2].startswith("--- paragraph_001 (page 1 block 1) ---\nw s\n\n")
    plan = entry.queries()["o15_combined_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "boundingBox" not in plan


def test_words_are_trimmed_and_rounded_without_patterns(spark):
    """Corners at half a pixel go to the even one and white space of any kind is cut, by expressions that need no pattern or decimal."""
    box = '"boundingBox": {"vertices": [{"x": 0.5, "y": 1.5}, {"x": -2.5, "y": 2.4999}, {"x": 3}]}'
    payload = '{"fullTextAnnotation": {"pages": [{"blocks": [{"words": [{"text": "\\u2003 a b\\u0085\\n", %s}, {"text": "\\u00a0", %s}]}]}]}}' % (box, box)
    df = O.explode_words(O.read_annotations(spark.createDataFrame([(1, payload)], "doc_id int, payload string")))
    r = df.collect()
    assert [(x["word_no"], x["text"], [tuple(p) for p in x["vertices"]]) for x in r] == [(0, "a b", [(0, 2), (-2, 2)])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "bround" not in plan and "regexp_replace" not in plan


def test_polygon_shapes(spark):
    df = spark.createDataFrame([("[1 2]\n[3 -4]", [0.5, 1.5, 2.5, 3.5])], "s string, n array<double>")
    poly = lambda c: [(p["x"], p["y"]) for p in df.select(c).first()[0]]
    assert [[(p["x"], p["y"]) for p in q] for q in df.select(G.polygons_from_string(F.col("s"))).first()[0]] == [[(1, 2), (3, -4)]]
    assert poly(G.polygon_from_xyxy(F.col("n"))) == [(0, 2), (2, 2), (2, 4), (0, 4)]
    assert df.select(G.polygon_from_flat(F.col("n"))).first()[0] is None
    pts = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y")), F.struct(F.lit(2.0).alias("x"), F.lit(None).cast("double").alias("y")))
    assert poly(G.polygon_from_points(pts)) == [(0, 1)] and poly(G.polygon_from_points(pts, "zero")) == []


def test_engine_choice(spark):
    rows = [(1, "a", 1, "abc"), (1, "b", 2, "abcd"), (2, "a", 1, None), (2, "b", 2, "  "), (3, "a", 1, "long text"), (3, "b", 2, "longer text")]
    df = spark.createDataFrame(rows, "doc_id int, engine string, priority int, full_text string")
    assert {r["doc_id"]: r["engine"] for r in O.engine_fallback(df).collect()} == {1: "b", 2: None, 3: "a"}
    assert {r["doc_id"]: r["engine"] for r in O.engine_fallback(df, 1).collect()} == {1: "a", 2: None, 3: "a"}


def test_words_of_lines_are_shuffled_once(spark):
    """Besides the narrow rows that lines are found from, words move once, by page; lines and texts need no further shuffle."""
    df = boxes_df(spark, {1: [(0, 0.0, 10.0), (1, 100.0, 10.0)]})
    for baseline in (False, True):
        plan = L.sorted_lines(L.group_lines(df), baseline)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
    plan = L.group_lines_gap(df).select("word_id", "line_key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lines_of_pages_with_nulls(spark):
    """Pages of one document are apart; a word without a centre is in no line but its height counts; no page, no line."""
    rows = [(1, 1, 0, 5.0, 10.0), (1, 2, 1, 90.0, 10.0), (1, 1, 2, 5.0, 10.0), (1, 1, 3, 40.0, 10.0), (1, 1, 4, None, 1.0),
            (1, None, 5, 5.0, 10.0), (None, 1, 6, 5.0, 10.0), (2, 1, 7, 14.0, None), (2, 1, 8, 24.0, None), (2, 1, 9, 31.0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, word_id bigint, y_center double, height double")
    exact = {r["word_id"]: r["line_key"] for r in L.group_lines(df).collect()}
    gap = {r["word_id"]: r["line_key"] for r in L.group_lines_gap(df).collect()}
    assert exact == {0: 0, 2: 0, 3: 1, 1: 0, 7: 0, 8: 0, 9: 1}
    assert gap == {0: 0, 2: 0, 3: 1, 1: 0, 7: 0, 8: 0, 9: 0}


def test_small_and_large_pages_merge_alike(spark):
    """A page goes through the same rounds in one task as by joins; pages with nulls and repeated numbers as well."""
    rng = random.Random(5)
    rows = [(p, n, rng.randint(0, 90), rng.randint(0, 90), rng.randint(0, 40), rng.randint(0, 40)) for p in range(40) for n in range(rng.randint(1, 12))]
    rows += [(3, 2, 200, 200, 5, 5), (None, 1, 0, 0, 9, 9), (None, 2, 1, 0, 9, 9), (50, 1, None, 0, 9, 9), (50, None, 0, 0, 9, 9), (50, None, 4, 0, 9, 9)]
    df = spark.createDataFrame(rows, "page_id bigint, box_no bigint, x int, y int, w int, h int")
    results = [sorted(map(str, L.merge_components(df, small=n).collect())) for n in (0, 6, 64)]
    assert results[0] == results[1] == results[2] and len(results[0]) < len(rows)


def test_landmark_box_scales_outermost_points_only(spark):
    """The box of the earlier rule, point by point, for either sign of the scale and with points missing."""
    points = [(0.5, 0.25), (0.1, 0.9), None, (0.75, None)]
    rows = [(points, 100, 200), (points, -100, 200), ([], 100, 200), (None, 100, 200)]
    df = spark.createDataFrame(rows, "l array<struct<x:double,y:double>>, w int, h int")
    box = df.select(G.landmark_box(F.col("l"), F.col("w"), F.col("h")).alias("b")).select("b.*")
    assert "lambda" not in box._jdf.queryExecution().executedPlan().toString()
    none = (None,) * 6
    assert [tuple(r) for r in box.collect()] == [(10, 50, 65, 130, 42, 115), (-75, 50, 65, 130, -43, 115), none, none]


def odd_boxes(spark):
    """Small and larger pages with equal rectangles, repeated rows, boxes without an area, and nulls."""
    rng = random.Random(8)
    rows = [(p, n, rng.randint(0, 70), rng.randint(0, 70), rng.randint(0, 40), rng.randint(0, 40), rng.choice("ab"), rng.randint(0, 3) / 4)
            for p in range(30) for n in range(rng.randint(1, 25))]
    rows += rows[::7] + [(p, n + 100, *box, k, s) for p, n, *box, k, s in rows[::5]]
    rows += [(None, 1, 0, 0, 9, 9, "a", 0.5), (None, 2, 0, 0, 9, 9, "a", 0.5), (40, 1, None, 0, 9, 9, "a", 0.5), (40, 2, 0, 0, 9, 9, None, 0.5),
             (40, 3, 0, 0, 9, 9, "a", None), (40, 4, 0, 0, 9, 8, "a", 0.9), (40, None, 60, 60, 9, 9, "b", 0.1), (40, 5, 61, 60, 9, 9, "b", 0.2)]
    return spark.createDataFrame(rows, "page_id bigint, box_no bigint, x int, y int, w int, h int, kind string, score double")


def test_pairs_of_small_pages_need_one_shuffle(spark):
    """Pages compared box by box and by grid cells give the same pairs; on small pages boxes move once and are not put into cells."""
    df = odd_boxes(spark)
    results = [sorted(map(str, L.overlap_pairs(df, small=n).collect())) for n in (0, 12, 64)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 100
    pairs = L.overlap_pairs(df)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "Generate" not in plan


@pytest.mark.parametrize("threshold", [0.6, 1.0])
def test_small_groups_are_suppressed_by_one_shuffle(spark, threshold):
    """Groups gone through whole and those cut into pieces keep the same boxes; boxes of small groups move once."""
    df = odd_boxes(spark).filter("box_no IS NOT NULL")
    results = [sorted(map(str, L.nms(df, threshold=threshold, strip=n).collect())) for n in (12, 64)]
    assert results[0] == results[1] and len(results[0]) > 100
    plan = L.nms(df, threshold=threshold)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_large_groups_are_found_by_all_keys(spark):
    rows = [(1, "a")] * 3 + [(1, "b")] * 2 + [(2, "a")] * 2 + [(3, "c")] * 4
    df = spark.createDataFrame(rows, "page_id bigint, kind string")
    assert sorted(map(tuple, L._large_keys(df, ["page_id", "kind"], 2).collect())) == [(1, "a"), (3, "c")]
    assert sorted(map(tuple, L._large_keys(df, ["page_id"], 4).collect())) == [(1,)]


def test_agreement_moves_no_word_again(spark):
    """Words are matched by number with all their repeats, where both groupings have put them: by page, even if that is one value."""
    points = [F.struct(F.lit(x).alias("x"), (F.col("y") + y).alias("y")) for x, y in ((0, 0), (9, 0), (9, 10), (0, 10))]
    rows = [(1, i, i * 8) for i in range(6)] + [(1, 3, 24), (1, 4, 0), (1, None, 0), (2, 7, 0), (None, 8, 0)]
    words = spark.createDataFrame(rows, "doc_id bigint, word_id bigint, y int").select(
        "doc_id", F.lit(0).alias("page"), "word_id", F.lit("t").alias("text"), F.array(*points).alias("vertices"))
    boxes = L.word_boxes(words)
    exact, gap = L.group_lines(boxes), L.group_lines_gap(boxes)
    agreement = L.line_agreement(exact, gap)
    pairs = [(a["doc_id"], a["line_key"] == b["line_key"]) for a in exact.collect() for b in gap.collect()
             if a["doc_id"] is not None and a["word_id"] is not None and (a["doc_id"], a["word_id"]) == (b["doc_id"], b["word_id"])]
    want = {d: (sum(p[0] == d for p in pairs), sum(p == (d, True) for p in pairs)) for d in (1, 2)}
    assert {r["doc_id"]: (r["n_words"], r["n_same"]) for r in agreement.collect()} == want and want[1][0] == 12 > want[1][1]
    plan = agreement._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan


def test_word_arrays_of_texts_without_words(spark, tmp_path):
    """A text without words has no polygon or score to leave out."""
    from docketry import fixtures as X

    rows = [(i, t, "en", "s") for i, t in enumerate(["", " ", "\n \n", None, "a", "", "b c"])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["word_no"], r["text"], r["confidence"]) for r in O.zip_word_arrays(X.word_arrays(spark, str(tmp_path))).collect())
    assert got == [(4, 0, "a", None), (6, 0, "b", 6 / 128)]
