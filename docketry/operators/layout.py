"""Reading order and regions from box geometry.

Two facts keep the order-dependent rules parallel and exact.

* Words with one and the same vertical centre always join the same line, so line building only needs
  the distinct centres of a page ("levels") with their counts.  Centres are taken top to bottom, so one
  line is open at a time: a stream of words sorted by page and centre needs no more state than that.
* Boxes separated by an empty strip can never merge, whatever has merged before; so a page is cut at
  its empty strips and the pieces are handled independently.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions import geometry as G
from docketry.operators.graph import components
from docketry.operators.ordered import Rule, fold_sorted, ordered_scan
from docketry.sources.readers import stored

# --- lines of words ----------------------------------------------------------------------------


def word_boxes(words: DataFrame) -> DataFrame:
    """Words with vertices -> (doc_id, page, word_id, text, x_left, y_top, ..., cx, cy)."""
    # corners come from a generator, so that no later test on them is repeated in front of it; the rest is computed if used.
    # The page comes with them: one that is the same for all words stays a key, by which all groupings of them are dealt alike
    corner = F.struct("page", G.word_extent(F.col("vertices")).alias("g"))
    w = words.select("doc_id", "word_id", "text", "vertices", F.explode(F.when(F.size("vertices") > 0, F.array(corner))).alias("c"))
    return w.select("doc_id", "c.page", "word_id", "text", *G.word_geometry(F.col("c.g"), F.col("vertices")))


def line_tolerance(
    boxes: DataFrame, multiplier: float = C.LINE_TOLERANCE_MULTIPLIER, minimum: int = C.MIN_LINE_TOLERANCE
) -> DataFrame:
    """Tolerance per page from the median word height (heights are counted per distinct value)."""
    per_page = boxes.groupBy("doc_id", "page").agg(F.median("height").alias("median_height"))
    tol = F.greatest(F.lit(minimum), F.bround(F.col("median_height") * multiplier).cast("int"))
    return per_page.withColumn("tolerance", tol)


_PAGE = ["doc_id", "page"]


def _with_tolerance(boxes: DataFrame, multiplier: float, minimum: int) -> DataFrame:
    """Boxes by page and centre with their page's ``tolerance``; those without a page or a centre are in no line."""
    rows = boxes.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    # ordered like the scans behind it, so that they share its shuffle and its sort
    page = Window.partitionBy(*_PAGE).orderBy("y_center").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    median = F.percentile("height", F.lit(0.5)).over(page)
    tol = F.greatest(F.lit(minimum), F.bround(median * multiplier).cast("int"))
    return rows.withColumn("tolerance", tol).filter(F.col("y_center").isNotNull())


class _LineRule:
    """Levels top to bottom; a level joins the open line if the line's mean centre is near enough, else it opens the next.

    Centres only grow, so a line left behind by more than the tolerance stays behind: one line is open at a time, and a
    line is a stretch of levels.  Holds a page's distinct centres and heights with their counts, never its words.
    """

    def __init__(self, multiplier, minimum):
        self.multiplier, self.minimum = multiplier, minimum
        self.heights, self.levels = {}, {}

    @staticmethod
    def count(held, values):
        for value, n in zip(*(c.tolist() for c in np.unique(values, return_counts=True))):
            held[value] = held.get(value, 0) + n

    def take(self, centers, heights):
        """Some words of the page: their centres, and the heights of all that have one."""
        self.count(self.heights, heights)
        self.count(self.levels, centers)

    def tolerance(self):
        if not self.heights:
            return self.minimum
        values = sorted(self.heights)
        upto = np.cumsum([self.heights[v] for v in values])
        low, high = (values[int(np.searchsorted(upto, at, "right"))] for at in ((upto[-1] - 1) // 2, upto[-1] // 2))
        return max(self.minimum, round((low + high) / 2 * self.multiplier))

    def starts(self):
        """The first centre of each line."""
        out, total, count, tolerance = [], 0.0, 0, self.tolerance()
        for y, n in sorted(self.levels.items()):
            if not count or not abs(y - total / count) <= tolerance:
                out.append(y)
                total, count = 0.0, 0
            total += y * n
            count += n
        return out


def _line_starts(boxes: DataFrame, multiplier: float, minimum: int) -> DataFrame:
    """(doc_id, page, y_center, line_key): the first centre of each line."""
    names = [*_PAGE, "y_center", "line_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, pages = None, {}

        def lines() -> list[tuple]:
            return [(doc, page, y, key) for page, rule in pages.items() for key, y in enumerate(rule.starts())]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.int32()))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            known = [batch.column(i).is_valid().to_numpy(zero_copy_only=False) for i in (2, 3)]
            values = [batch.column(i).fill_null(0.0).to_numpy(zero_copy_only=False) for i in (2, 3)]
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            at, found = 0, []
            for end in [*cuts.tolist(), len(ids)]:
                if ids[at] != doc:
                    found += lines()
                    doc, pages = int(ids[at]), {}
                rule = pages.setdefault(int(numbers[at]), _LineRule(multiplier, minimum))
                rule.take(*(v[at:end][k[at:end]] for v, k in zip(values, known)))
                at = end
            yield rows(found)
        yield rows(lines())

    narrow = boxes.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull()).select(*_PAGE, "y_center", "height")
    # sorted by one whole number, which is done without comparing rows; centres are sorted by the rule, a page at a time
    return narrow.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(
        run, "doc_id bigint, page int, y_center double, line_key int")


def group_lines(
    boxes: DataFrame, multiplier: float = C.LINE_TOLERANCE_MULTIPLIER, minimum: int = C.MIN_LINE_TOLERANCE
) -> DataFrame:
    """Adds ``line_key``, the page's lines in order of creation: nearest running mean within tolerance.

    Lines are stretches of centres, so a word's line is the last one that starts at its centre or above.  Words and line
    starts meet in one shuffle by page, which aggregations by page or line behind it share.
    """
    rows = boxes.filter(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    starts = _line_starts(boxes, multiplier, minimum).withColumn("_word", F.lit(0))
    rows = rows.withColumn("_word", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    above = Window.partitionBy(*_PAGE).orderBy("y_center", "_word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("line_key", F.max("line_key").over(above))
    rest = [c for c in boxes.columns if c not in (*_PAGE, "y_center")]
    # after the window: put in front of it, the test would repeat the geometry of each word
    return rows.filter("_word = 1 AND y_center IS NOT NULL").select(*_PAGE, "y_center", *rest, "line_key")


def group_lines_gap(
    boxes: DataFrame, multiplier: float = C.LINE_TOLERANCE_MULTIPLIER, minimum: int = C.MIN_LINE_TOLERANCE
) -> DataFrame:
    """JVM-only variant: a new line starts where the next centre is more than the tolerance away.

    A chain of small steps stays one line here; ``group_lines`` may cut it.
    """
    by_page = Window.partitionBy(*_PAGE).orderBy("y_center")
    last = F.lag("y_center").over(by_page)
    rows = _with_tolerance(boxes, multiplier, minimum)
    opens = (F.col("y_center") != last) & (F.col("y_center") - last > F.col("tolerance"))
    rows = rows.withColumn("_new", F.coalesce(opens, F.lit(False)).cast("int"))
    upto = by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("line_key", F.sum("_new").over(upto).cast("int"))
    rest = [c for c in boxes.columns if c not in (*_PAGE, "y_center")]
    return rows.select(*_PAGE, "y_center", *rest, "line_key")


def line_agreement(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Per page: words, and words both groupings put in the same line.

    Words are matched by counts over both groupings.  These come by page, and so do the counts: no word moves again.
    """
    word = [*_PAGE, "word_id"]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = [df.select(*word, "line_key", n.alias("_a"), m.alias("_b")) for df, n, m in ((exact, one, none), (approximate, none, one))]
    rows = sides[0].unionByName(sides[1]).dropna(subset=word)
    lines = rows.groupBy(*word, "line_key").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    same = F.when(F.col("line_key").isNotNull(), F.col("_a") * F.col("_b")).otherwise(none)
    words = lines.groupBy(*word).agg((F.sum("_a") * F.sum("_b")).alias("n_words"), F.sum(same).alias("n_same")).filter("n_words > 0")
    return words.groupBy(*_PAGE).agg(F.sum("n_words").alias("n_words"), F.sum("n_same").alias("n_same"))


def sorted_lines(grouped: DataFrame, baseline: bool = False, keep_empty: bool = False, by: str = "center") -> DataFrame:
    """(doc_id, page, line_ord, center, text): lines top to bottom, words left to right.

    ``by`` orders lines by their mean centre or, as ``top``, by their rounded upper edge.  With
    ``baseline``, words are ordered by their projection on the line fitted through their centroids.
    """
    word = F.struct("x_left", "y_center", "word_id", "text", *(["cx", "cy"] if baseline else []))
    aggs = [F.avg("y_center").alias("center"), F.sort_array(F.collect_list(word)).alias("ws")]
    if by == "top":
        aggs.append(F.bround(F.min("y_top")).alias("top"))
    if baseline:
        aggs += [F.coalesce(F.regr_slope("cy", "cx"), F.lit(0.0)).alias("m"), F.stddev_pop("cx").alias("spread")]
    lines = grouped.groupBy("doc_id", "page", "line_key").agg(*aggs)
    texts = F.col("ws")["text"]
    if baseline:
        norm = F.sqrt(1 + F.col("m") * F.col("m"))

        def along(w: Column) -> Column:
            proj = (w["cx"] + F.col("m") * w["cy"]) / norm
            return F.struct(proj.alias("proj"), w["y_center"].alias("y_center"), w["word_id"].alias("word_id"), w["text"].alias("text"))

        flat = (F.size("ws") < 2) | (F.col("spread") <= 1e-8)
        sloped = F.sort_array(F.transform("ws", along))["text"]
        texts = F.when(flat, texts).otherwise(sloped)
    lines = lines.select("doc_id", "page", "line_key", "center", F.col(by).alias("_by"), F.trim(F.array_join(texts, " ")).alias("text"))
    # lines of a page are bounded by its height, so the page is a fair window
    in_order = Window.partitionBy("doc_id", "page").orderBy("_by", "line_key")
    lines = lines.withColumn("line_ord", F.row_number().over(in_order))
    lines = lines if keep_empty else lines.filter(F.col("text") != "")
    return lines.select("doc_id", "page", "line_ord", "center", "text")


# --- boxes -------------------------------------------------------------------------------------

BOX = ("x", "y", "w", "h")


def _box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def box_filter(boxes: DataFrame, page_w: int, page_h: int, min_area: int, max_area: int | None = None) -> DataFrame:
    area = F.col("w") * F.col("h")
    keep = (area >= min_area) & (F.col("w") >= C.MIN_BOX_SIDE) & (F.col("h") >= C.MIN_BOX_SIDE)
    keep = keep & ~((F.col("w") > C.MAX_PAGE_SHARE * page_w) & (F.col("h") > C.MAX_PAGE_SHARE * page_h))
    if max_area:
        keep = keep & (area <= max_area)
    return boxes.filter(keep)


def area_ratio_filter(boxes: DataFrame, page_w: int, page_h: int, share: float = C.MIN_AREA_RATIO) -> DataFrame:
    return boxes.filter(F.col("w") * F.col("h") / F.lit(float(page_w * page_h)) >= share)


def split_strips(boxes: DataFrame, keys: Sequence[str], low: str, size: str, out: str, gap: int = 0) -> DataFrame:
    """Adds ``out``, the number of the strip a box lies in: strips are separated by ``gap`` empty pixels.

    Works on the distinct start positions of a page, which its size in pixels bounds.
    """
    ends = boxes.groupBy(*keys, low).agg(F.max(F.col(low) + F.col(size)).alias("_end"))
    along = Window.partitionBy(*keys).orderBy(low)
    reach = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_new", F.coalesce(F.col(low) >= reach + gap, F.lit(False)).cast("int"))
    ends = ends.select(*keys, low, F.sum("_new").over(along).cast("int").alias(out))
    return boxes.join(ends, [*keys, low])


def _covered(x1: int, y1: int, x2: int, y2: int, cell: int):
    """Grid cells a rectangle touches."""
    for cx in range(x1 // cell, max(x1, x2 - 1) // cell + 1):
        for cy in range(y1 // cell, max(y1, y2 - 1) // cell + 1):
            yield cx, cy


def _overlap(a, b) -> float:
    """IoU of two (x1, y1, x2, y2)."""
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    inter = iw * ih
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)


class _MergeOverlaps(Rule):
    """Boxes in order; each unused one absorbs later unused boxes that overlap what it has grown into.

    Only boxes in grid cells the region touches are tried, in box order; growing brings in more cells.
    """

    def __init__(self, threshold):
        self.threshold = threshold

    def start(self):
        self.ids, self.boxes = [], []

    def row(self, box_no, x, y, w, h):
        self.ids.append(box_no)
        self.boxes.append((x, y, x + w, y + h))
        return ()

    def finish(self):
        boxes, grid = self.boxes, {}
        cell = max(16, sum(b[2] - b[0] + b[3] - b[1] for b in boxes) // (2 * len(boxes)))
        if len(boxes) > 1:
            for j, b in enumerate(boxes):
                for c in _covered(*b, cell):
                    grid.setdefault(c, []).append(j)
        used = bytearray(len(boxes))
        for i, region in enumerate(boxes):
            if used[i]:
                continue
            n, at, waiting, known, cells = 1, i, [], set(), set()
            fresh = True
            while fresh or waiting:
                if fresh:
                    for c in _covered(*region, cell):
                        if c not in cells:
                            cells.add(c)
                            for j in grid.get(c, ()):
                                if j > at and not used[j] and j not in known:
                                    known.add(j)
                                    heapq.heappush(waiting, j)
                    fresh = False
                    continue
                at = heapq.heappop(waiting)
                b = boxes[at]
                if _overlap(region, b) > self.threshold:
                    region = (min(region[0], b[0]), min(region[1], b[1]), max(region[2], b[2]), max(region[3], b[3]))
                    used[at], n, fresh = 1, n + 1, True
            yield (self.ids[i], region[0], region[1], region[2] - region[0], region[3] - region[1], n)


#: Pieces of a page with more boxes are cut again, as long as a cut separates anything.
PIECE = 256


def _over(df: DataFrame, keys: Sequence[str], most: int) -> bool:
    """Whether any key has more than ``most`` rows."""
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).isEmpty()


def _large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Keys of more than ``most`` rows, stored.

    Counted by the first key, and by all of them where that has more: a row a page is moved, not one a kind of every page.
    """
    def over(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return stored(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*by), "large-pages")

    found = over(df, keys[:1])
    return found if len(keys) == 1 or found.isEmpty() else over(df.join(found, keys[:1], "left_semi"), keys)


def _apart(threshold: float) -> Column:
    """A box number where equal rectangles do not overlap enough to be one: those without an area, or none can."""
    return F.when((F.col("w") <= 0) | (F.col("h") <= 0) | F.lit(threshold >= 1), F.col("box_no")).alias("_apart")


def split_pieces(boxes: DataFrame, keys: Sequence[str], out: str = "piece", large: int = PIECE) -> DataFrame:
    """Adds ``out``: boxes of different pieces are apart by an empty strip, found by cuts in both directions, again and again.

    The first two cuts are made everywhere; after that only pieces of more than ``large`` boxes are cut, and only while that
    helps, so the rounds grow with the depth of the layout and not with the number of boxes.
    """
    keys = list(keys)

    def cut(df: DataFrame) -> DataFrame:
        df = split_strips(df, [*keys, out], "y", "h", "_row")
        df = split_strips(df, [*keys, out, "_row"], "x", "w", "_col")
        return df.withColumn(out, F.xxhash64(out, "_row", "_col")).drop("_row", "_col")

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, out).agg(F.count("*").alias("_n"))

    pieces = cut(boxes.withColumn(out, F.lit(0).cast("bigint")))
    if not _over(boxes, keys, large):
        return pieces
    pieces = stored(pieces, "pieces")
    done = None
    while True:
        crowded = stored(counted(pieces).filter(F.col("_n") > large), "crowded-pieces")
        small = pieces.join(crowded.drop("_n"), [*keys, out], "left_anti")
        done = small if done is None else done.unionByName(small)
        if crowded.isEmpty():
            return done
        before = crowded.count()
        again = stored(cut(pieces.join(crowded.drop("_n"), [*keys, out], "left_semi")), "pieces")
        if again.select(*keys, out).distinct().count() == before:
            return done.unionByName(again)
        pieces = again


def merge_overlaps(boxes: DataFrame, threshold: float = C.MERGE_IOU) -> DataFrame:
    """(page_id, box_no, x, y, w, h, n_merged): seed-greedy union of overlapping boxes, in box order."""
    merged = fold_sorted(
        split_pieces(boxes.select("page_id", "box_no", *BOX), ["page_id"]), ["page_id", "piece"], ["box_no"], ["box_no", *BOX],
        lambda: _MergeOverlaps(threshold),
        "page_id bigint, piece bigint, box_no bigint, x int, y int, w int, h int, n_merged int",
    )
    return merged.drop("piece")


class _MergeComponents(Rule):
    """The boxes of one page, merged round by round as ``merge_components`` does."""

    def __init__(self, threshold):
        self.threshold = threshold

    def start(self):
        self.boxes = []

    def row(self, box_no, x, y, w, h):
        self.boxes.append((box_no, x, y, x + w, y + h, 1))
        return ()

    def finish(self):
        now = self.boxes
        while True:
            shapes = {}
            for no, *box, n in now:
                key = (*box, no if box[2] <= box[0] or box[3] <= box[1] or self.threshold >= 1 else None)
                least, total = shapes.get(key, (no, 0))
                shapes[key] = min(no, least), total + n
            now = [(no, *key[:4], n) for key, (no, n) in shapes.items()]
            root = {b[0]: b[0] for b in now}
            merging = len(root) < len(now)

            def top(no):
                while root[no] != no:
                    no = root[no]
                return no

            for i, a in enumerate(now):
                for b in now[:i]:
                    if a[0] != b[0] and _overlap(a[1:5], b[1:5]) > self.threshold:
                        merging = True
                        low, high = sorted((top(a[0]), top(b[0])))
                        root[high] = low
            if not merging:
                return [(no, x1, y1, x2 - x1, y2 - y1, n) for no, x1, y1, x2, y2, n in now]
            parts = {}
            for b in now:
                parts.setdefault(top(b[0]), []).append(b[1:])
            now = []
            for no, members in parts.items():
                x1, y1, x2, y2, n = zip(*members)
                now.append((no, min(x1), min(y1), max(x2), max(y2), sum(n)))


#: A page of at most so many boxes is merged by one task in memory.
SMALL_PAGE = 64


def merge_components(boxes: DataFrame, threshold: float = C.MERGE_IOU, small: int = SMALL_PAGE) -> DataFrame:
    """(page_id, box_no, x, y, w, h, n_merged): bounding boxes of all boxes that overlaps connect, until no two overlap.

    A round merges every connected component of the overlap graph into its bounding box, known by its least box number;
    bounding boxes may overlap again, so rounds follow until there is no pair left.  The order of boxes plays no part.

    Pages do not touch each other.  One of up to ``small`` boxes goes through its rounds in a task, with one shuffle of its
    boxes; those with more, or with anything null, go through them together, by joins.
    """
    boxes = boxes.select("page_id", "box_no", *BOX)
    types = dict(boxes.dtypes)
    if threshold < 0 or any(types[c] != "int" for c in BOX):
        return _merge_components_by_joins(boxes, threshold)
    unknown = F.col("page_id").isNull()
    for c in ("box_no", *BOX):
        unknown = unknown | F.col(c).isNull()
    pages = boxes.groupBy("page_id").agg(F.count("*").alias("_n"), F.count_if(unknown).alias("_unknown"))
    large = stored(pages.filter((F.col("_n") > small) | (F.col("_unknown") > 0)).select("page_id"), "large-pages")
    none = large.isEmpty()
    simple = boxes if none else boxes.filter(F.col("page_id").isNotNull()).join(large, "page_id", "left_anti")
    merged = fold_sorted(
        simple, ["page_id"], ["box_no"], ["box_no", *BOX], lambda: _MergeComponents(threshold),
        f"page_id {types['page_id']}, box_no {types['box_no']}, x int, y int, w int, h int, n_merged bigint")
    if none:
        return merged
    same = boxes["page_id"].eqNullSafe(large["page_id"])
    return merged.unionByName(_merge_components_by_joins(boxes.join(large, same, "left_semi"), threshold, True))


def _merge_components_by_joins(boxes: DataFrame, threshold: float, unite: bool = False) -> DataFrame:
    """``merge_components`` of pages of any size.  Each round makes one box of those with one number, ``unite`` without any overlap too."""
    now = stored(boxes.select("page_id", "box_no", *BOX, F.lit(1).cast("bigint").alias("n_merged")), "merged-boxes")
    while True:
        # equal rectangles are one before anything is compared
        shapes = stored(
            now.groupBy("page_id", *BOX, _apart(threshold)).agg(F.min("box_no").alias("box_no"), F.sum("n_merged").alias("n_merged")).drop("_apart"),
            "distinct-boxes")
        pairs = stored(
            _touching(shapes, shapes, ["box_no"], threshold, _CELL).filter(F.col("a_box_no") < F.col("b_box_no"))
            .select("page_id", "a_box_no", "b_box_no"), "overlaps")
        if pairs.isEmpty():
            if not unite:
                return shapes.select("page_id", "box_no", *BOX, "n_merged")
            root = pairs.select("page_id", F.col("a_box_no").alias("node"), F.col("a_box_no").alias("root"))
        else:
            root = components(pairs, ["page_id"], "a_box_no", "b_box_no")
        unite = False
        grown = shapes.join(root.withColumnRenamed("node", "box_no"), ["page_id", "box_no"], "left")
        x2, y2 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
        grown = grown.groupBy("page_id", F.coalesce("root", "box_no").alias("box_no")).agg(
            F.min("x").alias("x"), F.min("y").alias("y"), (x2 - F.min("x")).alias("w"), (y2 - F.min("y")).alias("h"),
            F.sum("n_merged").alias("n_merged"))
        now = stored(grown, "merged-boxes")


class _MergeAdjacent(Rule):
    """Boxes by (y, x); one that begins before the last region's end plus the gap, in both directions, widens that region."""

    def __init__(self, gap):
        self.gap = gap

    def start(self):
        self.corners, self.count, self.number = None, 0, 0

    def row(self, x, y, w, h):
        box = (x, y, x + w, y + h)
        if self.corners and all(low < high + self.gap for low, high in zip(box[:2], self.corners[2:])):
            self.corners = (*map(min, box[:2], self.corners[:2]), *map(max, box[2:], self.corners[2:]))
            self.count += 1
            return ()
        closed = self.finish()
        self.corners, self.count = box, 1
        return closed

    def finish(self):
        if not self.corners:
            return []
        self.number += 1
        left, top, right, bottom = self.corners
        return [(self.number, left, top, right - left, bottom - top, self.count)]


def merge_adjacent(boxes: DataFrame, gap: int = C.ADJACENT_GAP) -> DataFrame:
    """(page_id, strip, region_no, x, y, w, h, n_merged): regions in top-to-bottom order of strips."""
    pieces = split_strips(boxes, ["page_id"], "y", "h", "strip", gap)
    return fold_sorted(
        pieces, ["page_id", "strip"], ["y", "x", "box_no"], list(BOX), lambda: _MergeAdjacent(gap),
        "page_id bigint, strip int, region_no int, x int, y int, w int, h int, n_merged int",
    )


class _Suppress(Rule):
    """Boxes by falling score; one that overlaps a kept box too much goes.  Holds the kept boxes only.

    Two boxes with an IoU above one half contain each other's centre, so then one grid cell is enough.
    """

    CELL = 64

    def __init__(self, threshold):
        self.threshold = threshold

    def start(self):
        self.grid, self.apart = {}, set()

    def row(self, box_no, x, y, w, h):
        box = (x, y, x + w, y + h)
        if w <= 0 or h <= 0 or self.threshold >= 1:
            # nothing suppresses it, so only its own copies do not stay
            if (box_no, box) in self.apart:
                return ()
            self.apart.add((box_no, box))
        if self.threshold >= 0.5:
            cells = [((2 * x + w) // 2 // self.CELL, (2 * y + h) // 2 // self.CELL)]
        else:
            cells = _covered(*box, self.CELL)
        for c in cells:
            if any(_overlap(k, box) > self.threshold for k in self.grid.get(c, ())):
                return ()
        for c in _covered(*box, self.CELL):
            self.grid.setdefault(c, []).append(box)
        return [(box_no,)]


#: A strip with more boxes is thinned in parallel rounds before the rest is gone through in order.
STRIP = 2000
#: Rounds go on while they decide at least one box in so many.
WORTH = 16


def _fold_nms(groups: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    ddl = ", ".join(f"{k} {dict(groups.dtypes)[k]}" for k in (*keys, "box_no"))
    return fold_sorted(groups, keys, ["rank", "box_no"], ["box_no", *BOX], lambda: _Suppress(threshold), ddl)


def _nms_round(boxes: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """``boxes`` with ``verdict``: true for those better than all that they may overlap, false for those these suppress.

    A box is at home in the cell of its centre, which every box covers that shares more than half with it (below that, in
    all cells it touches).  If it is the best of all boxes at home in the cells that it covers, nothing can suppress it.
    """
    cell = _Suppress.CELL
    place = [*keys, "_cx", "_cy"]
    order = F.struct("rank", "box_no")
    if threshold >= 0.5:
        middle = lambda at, size: F.floor(F.floor((2 * F.col(at) + F.col(size)) / 2) / cell)
        home = boxes.withColumn("_cx", middle("x", "w")).withColumn("_cy", middle("y", "h"))
    else:
        home = _cells(boxes, cell)
    covered = _cells(boxes, cell)
    best = home.groupBy(*place).agg(F.min(order).alias("_best"))
    top = covered.join(best, place).groupBy(*keys, "box_no").agg(F.min("_best").alias("_best")).filter("_best.box_no = box_no")
    kept = stored(boxes.join(top.select(*keys, "box_no"), [*keys, "box_no"], "left_semi"), "kept-boxes")
    near = _cells(kept.select(*keys, *[F.col(c).alias(f"k_{c}") for c in ("box_no", *BOX)], *BOX), cell).drop(*BOX)
    hit = home.join(near, place).filter((F.col("box_no") != F.col("k_box_no")) & (G.iou(_box(), _box("k_")) > threshold))
    gone = hit.select(*keys, "box_no").distinct().withColumn("_gone", F.lit(True))
    known = kept.select(*keys, "box_no", F.lit(True).alias("_kept"))
    return boxes.join(known, [*keys, "box_no"], "left").join(gone, [*keys, "box_no"], "left").withColumn(
        "verdict", F.when(F.col("_kept"), True).when(F.col("_gone"), False)).drop("_kept", "_gone")


def nms(boxes: DataFrame, keys: Sequence[str] = ("page_id", "kind"), threshold: float = C.NMS_IOU, strip: int = STRIP) -> DataFrame:
    """Greedy non-maximum suppression per key: keys and box_no of the boxes that stay.

    Input: keys, box_no (unique within the keys), x, y, w, h, score.  Of equal rectangles only the best can stay.  The boxes
    of a key that has at most ``PIECE`` move once and are gone through in order of score.  Those of the others are cut into
    pieces, which cannot suppress each other, so pieces are gone through in order of score, all at once.  A
    piece of more than ``strip`` boxes is first thinned in rounds: every box that is the best around is kept and suppresses
    its neighbours, everywhere at the same time, by joins over grid cells; only undecided boxes go on, and what is left falls
    into smaller pieces.  Where scores fall steadily along a chain of boxes a round decides little; then the rest is gone
    through in order, by one task a piece, which holds the boxes it keeps.
    """
    keys = list(keys)
    boxes = boxes.dropna(subset=[*keys, "x", "y"]).select(*keys, (-F.col("score")).alias("rank"), "box_no", *BOX)
    large = boxes.select(*keys) if threshold < 0 else _large_keys(boxes, keys, min(PIECE, strip))
    if large.isEmpty():
        return _fold_nms(boxes, keys, threshold)
    small = _fold_nms(boxes.join(large, keys, "left_anti"), keys, threshold)
    return small.unionByName(_nms_of_large(boxes.join(large, keys, "left_semi"), keys, threshold, strip))


def _nms_of_large(boxes: DataFrame, keys: Sequence[str], threshold: float, strip: int) -> DataFrame:
    best = F.min(F.struct("rank", "box_no")).alias("b")
    shapes = boxes.groupBy(*keys, *BOX, _apart(threshold)).agg(best).select(*keys, "b.rank", "b.box_no", *BOX)
    pieces = split_pieces(shapes, keys)
    fold = lambda df: _fold_nms(df, [*keys, "piece"], threshold).drop("piece")
    if not _over(boxes, keys, strip):
        return fold(pieces)
    sizes = pieces.groupBy(*keys, "piece").agg(F.count("*").alias("_n")).filter(F.col("_n") > strip)
    large = stored(sizes.select(*keys, "piece"), "large-pieces")
    kept = fold(pieces.join(large, [*keys, "piece"], "left_anti"))
    left = stored(pieces.join(large, [*keys, "piece"], "left_semi").drop("piece"), "undecided")
    waiting = left.count()
    while waiting:
        judged = stored(_nms_round(left, keys, threshold), "judged-boxes")
        kept = kept.unionByName(judged.filter("verdict").select(*keys, "box_no"))
        left = stored(judged.filter("verdict IS NULL").drop("verdict"), "undecided")
        before, waiting = waiting, left.count()
        if waiting <= strip or before - waiting < before // WORTH:
            kept = kept.unionByName(fold(split_pieces(left, keys)))
            break
    return kept


# --- overlaps ----------------------------------------------------------------------------------

_CELL = 128


def _cells(boxes: DataFrame, cell: int) -> DataFrame:
    """One row per grid cell a box touches."""
    across = F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.greatest("w", F.lit(1)) - 1) / cell))
    down = F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.greatest("h", F.lit(1)) - 1) / cell))
    return boxes.select("*", F.explode(across).alias("_cx")).select("*", F.explode(down).alias("_cy"))


#: A cell in which more boxes meet is split into sixteen, down to a side of FINE.
CROWD = 512
FINE = 8


def _touching(a: DataFrame, b: DataFrame, carry: Sequence[str], threshold: float, cell: int, crowd: int = CROWD) -> DataFrame:
    """Pairs of one page above an IoU, each exactly once: in the cell of the intersection's corner.

    Cells are as fine as the boxes in them are many: where more than ``crowd`` meet, by count, the cell is split.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("page_id", *[F.col(c).alias(p + c) for c in (*carry, *BOX)])

    def within(df: DataFrame, p: str, size: int, parent: int | None) -> DataFrame:
        """A row for each cell that a box touches; inside a cell that was split, for each of its parts."""
        def span(at: str, length: str, big: str) -> Column:
            low = F.floor(F.col(p + at) / size)
            high = F.floor((F.col(p + at) + F.greatest(F.col(p + length), F.lit(1)) - 1) / size)
            if parent:
                low, high = F.greatest(low, F.col(big) * (parent // size)), F.least(high, (F.col(big) + 1) * (parent // size) - 1)
            return F.explode(F.sequence(low, high))

        df = df.select("*", span("x", "w", "_cx").alias("_nx")).select("*", span("y", "h", "_cy").alias("_ny"))
        return df.drop("_cx", "_cy").withColumnsRenamed({"_nx": "_cx", "_ny": "_cy"})

    place = ["page_id", "_cx", "_cy"]
    dense = _over(a, ["page_id"], crowd) or (b is not a and _over(b, ["page_id"], crowd))
    left, right = within(side(a, "a_"), "a_", cell, None), within(side(b, "b_"), "b_", cell, None)
    found = None
    while True:
        more = dense and cell // 4 >= FINE
        if more:
            n = lambda df: df.groupBy(*place).agg(F.count("*").alias("_n"))
            crowded = n(left).join(n(right).withColumnRenamed("_n", "_m"), place).filter(F.greatest("_n", "_m") > crowd)
            crowded = stored(crowded.select(*place), "crowded-cells")
            more = not crowded.isEmpty()
        here = (left.join(crowded, place, "left_anti"), right.join(crowded, place, "left_anti")) if more else (left, right)
        corner = (F.col("_cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (F.col("_cy") == F.floor(F.greatest("a_y", "b_y") / cell))
        pairs = here[0].join(here[1], place).filter(corner).withColumn("iou", G.iou(_box("a_"), _box("b_")))
        pairs = pairs.filter(F.col("iou") > threshold).drop("_cx", "_cy")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found
        left = within(left.join(crowded, place, "left_semi"), "a_", cell // 4, cell)
        right = within(right.join(crowded, place, "left_semi"), "b_", cell // 4, cell)
        cell //= 4


def overlap_classes(boxes: DataFrame, threshold: float = C.MERGE_IOU, cell: int = _CELL, crowd: int = CROWD) -> DataFrame:
    """(page_id, a_box_no, b_box_no, a_count, b_count, iou): overlapping distinct rectangles, each known by its least box number.

    A rectangle that several boxes share also forms a row with itself, so n equal boxes are one row with their count, and
    the pairs of boxes between two rectangles are a_count * b_count (of one with itself, a_count * (a_count - 1) / 2).
    """
    shapes = boxes.groupBy("page_id", *BOX).agg(F.min("box_no").alias("box_no"), F.count("*").alias("count"))
    near = _touching(shapes, shapes, ["box_no", "count"], threshold, cell, crowd)
    near = near.filter((F.col("a_box_no") < F.col("b_box_no")) | ((F.col("a_box_no") == F.col("b_box_no")) & (F.col("a_count") > 1)))
    return near.select("page_id", "a_box_no", "b_box_no", "a_count", "b_count", "iou")


def overlap_pairs(boxes: DataFrame, threshold: float = C.MERGE_IOU, cell: int = _CELL, small: int = SMALL_PAGE) -> DataFrame:
    """(page_id, a_box_no, b_box_no, iou) of all pairs of overlapping boxes.

    Boxes of a page that has up to ``small`` move once and are compared with each other; pairs of a larger page are spelled
    out from ``overlap_classes``.
    """
    boxes = boxes.select("page_id", "box_no", *BOX)
    if threshold < 0:
        return _pairs_of_classes(boxes, threshold, cell)
    large = _large_keys(boxes, ["page_id"], small)
    if large.isEmpty():
        return _pairs_of_pages(boxes, threshold)
    few, many = (boxes.join(large, "page_id", how) for how in ("left_anti", "left_semi"))
    return _pairs_of_pages(few, threshold).unionByName(_pairs_of_classes(many, threshold, cell))


def _pairs_of_pages(boxes: DataFrame, threshold: float) -> DataFrame:
    """Each box beside those of its page that have a larger number; both sides read one shuffle."""
    rows = boxes.dropna().repartition("page_id")
    a, b = (rows.select("page_id", *[F.col(c).alias(p + c) for c in ("box_no", *BOX)]) for p in ("a_", "b_"))
    pairs = a.join(b, "page_id").filter(F.col("a_box_no") < F.col("b_box_no"))
    pairs = pairs.withColumn("iou", G.iou(_box("a_"), _box("b_"))).filter(F.col("iou") > threshold)
    return pairs.select("page_id", "a_box_no", "b_box_no", "iou")


def _pairs_of_classes(boxes: DataFrame, threshold: float, cell: int) -> DataFrame:
    classes = overlap_classes(boxes, threshold, cell)
    member = boxes.select("page_id", *BOX, "box_no")
    first = member.groupBy("page_id", *BOX).agg(F.min("box_no").alias("_first"))
    named = stored(member.join(first, ["page_id", *BOX]).select("page_id", "_first", "box_no"), "box-classes")
    of = lambda p: named.select("page_id", F.col("_first").alias(f"{p}_box_no"), F.col("box_no").alias(f"_{p}"))
    pairs = classes.join(of("a"), ["page_id", "a_box_no"]).join(of("b"), ["page_id", "b_box_no"])
    pairs = pairs.filter((F.col("a_box_no") != F.col("b_box_no")) | (F.col("_a") < F.col("_b")))
    return pairs.select("page_id", F.least("_a", "_b").alias("a_box_no"), F.greatest("_a", "_b").alias("b_box_no"), "iou")


def suppress_overlaps(texts: DataFrame, tables: DataFrame, threshold: float = C.SUPPRESS_IOU, cell: int = _CELL) -> DataFrame:
    """Text boxes that do not overlap any table box of their page.

    Copies of a box share their fate, so each distinct rectangle is compared once.
    """
    shapes = lambda df: df.select("page_id", *BOX).distinct()
    hit = _touching(shapes(texts), shapes(tables), [], threshold, cell)
    hit = hit.select("page_id", *[F.col(f"a_{c}").alias(c) for c in BOX]).distinct()
    return texts.join(hit, ["page_id", *BOX], "left_anti")


def photo_rule(boxes: DataFrame, max_words: int = 5) -> DataFrame:
    """Boxes with few words and lively pixels."""
    return boxes.filter((F.col("n_words") < max_words) & ((F.col("variance") > 200) | (F.col("colourfulness") > 10)))


def number_segments(segments: DataFrame) -> DataFrame:
    """Adds ``id`` within a page: tables, then text, then photos, each top to bottom.  Input: page_id, type, box."""
    kind = F.lit(len(C.SEGMENT_ORDER))
    for name, n in C.SEGMENT_ORDER.items():
        kind = F.when(F.col("type") == name, F.lit(n)).otherwise(kind)
    df = segments.withColumn("kind_ord", kind)
    # the chunk follows the order: kind first, then bands of rows
    chunk = F.col("kind_ord").cast("bigint") * 1000000 + F.floor(F.col("y") / 64)
    df = ordered_scan(df, ["page_id"], ["kind_ord", "y", "x", "box_no"], chunk)
    return df.withColumnRenamed("row_no", "id").drop("kind_ord")


def page_children(pages: DataFrame, regions: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """(page_id, child_no, x1, y1, x2, y2): padded regions of a page, or the whole page if it has none.

    ``regions`` as from ``merge_adjacent``.
    """
    chunk = F.col("strip")
    r = ordered_scan(regions, ["page_id"], ["strip", "region_no"], chunk.cast("bigint"))
    r = r.select("page_id", F.col("row_no").alias("child_no"), G.pad_clamp(*_box(), F.lit(page_w), F.lit(page_h)).alias("p"))
    df = pages.select("page_id").join(r, "page_id", "left")
    whole = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(page_w).alias("x2"), F.lit(page_h).alias("y2"))
    return df.select(
        "page_id", F.coalesce("child_no", F.lit(1).cast("bigint")).alias("child_no"), F.coalesce("p", whole).alias("p")
    ).select("page_id", "child_no", "p.*")
