"""Shaping of OCR output and comparison of OCR engines.

Nested responses are taken apart inside the row with array functions and exploded once, so the order
of elements is their array position and no window is needed to number them.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from docketry.functions import geometry as G
from docketry.functions import text as T
from docketry.operators.ordered import ordered_scan
from docketry.schemas import ANNOTATION, PIXEL, WRAPPERS

# --- responses ---------------------------------------------------------------------------------


_WRAPPER_KEYS = ("data", "response", "result", "payload", "results", "Data")


def _wrapped(doc):
    """The annotation of the first wrapper that holds one, itself or in one of its items."""
    for key in _WRAPPER_KEYS if isinstance(doc, dict) else ():
        held = doc.get(key)
        for item in held if isinstance(held, list) else [held]:
            if isinstance(item, dict) and "fullTextAnnotation" in item:
                return item["fullTextAnnotation"]
    return None


def _first_readable(doc):
    """First node, in document order, that has a page list or a text; depth is bounded by memory only."""
    ahead = [doc]
    while ahead:
        node = ahead.pop()
        if isinstance(node, dict):
            if "text" in node or isinstance(node.get("pages"), list):
                return node
            node = list(node.values())
        if isinstance(node, list):
            ahead.extend(reversed(node))
    return None


@arrow_udf(StringType())
def _search_json(payload: pa.Array, wanted: pa.Array) -> pa.Array:
    def one(s):
        try:
            doc = json.loads(s) if s is not None else None
            found = _wrapped(doc) or _first_readable(doc)
            return json.dumps(found, ensure_ascii=False) if found else None
        except (ValueError, RecursionError):  # cut off, malformed, or nested beyond what the parser takes
            return None

    return pa.array([one(s.as_py()) if w.as_py() else None for s, w in zip(payload, wanted)], pa.string())


def read_annotations(responses: DataFrame, payload: str = "payload", schema: str = ANNOTATION) -> DataFrame:
    """Adds ``wrapper`` (where the annotation was found) and ``fta`` (the annotation), null if there is none.

    The usual places are reached by one typed parse.  Only responses that match none of them are
    searched node by node.  ``schema`` may leave out what is not read later: ``ANNOTATION_TEXTS`` has no boxes
    and confidences.
    """
    # one map-stage value per row: the parse is not repeated for each place looked at
    df = responses.select("*", F.explode(F.array(F.from_json(payload, WRAPPERS))).alias("_w"))
    w = F.col("_w")
    first_result = F.get(w["results"], F.lit(0))
    bare = w["pages"].startswith("[") | w["text"].isNotNull()
    places = [
        ("results.Data.responses", F.get(first_result["Data"]["responses"], F.lit(0))["fullTextAnnotation"]),
        ("fullTextAnnotation", w["fullTextAnnotation"]),
        ("data", w["data"]["fullTextAnnotation"]),
        ("response", w["response"]["fullTextAnnotation"]),
        ("result", w["result"]["fullTextAnnotation"]),
        ("payload", w["payload"]["fullTextAnnotation"]),
        ("results", first_result["fullTextAnnotation"]),
        ("bare", F.when(bare, F.col(payload))),
    ]
    usual = F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("wrapper"), c.alias("doc"))) for n, c in places])
    df = df.withColumn("_usual", usual).drop("_w")
    # rows wait for their batch, which is cut by the bytes sent: nulls in place of the other payloads would let thousands wait
    df = df.withColumn("_deep", _search_json(F.col(payload), F.col("_usual").isNull()))
    text = F.coalesce("_usual.doc", "_deep")
    wrapper = F.coalesce("_usual.wrapper", F.when(F.col("_deep").isNotNull(), F.lit("search")))
    fta = F.explode_outer(F.array(F.from_json(text, schema)))
    return df.select(*responses.columns, wrapper.alias("wrapper"), fta.alias("fta"))


def rejected(annotations: DataFrame) -> DataFrame:
    """Responses in which no annotation was found."""
    return annotations.filter("fta IS NULL").drop("fta")


# --- paragraphs and words ----------------------------------------------------------------------

def _list(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _own_text(node: Column) -> Column:
    return F.coalesce(F.nullif(node["text"], F.lit("")), F.nullif(node["description"], F.lit("")))


def _symbols_text(word: Column) -> Column:
    texts = F.filter(F.transform(word["symbols"], lambda s: s["text"]), lambda t: t.isNotNull())
    return F.nullif(F.array_join(texts, ""), F.lit(""))


def paragraph_text(para: Column) -> Column:
    """Own text or description, else the words' texts, a word without text being its symbols."""
    pieces = F.transform(para["words"], lambda w: F.coalesce(_own_text(w), _symbols_text(w)))
    joined = T.strip(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), " "))
    return F.coalesce(_own_text(para), joined, F.lit(""))


def paragraph_confidence(para: Column) -> Column:
    """Own confidence, else the mean over its words, symbols standing in for words without one."""
    values = F.flatten(
        F.transform(
            para["words"],
            lambda w: F.when(w["confidence"].isNotNull(), F.array(w["confidence"])).otherwise(
                F.coalesce(F.transform(w["symbols"], lambda s: s["confidence"]), F.array().cast("array<double>"))
            ),
        )
    )
    values = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    mean = F.when(F.size(values) > 0, total / F.size(values))
    return F.coalesce(para["confidence"], mean)


def node_vertices(node: Column, compat: str | None = None) -> Column:
    box = F.coalesce(node["boundingBox"], node["bounding_box"])
    some = lambda v: F.when(F.size(v) > 0, v)
    return G.polygon_from_points(F.coalesce(some(box["vertices"]), some(box["normalizedVertices"])), compat)


def _paragraph_array() -> Column:
    """Paragraphs of ``fta`` in order, each with its page, block and paragraph number (from 1)."""
    def place(page: Column, block: Column, no: Column, para: Column) -> Column:
        return F.struct((page + 1).alias("page_no"), (block + 1).alias("block_no"), (no + 1).alias("para_no"), para.alias("para"))

    def in_block(block: Column, pi: Column, bi: Column) -> Column:
        return F.transform(_list(block["paragraphs"]), lambda q, qi: place(pi, bi, qi, q))

    def in_page(page: Column, pi: Column) -> Column:
        return F.transform(_list(page["blocks"]), lambda b, bi: in_block(b, pi, bi))

    zero = F.lit(0)
    direct = F.transform(_list(F.col("fta.paragraphs")), lambda q, qi: place(zero, zero, qi, q))
    return F.when(F.size("fta.pages") > 0, F.flatten(F.flatten(F.transform("fta.pages", in_page)))).otherwise(direct)


def explode_paragraphs(annotations: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, para_no, seq, para): numbered from 1, ``seq`` running over the document."""
    rows = annotations.select("doc_id", F.posexplode(_paragraph_array()).alias("pos", "e"))
    return rows.select("doc_id", "e.page_no", "e.block_no", "e.para_no", (F.col("pos") + 1).alias("seq"), "e.para")


_TOKEN = f"struct<page:int,text:string,vertices:array<{PIXEL}>,confidence:double>"


def _token(page: Column, text: Column, node: Column, compat: str | None) -> Column:
    return F.struct(
        page.cast("int").alias("page"), T.strip(text).alias("text"), node_vertices(node, compat).alias("vertices"),
        node["confidence"].alias("confidence"),
    )


def explode_words(annotations: DataFrame, compat: str | None = None) -> DataFrame:
    """(doc_id, page, word_no, text, vertices, confidence): words, or the nearest enclosing text without words.

    Within a block: paragraphs' words, a paragraph without words being one token; without paragraphs
    the block's lines or words the same way.  Top-level paragraphs count only if nothing else did.
    """
    def of_group(page: Column, group: Column, symbols: bool) -> Column:
        word_text = lambda w: F.coalesce(_own_text(w), _symbols_text(w)) if symbols else _own_text(w)
        by_word = F.transform(group["words"], lambda w: _token(page, word_text(w), w, compat))
        alone = F.array(_token(page, _own_text(group), group, compat))
        return F.when(F.size(group["words"]) > 0, by_word).otherwise(alone)

    def of_block(page: Column, block: Column) -> Column:
        lines = F.when(F.size(block["lines"]) > 0, block["lines"]).otherwise(_list(block["words"]))
        groups = F.when(F.size(block["paragraphs"]) > 0, block["paragraphs"]).otherwise(lines)
        return F.flatten(F.transform(groups, lambda g: of_group(page, g, True)))

    def usable(tokens: Column) -> Column:
        ok = lambda t: t["text"].isNotNull() & (t["text"] != "") & (F.size(t["vertices"]) > 0)
        return F.filter(F.coalesce(tokens, F.array().cast(f"array<{_TOKEN}>")), ok)

    paged = usable(
        F.flatten(
            F.transform(
                F.col("fta.pages"),
                lambda p, pi: F.flatten(F.transform(p["blocks"], lambda b: of_block(pi, b))),
            )
        )
    )
    top = usable(F.flatten(F.transform(F.col("fta.paragraphs"), lambda g: of_group(F.lit(0), g, False))))
    df = annotations.select("doc_id", "fta", F.explode_outer(F.array(paged)).alias("_paged"))
    words = F.when(F.size("_paged") > 0, F.col("_paged")).otherwise(top)
    rows = df.select("doc_id", F.posexplode(words).alias("word_no", "w"))
    return rows.select("doc_id", "w.page", "word_no", "w.text", "w.vertices", "w.confidence")


def simplified_paragraphs(annotations: DataFrame, compat: str | None = None) -> DataFrame:
    """(doc_id, seq, text, bounding_box) per paragraph; per line, word or block where there are none."""
    def entry(text: Column, node: Column) -> Column:
        return F.struct(text.alias("text"), node_vertices(node, compat).alias("bounding_box"))

    def of_block(block: Column) -> Column:
        lines = F.when(F.size(block["lines"]) > 0, block["lines"]).otherwise(_list(block["words"]))
        groups = F.when(F.size(block["paragraphs"]) > 0, block["paragraphs"]).otherwise(lines)
        alone = F.filter(F.array(entry(_own_text(block), block)), lambda e: e["text"].isNotNull())
        return F.when(F.size(groups) > 0, F.transform(groups, lambda g: entry(paragraph_text(g), g))).otherwise(alone)

    paged = F.flatten(F.flatten(F.transform(F.col("fta.pages"), lambda p: F.transform(p["blocks"], of_block))))
    top = F.transform(F.col("fta.paragraphs"), lambda g: entry(paragraph_text(g), g))
    every = F.when(F.size("fta.pages") > 0, paged).otherwise(top)
    rows = annotations.select("doc_id", F.posexplode(every).alias("seq", "e"))
    return rows.select("doc_id", "seq", "e.text", "e.bounding_box")


def combined_text(annotations: DataFrame) -> DataFrame:
    """(doc_id, full_text, transcript): the annotation's own text, and all paragraphs under numbered heads.

    ``full_text`` falls back to the paragraphs when the annotation has no text of its own.
    """
    texts = F.transform(
        _paragraph_array(),
        lambda e: F.struct(e["page_no"].alias("page_no"), e["block_no"].alias("block_no"), paragraph_text(e["para"]).alias("text")),
    )
    df = annotations.select("doc_id", F.nullif("fta.text", F.lit("")).alias("own"), F.explode_outer(F.array(texts)).alias("p"))

    def headed(e: Column, i: Column) -> Column:
        head = F.format_string("--- paragraph_%03d (page %d block %d) ---\n", i + 1, e["page_no"], e["block_no"])
        return F.concat(head, e["text"], F.lit("\n\n"))

    plain = F.array_join(F.transform("p", lambda e: F.concat(e["text"], F.lit("\n\n"))), "")
    return df.select(
        "doc_id", F.coalesce("own", plain, F.lit("")).alias("full_text"),
        F.coalesce(F.array_join(F.transform("p", headed), ""), F.lit("")).alias("transcript"),
    )


def zip_word_arrays(results: DataFrame) -> DataFrame:
    """Parallel arrays rec_texts, rec_polys, rec_scores -> (doc_id, word_no, text, vertices, confidence).

    A word without a polygon of at least four points is skipped; a missing score is null.
    """
    zipped = F.arrays_zip("rec_texts", "rec_polys", "rec_scores")
    rows = results.select("doc_id", F.posexplode(zipped).alias("word_no", "z"))
    rows = rows.filter((F.size("z.rec_polys") >= 4) & (F.length("z.rec_texts") > 0))
    rows = rows.select(
        "doc_id", "word_no", T.strip(F.col("z.rec_texts")).alias("text"),
        G.polygon_from_pairs(F.col("z.rec_polys")).alias("vertices"), F.col("z.rec_scores").alias("confidence"),
    )
    return rows.filter(F.size("vertices") > 0)


def group_tsv_lines(words: DataFrame, order: str, separator: str = " ") -> DataFrame:
    """Rectangle words -> lines by (block, paragraph, line): text, bounding box, mean confidence.

    ``order`` numbers the words of a document; a line's ``first_seen`` is its smallest number, which is
    the order in which lines first appear.  Confidences below zero mean none.
    """
    w = words.filter(F.length(T.strip(F.col("text"))) > 0)
    x2, y2 = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return w.groupBy("doc_id", "block_num", "par_num", "line_num").agg(
        F.min(order).alias("first_seen"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("left", order, T.strip(F.col("text")).alias("t")))), lambda e: e["t"]
            ),
            separator,
        ).alias("text"),
        F.min("left").alias("x1"), F.min("top").alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"),
        F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("confidence"),
    )


# --- engines -----------------------------------------------------------------------------------

def engine_fallback(runs: DataFrame, min_chars: int = 4) -> DataFrame:
    """(doc_id, engine, full_text): the first engine in priority order with usable text, null if none."""
    ok = T.min_text(F.col("full_text"), min_chars)
    pick = F.min_by(F.when(ok, F.struct("engine", "full_text")), F.when(ok, F.col("priority")))
    return runs.groupBy("doc_id").agg(pick.alias("p")).select("doc_id", "p.engine", "p.full_text")


def engine_compare(runs: DataFrame, engines: list[str]) -> DataFrame:
    """One wide row per document: text, duration and error of each engine."""
    return runs.groupBy("doc_id").pivot("engine", engines).agg(
        F.first("full_text").alias("text"), F.first("duration_sec").alias("duration_sec"), F.first("error").alias("error")
    )


def engine_report(runs: DataFrame) -> DataFrame:
    """(doc_id, report): each engine's duration and text in priority order; one row per engine is given."""
    body = F.coalesce(F.nullif(T.strip(F.col("full_text")), F.lit("")), F.lit("<no text>"))
    part = F.concat_ws(
        "\n", F.concat(F.lit("=== "), F.upper("engine"), F.lit(" ===")),
        F.format_string("duration_sec: %.3f", "duration_sec"), F.lit("full_text:"), body, F.lit(""),
    )
    rows = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("priority", part.alias("part")))).alias("p"))
    return rows.select("doc_id", F.array_join(F.transform("p", lambda e: e["part"]), "\n").alias("report"))


def engine_durations(runs: DataFrame) -> DataFrame:
    """Duration statistics per engine.

    The median comes from running counts of distinct durations over chunks of a tenth of a second, so an engine's durations
    are never held together.
    """
    d = F.col("duration_sec")
    stats = runs.groupBy("engine").agg(
        F.count("*").alias("n"), F.avg(d).alias("mean_sec"), F.min(d).alias("min_sec"), F.max(d).alias("max_sec"),
        F.count(d).alias("_timed"), F.count_if(T.min_text(F.col("full_text"), 1)).alias("n_with_text"),
    )
    each = runs.filter(d.isNotNull()).groupBy("engine", "duration_sec").agg(F.count("*").alias("_n"))
    upto = ordered_scan(each, ["engine"], ["duration_sec"], F.floor(d * 10), counts={"_upto": F.col("_n")})
    # the middle row, or the two around the middle
    middle = upto.join(stats.select("engine", "_timed"), "engine").select(
        "engine", "duration_sec", ((F.col("_upto") * 2 >= F.col("_timed")).alias("low")), (F.col("_upto") * 2 > F.col("_timed")).alias("high"))
    median = middle.groupBy("engine").agg(
        ((F.min(F.when(F.col("low"), d)) + F.min(F.when(F.col("high"), d))) / 2).alias("median_sec"))
    return stats.join(median, "engine", "left").drop("_timed")


def doc_metrics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Line, word and box counts and text size per document."""
    counts = words.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_if(F.size("vertices") > 0).alias("n_boxes")
    )
    n_lines = F.size(T.text_lines(F.col("text")))
    kept = F.length(F.array_join(T.match_lines(F.col("text"), False), "\n"))
    lines = docs.select(
        "doc_id", n_lines.alias("n_lines"), F.length("text").alias("n_chars"),
        (kept / F.greatest(F.lit(1), F.length("text"))).alias("kept_share"),
    )
    zero = F.lit(0).cast("bigint")
    return lines.join(counts, "doc_id", "left").select(
        "doc_id", "n_lines", "n_chars", "kept_share",
        F.coalesce("n_words", zero).alias("n_words"), F.coalesce("n_boxes", zero).alias("n_boxes"),
    )
