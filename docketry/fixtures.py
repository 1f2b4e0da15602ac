"""Input tables for the operators, derived by Spark from the given star-schema and text tables.

Each function reads whole tables and whole texts; sizes grow with the scale factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.ordered import ordered_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widen(df: DataFrame) -> DataFrame:
    """Spread an input of fewer partitions than cores, such as a file of one row group, which no split size divides."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


SCANS_SQL = """
SELECT doc_id, src_key,
       CASE WHEN k % 5 = 0 THEN replace(replace(replace(replace(replace(replace(t, 'OF', '0F'), 'Account', 'Acount'), 'Customer', 'Custmer'), 'Permanent', 'Permanant'), 'DRIVING', 'DRVING'), 'IDENTITY', 'IDENTTY') ELSE t END AS text
FROM (
 SELECT doc_id, k AS src_key, k,
  CASE k % 6
   WHEN 0 THEN 'Government of India' || nl || nm || nl || 'DOB: ' || d2 || '/07/1985' || nl || 'Male' || nl
               || substr(n12,1,4) || ' ' || substr(n12,5,4) || ' ' || substr(n12,9,4)
   WHEN 1 THEN 'Unique Identification Authority' || nl || 'Address: S/O ' || nm || nl || n12
   WHEN 2 THEN 'INCOME TAX DEPARTMENT' || nl || 'Permanent Account Number Card' || nl || 'ABCPK' || n4 || ltr || nl
               || nm || nl || 'Date of Birth'
   WHEN 3 THEN 'THE UNION OF INDIA' || nl || 'DRIVING LICENCE' || nl || 'DL no MH' || n4 || nl || 'COV LMV' || nl || nm
   WHEN 4 THEN 'ELECTION COMMISSION OF INDIA' || nl || 'IDENTITY CARD' || nl || 'XYZ' || substr(n12,6,7) || nl
               || 'Elector''s Name ' || nm
   ELSE 'Account Statement' || nl || 'Customer Name ' || nm || nl || 'Account Number ' || substr(n12,2,11) || nl
               || 'Branch MAIN IFSC TEST0' || n4
  END AS t
 FROM (SELECT c_custkey AS doc_id, c_custkey AS k, c_name AS nm, chr(10) AS nl,
   lpad(CAST(100000000000 + c_custkey * 7919 AS STRING), 12, '0') AS n12,
   lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS n4,
   lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS d2,
   chr(CAST(65 + c_custkey % 26 AS INT)) AS ltr
  FROM {customer}) a) b
"""


def scans_of(customer: DataFrame) -> DataFrame:
    """One scanned document per customer, six kinds, every fifth with OCR-like noise."""
    return customer.sparkSession.sql(SCANS_SQL, customer=customer)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans_of(widen(table(spark, sf_dir, "customer").select("c_custkey", "c_name")))


def scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents arriving as a stream."""
    schema = table(spark, sf_dir, "customer").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    return scans_of(files.select("c_custkey", "c_name"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as an OCR engine would list them."""
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("confidence", ((F.col("doc_id") + F.col("line_no")) % 100) / F.lit(100.0))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata, one upload per document."""
    ext = F.when(F.col("lang") == "en", ".PNG").when(F.col("lang") == "fr", ".tiff").when(F.col("lang") == "de", ".Pdf")
    ext = ext.when(F.col("source") == "src1", ".gif").otherwise("")
    name = F.format_string("%s/Scan #%d (%s).v1%s", "source", "doc_id", "lang", ext)
    return table(spark, sf_dir, "documents").select(
        name.alias("path"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("modificationTime"),
        F.col("n_chars").alias("length"),
        "doc_id",
        "lang",
        "source",
    )


def _token_arrays(text: Column) -> Column:
    """[(line_no, word_no, token)] of a text, empty tokens dropped, built inside the row."""
    lines = F.split(text, "\n")
    return F.flatten(
        F.transform(
            lines,
            lambda line, i: F.filter(
                F.transform(
                    F.split(line, " "),
                    lambda w, j: F.struct(i.alias("line_no"), j.alias("word_no"), w.alias("text")),
                ),
                lambda t: t["text"] != "",
            ),
        )
    )


def word_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document with rectangle geometry."""
    t = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    t = t.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    t = t.filter(F.col("text") != "")
    d, ln, w = F.col("doc_id"), F.col("line_no"), F.col("word_no")
    return t.select(
        "doc_id",
        F.lit(0).alias("page"),
        "line_no",
        "word_no",
        "text",
        (10 + 60 * w).cast("int").alias("left"),
        (100 + 40 * ln + (d * 7 + ln * 3 + w * 5) % 9).cast("int").alias("top"),
        F.lit(50).alias("width"),
        (20 + (w * 3 + d) % 7).cast("int").alias("height"),
        (((d + w) % 128) / F.lit(128.0)).alias("confidence"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word polygons; ``word_id`` orders the words of a page."""
    t = word_cells(spark, sf_dir)
    x1, y1 = F.col("left"), F.col("top")
    x2, y2 = x1 + F.col("width"), y1 + F.col("height")

    def pt(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    return t.select(
        "doc_id",
        "page",
        (F.col("line_no").cast("bigint") * 1000000 + F.col("word_no")).alias("word_id"),
        "text",
        F.array(pt(x1, y1), pt(x2, y1), pt(x2, y2), pt(x1, y2)).alias("vertices"),
        "confidence",
    )


def tsv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words as rectangle rows: block of three lines, one paragraph per block, -1 = no confidence."""
    t = word_cells(spark, sf_dir)
    return t.select(
        "doc_id",
        F.expr("CAST(line_no div 3 AS INT)").alias("block_num"),
        F.lit(0).alias("par_num"),
        "line_no",
        F.expr("CAST(line_no % 3 AS INT)").alias("line_num"),
        "word_no",
        "left",
        "top",
        "width",
        "height",
        F.when(F.col("word_no") % 11 == 0, F.lit(-1.0)).otherwise(F.col("confidence") * 100).alias("conf"),
        "text",
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region boxes: a page per order, a box per line item."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("page_id"),
        (F.col("l_partkey") * 10000000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("box_no"),
        F.expr("CAST((l_partkey * 13) % 600 AS INT)").alias("x"),
        F.expr("CAST((l_suppkey * 29) % 800 AS INT)").alias("y"),
        F.expr("CAST(40 + (l_partkey * 7) % 200 AS INT)").alias("w"),
        F.expr("CAST(20 + (l_suppkey * 11) % 150 AS INT)").alias("h"),
        F.expr("element_at(array('table', 'text_block', 'photo'), CAST(l_linenumber % 3 AS INT) + 1)").alias("kind"),
        F.expr("CAST(l_quantity AS INT)").alias("n_words"),
        (F.col("l_tax") * 5000).alias("variance"),
        (F.col("l_discount") * 200).alias("colourfulness"),
        (F.expr("(l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 997") / F.lit(997.0)).alias("score"),
    )


FRAME_CHUNK = 4096


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-track frame features from the event log; a track's frames are numbered in event order."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    ev = ordered_scan(ev, ["user_id"], ["event_id"], F.expr("event_id div 100000"))
    return ev.select(
        (F.col("user_id") % 8).alias("camera_id"),
        F.col("user_id").alias("track_id"),
        F.col("row_no").alias("frame_idx"),
        "ts",
        (F.expr("(event_id * 7919) % 400").cast("double") / 1000).alias("ear"),
        F.expr("CAST((event_id * 31) % 640 AS INT)").alias("cx"),
        F.expr("CAST((event_id * 17) % 480 AS INT)").alias("cy"),
        F.expr("CAST(80 + event_id % 200 AS INT)").alias("bw"),
        (F.expr("(event_id * 104729) % 100").cast("double") / 160).alias("mouth_w_ratio"),
        (F.expr("(event_id * 1299709) % 100").cast("double") / 250).alias("mouth_open_ratio"),
        F.expr("(event_id * 613) % 1000 < 120").alias("is_fake"),
        F.expr("CAST((event_id * 97) % 500 AS INT)").alias("bright_px"),
        F.expr("CAST((event_id * 53) % 3 * 1000 AS INT)").alias("mouth_px"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes per camera: two detections a frame, centres drift, some jump, some frames are missing.

    ``frame_idx`` skips ahead by 14 frames after every 40th frame of a camera, so tracks also expire.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    ev = ev.withColumn("camera_id", F.col("user_id") % 8)
    ev = ordered_scan(ev, ["camera_id"], ["event_id"], F.expr("event_id div 100000"))
    step = F.expr("(row_no - 1) div 2")
    det = ((F.col("row_no") - 1) % 2).cast("int")
    e = F.col("event_id")
    x = 100 + 320 * det + (step * 3) % 60 + F.when(e % 17 == 0, 90).otherwise(0)
    y = 120 + (step * 5) % 80 + F.when(e % 23 == 0, 70).otherwise(0)
    w = 60 + (e % 90)
    return ev.select(
        "camera_id",
        (step + F.expr("((row_no - 1) div 80) * 14") + 1).alias("frame_idx"),
        det.alias("det_no"),
        "ts",
        x.cast("int").alias("x"),
        y.cast("int").alias("y"),
        w.cast("int").alias("w"),
        (w + 10).cast("int").alias("h"),
        (x + F.expr("(60 + event_id % 90) div 2")).cast("int").alias("cx"),
        (y + F.expr("(70 + event_id % 90) div 2")).cast("int").alias("cy"),
        (F.expr("(event_id * 7919) % 400").cast("double") / 1000).alias("ear"),
        (F.expr("(event_id * 104729) % 100").cast("double") / 160).alias("mouth_w_ratio"),
        (F.expr("(event_id * 1299709) % 100").cast("double") / 250).alias("mouth_open_ratio"),
        F.expr("(event_id * 613) % 1000 < 120").alias("is_fake"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object detections with class, confidence and corner boxes in small-frame pixels."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") % 8).alias("camera_id"),
        F.expr("event_id div 5 + 1").alias("frame_idx"),
        F.expr("CAST(event_id % 5 AS INT)").alias("obj_no"),
        F.expr("element_at(array(0, 62, 63, 67, 2), CAST(event_id * 13 % 5 AS INT) + 1)").alias("class_id"),
        F.expr("element_at(array('person', 'tv', 'laptop', 'cell phone', 'car'), CAST(event_id * 13 % 5 AS INT) + 1)").alias("class_name"),
        (F.expr("event_id * 37 % 100").cast("double") / 100).alias("conf"),
        F.expr("CAST(event_id * 11 % 150 AS INT)").alias("x1"),
        F.expr("CAST(event_id * 7 % 90 AS INT)").alias("y1"),
        F.expr("CAST(event_id * 11 % 150 + 60 + event_id % 180 AS INT)").alias("x2"),
        F.expr("CAST(event_id * 7 % 90 + 50 + event_id % 140 AS INT)").alias("y2"),
    )


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """468-point face meshes in normalised coordinates, one per event; made in Arrow batches, a mesh is 7.5 kB."""
    ev = widen(table(spark, sf_dir, "events").select("event_id"))
    points, batch_rows = 468, 512

    def axis(ids: np.ndarray, known: np.ndarray, base: int, step: int, stride: int, span: int, size: float) -> pa.Array:
        # fmod: a remainder takes the sign of the dividend, as in SQL
        moved = np.fmod(ids[:, None] * step + np.arange(points, dtype=np.int64) * stride, span)
        return pa.array(((base + moved) / size).ravel(), mask=None if known.all() else ~np.repeat(known, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                ids = whole.column(0).slice(at, batch_rows)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                n = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                xy = [axis(n, known, 200, 7, 37, 240, 640.0), axis(n, known, 100, 5, 53, 280, 480.0)]
                meshes = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(n) + 1, dtype=np.int32) * points), pa.StructArray.from_arrays(xy, ["x", "y"]))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), meshes], ["event_id", "landmarks"])

    mesh = ev.mapInArrow(run, "event_id bigint, landmarks array<struct<x:double,y:double>>")
    return mesh.select("event_id", F.lit(640).alias("frame_w"), F.lit(480).alias("frame_h"), "landmarks")


def engine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three engines per document; an engine may fail, return junk, or return blanks."""
    d = documents(spark, sf_dir)
    i, text = F.col("doc_id"), F.col("text")
    err = F.when(i % 10 == 0, "engine failed")

    def run(engine: str, priority: int, full_text: Column, duration: Column, error: Column) -> Column:
        return F.struct(
            F.lit(engine).alias("engine"), F.lit(priority).alias("priority"), full_text.alias("full_text"),
            duration.alias("duration_sec"), error.alias("error"),
        )

    none = F.lit(None).cast("string")
    runs = F.array(
        run("alpha", 1, F.when(i % 5 == 0, none).when(i % 5 == 1, "abc").otherwise(text), 0.1 * (i % 17), none),
        run("beta", 2, F.when(i % 10 == 0, none).otherwise(F.replace(text, F.lit("e"), F.lit("c"))), 0.2 * (i % 13), err),
        run("gamma", 3, F.when(i % 20 == 0, "  ").otherwise(F.concat(text, F.lit("\ngamma"))), 0.05 * (i % 11), none),
    )
    return d.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.*")


_CONTROL = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _escaped(texts: pa.Array) -> pa.Array:
    """What stands between the quotes of a JSON string."""
    for plain, code in (("\\", "\\\\"), ('"', '\\"')):
        texts = pc.replace_substring(texts, plain, code)
    if pc.any(pc.match_substring_regex(texts, r"[\x00-\x1f]")).as_py():
        for i in range(32):
            texts = pc.replace_substring(texts, chr(i), _CONTROL.get(i, f"\\u{i:04X}"))
    return texts


def _strings(*parts) -> pa.Array:
    """Row by row concatenation of arrays of strings, numpy integers and fixed strings."""
    cast = [pc.cast(pa.array(p), pa.string()) if isinstance(p, np.ndarray) else p for p in parts]
    return pc.binary_join_element_wise(*cast, "")


def _listed(items: pa.Array, counts: np.ndarray, separator: str = ",") -> pa.Array:
    """Each next ``counts`` items joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), items), separator)


def _box_json(x1, y1, x2, y2) -> list:
    parts = ['"boundingBox":{"vertices":[']
    for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2)):
        parts += ['{"x":', x, ',"y":', y, "},"]
    return [*parts[:-1], "}]}}"]


def _chosen(rule: np.ndarray, text: str) -> pa.Array:
    return pa.array(["", text]).take(pa.array(rule.astype(np.int8)))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Elements of all lists, the list of each, and its place there."""
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), counts)
    return lists.flatten(), owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _words_json(ids: np.ndarray, i: np.ndarray, j: np.ndarray, words: pa.Array) -> pa.Array:
    """A word each, of document ``ids``, line ``i`` and place ``j``; ``words`` are escaped."""
    y = 100 + 40 * i + np.fmod(ids * 7 + i * 3 + j * 5, 9)
    of_symbols = pc.replace_substring_regex(words.filter(pa.array(j % 7 == 0)), r"(?s)\\u[0-9A-F]{4}|\\.|.", r',{"text":"\0","confidence":0.5}')
    body = pc.replace_with_mask(
        _strings('"text":"', words, '",'), pa.array(j % 7 == 0), _strings('"symbols":[', pc.utf8_slice_codeunits(of_symbols, 1), "],"))
    shares = pa.array([f'"confidence":{n / 128},' for n in range(-127, 128)] + [""])
    share = shares.take(pa.array(np.where(j % 5 != 0, np.fmod(ids + j, 128) + 127, 255)))
    return _strings("{", body, share, *_box_json(10 + 60 * j, y, 60 + 60 * j, y + 20 + np.fmod(j * 3 + ids, 7)))


def _annotations_json(ids: np.ndarray, texts: pa.Array) -> pa.Array:
    """The annotation of each text; ``annotations`` says how they differ."""
    shape = np.fmod(ids, 6)
    lines, doc, i = _flat(pc.split_pattern(texts, "\n"))
    lines = _escaped(lines)
    words, line, j = _flat(pc.split_pattern(lines, " "))
    last = np.bincount(line, minlength=len(lines)) - 1
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    n_words = np.bincount(line[full], minlength=len(lines))
    worded, texted = np.isin(shape, (0, 2, 4))[doc], np.isin(shape, (1, 3))[doc]

    pick = full & worded[line]
    line, j = line[pick], j[pick]
    listed = _listed(_words_json(ids[doc[line]], i[line], j, words.filter(pa.array(pick))), np.where(worded, n_words, 0))
    kept = n_words > 0
    lines, listed = lines.filter(pa.array(kept)), listed.filter(pa.array(kept))
    doc, i, last, worded, texted = doc[kept], i[kept], last[kept], worded[kept], texted[kept]
    text = pc.if_else(pa.array(texted), _strings('"text":"', lines, '",'), "")
    listed = pc.if_else(pa.array(worded), _strings('"words":[', listed, "],"), "")
    top = 100 + 40 * i
    paragraphs = _strings("{", text, _chosen(i % 5 == 0, '"confidence":0.9,'), listed, *_box_json("10", top, 60 + 60 * last, top + 30))

    # a block is up to three lines of a document
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (i[1:] // 3 != i[:-1] // 3))[: len(doc)])
    sizes, of, y = np.diff(np.append(first, len(doc))), shape[doc[first]], i[first] // 3 * 120
    inside = pc.if_else(pa.array(of == 5), _listed(lines, sizes, "\\n"), _listed(paragraphs, sizes))
    keys = ['"paragraphs":[', '"lines":[', '"text":"', ""]
    kind = np.select([np.isin(of, (0, 1)), np.isin(of, (2, 3)), of == 5], [0, 1, 2], 3)
    inside = pc.if_else(pa.array(kind == 3), "", inside)
    ends = pa.array(["],", "],", '",', ""])
    blocks = _strings("{", pa.array(keys).take(pa.array(kind)), inside, ends.take(pa.array(kind)), *_box_json("0", y, "900", y + 119))

    whole = pc.if_else(pa.array(np.fmod(ids, 3) == 0), _strings('"text":"', _escaped(texts), '",'), "")
    paged = _listed(blocks, np.bincount(doc[first], minlength=len(ids)))
    bare = _listed(paragraphs, np.bincount(doc, minlength=len(ids)))
    body = pc.if_else(pa.array(shape == 4), _strings('"paragraphs":[', bare, "]"), _strings('"pages":[{"blocks":[', paged, "]}]"))
    return _strings("{", whole, body, "}")


def _responses(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """A response per row; rows without id or text are rare and made one by one."""
    known = pc.and_(ids.is_valid(), texts.is_valid())
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    place = np.full(len(ids), -1)
    place[at] = np.arange(len(at))
    made = _annotations_json(numbers[at], texts.filter(known))
    heads = ['{"fullTextAnnotation":', '{"data":{"fullTextAnnotation":', '{"results":[{"Data":{"responses":[{"fullTextAnnotation":', '{"items":[{"odd":']
    tails = ["}", "}}", "}]}}]}", "}]}"]
    head, tail, other = [], [], []
    for row, valid in enumerate(ids.is_valid().to_pylist()):
        n, text = int(numbers[row]), place[row] >= 0
        kind = int(np.fmod(n, 4)) if valid else 3
        kind = kind if kind >= 0 else 3
        alone = None
        if valid and np.fmod(n, 24) == 23:
            if n % 72 == 23:
                alone = '{"status": "failed"}'
            elif n % 72 == 47:
                cut = '"text":"' + _escaped(texts[row : row + 1])[0].as_py() + '"}' if text else "}"
                alone = '{"data": ' + ('{"t":""}' if text else "{}") + ', "cut": "' + cut
            else:
                alone = "[" * 60_000 + "]" * 60_000
        listed = valid and np.fmod(n, 48) == 7
        head.append('{"data": [{"note": {"text": "x"}}, {"fullTextAnnotation":' if listed else heads[kind])
        tail.append("}]}" if listed else tails[kind])
        empty = '{"pages":[{}]}' if valid and np.fmod(n, 6) != 4 else "{}"
        other.append(alone if alone is not None else None if text else head[-1] + empty + tail[-1])
    made = made.take(pa.array(np.where(place < 0, None, place), pa.int64()))
    return pc.coalesce(pa.array(other, pa.string()), _strings(pa.array(head), made, pa.array(tail)))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON responses of a page reader, one per document, built in Arrow batches from the whole text.

    ``doc_id % 6`` picks the shape: 0 paragraphs with words, 1 paragraphs with text only, 2 block lines
    with words, 3 block lines with text only, 4 top-level paragraphs without pages, 5 blocks with text
    only.  ``doc_id % 4`` picks the wrapper; the fourth is unusual, and ``doc_id % 24 = 23`` has no
    annotation at all: none in the response, a response cut off, or one nested 60,000 deep.  ``doc_id % 48 = 7`` has a list as wrapper, whose first item only looks like one.  Words with ``word_no % 7 = 0`` carry only symbols, words with
    ``word_no % 5 = 0`` no confidence, lines with ``line_no % 5 = 0`` a confidence of their own.
    """
    d = documents(spark, sf_dir).select("doc_id", "text")
    batch_bytes = 1 << 18  # a response is up to 30 times its text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids, texts = whole.columns
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 16)
            cuts = np.flatnonzero(np.diff(size // batch_bytes, prepend=0)) if len(size) else []
            for at, end in zip([0, *cuts], [*cuts, len(size)]):
                if end > at:
                    part = ids.slice(at, end - at), texts.slice(at, end - at)
                    yield pa.RecordBatch.from_arrays([part[0], _responses(*part)], ["doc_id", "payload"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, payload string")


def word_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of words, polygons and scores; polygons or scores may be short."""
    d = documents(spark, sf_dir).withColumn("t", _token_arrays(F.col("text")))
    poly = "array(array(x, y), array(x + 50, y), array(x + 50, y + h), array(x, y + h))"
    return d.select(
        "doc_id",
        F.expr("transform(t, e -> concat(e.text, ' '))").alias("rec_texts"),
        F.expr(
            f"""transform(slice(t, 1, greatest(0, size(t) - if(doc_id % 3 = 0, 1, 0))), e -> transform(array(struct(
              10.5D + 60 * e.word_no AS x, 100.5D + 40 * e.line_no AS y, 20.0D + doc_id % 7 AS h)), g ->
              {poly.replace("x,", "g.x,").replace("x +", "g.x +").replace("y)", "g.y)").replace("y +", "g.y +").replace(" h)", " g.h)")})[0])"""
        ).alias("rec_polys"),
        F.expr("transform(slice(t, 1, greatest(0, size(t) - if(doc_id % 2 = 0, 1, 0))), e -> ((doc_id + e.word_no) % 128) / 128.0D)").alias("rec_scores"),
    )
