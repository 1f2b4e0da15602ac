import json
import os

import pytest

from pyspark.sql import functions as F

from docketry import fixtures as X
from docketry.operators import classify as K
from docketry.operators import layout as L
from docketry.plans import documents as P
from docketry.plans import layout as PL
from docketry.sources import readers as R
from docketry.sources import sinks as S

SF = "/root/testdata/sf0.001"


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.png", "b.PnG", "c.Pdf", "d.txt", "sub/e.jpg", "noext", "f.jPeG"):
        (tmp_path / name).write_bytes(b"x" * 10)
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.select("path").collect())
    flat = R.scan_files(spark, str(tmp_path), content=False)
    assert names(flat) == ["a.png", "b.PnG", "c.Pdf", "f.jPeG"] and "content" not in flat.columns
    assert names(R.scan_files(spark, str(tmp_path), recursive=True)) == ["a.png", "b.PnG", "c.Pdf", "e.jpg", "f.jPeG"]
    assert R.scan_files(spark, str(tmp_path)).first()["content"] == bytearray(b"x" * 10)


def test_read_label_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("image,x0,y0,x1,y1,width,height\na.jpg,1,2,3,4,640,480\nb.jpg,1,2,3,4,640,tall\n")
    rows = R.read_label_csv(spark, str(tmp_path)).orderBy("image").collect()
    assert [r["height"] for r in rows] == [480, None] and rows[0]["image"] == "a.jpg"


def test_read_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"data":\n {"fullTextAnnotation": {"text": "t"}}}')
    from docketry.operators import ocr as O
    r = O.read_annotations(R.read_responses(spark, str(tmp_path))).first()
    assert r["wrapper"] == "data" and r["fta"]["text"] == "t"


def test_a_run_replaces_itself_only(spark, tmp_path):
    c = K.classify(X.scans(spark, SF))
    out = str(tmp_path / "out")
    for run in ("r1", "r2", "r1"):
        S.write_results_json(c, out, run)
    back = spark.read.json(out)
    n = c.filter("best_type <> 'UNKNOWN'").count()
    assert {(r["run_id"], r["count"]) for r in back.groupBy("run_id").count().collect()} == {("r1", n), ("r2", n)}


def test_routing(spark, tmp_path):
    df = spark.createDataFrame([("PAN_CARD", 3, "a b.png"), ("BANK_STATEMENT", 3, "c.png"), ("UNKNOWN", 9, "d.png")], "best_type string, score int, file_name string")
    got = {r["out_name"]: r["route"] for r in S.route_results(df).collect()}
    assert got == {"a_b.json": "main", "other_c.json": "Others", "other_d.json": "Others"}
    S.write_routed(df, str(tmp_path / "o"), "r1")
    assert spark.read.json(str(tmp_path / "o")).filter("route = 'Others'").count() == 2


def test_sorted_text_in_order(spark, tmp_path):
    lines = L.sorted_lines(L.group_lines(L.word_boxes(X.words(spark, SF))))
    S.write_sorted_text(lines, str(tmp_path / "t"), "r1")
    got = spark.read.option("sep", "\t").schema("doc_id bigint, line_ord int, text string").csv(str(tmp_path / "t" / "run_id=r1"))
    assert got.count() == lines.count()
    for _ in range(2):
        S.write_text_files(S.document_text(lines.filter("doc_id < 3")), str(tmp_path / "f"), "r1")
    assert sorted(r["doc_id"] for r in spark.read.json(str(tmp_path / "f")).collect()) == [0, 1, 2]


def test_empty_lines_kept_or_skipped(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, " "), (1, 3, "b")], "doc_id int, line_ord int, text string")
    assert S.document_text(df).first()["content"] == "a\nb"
    assert S.document_text(df, keep_empty=True).first()["content"] == "a\n \nb"


def test_tables_and_manifests(spark, tmp_path):
    seg = PL.segment_pages(X.boxes(spark, SF), 840, 960)
    m = PL.manifests(seg)
    one = m.filter("n_segments > 2").first()
    assert [s["id"] for s in one["segments"]] == list(range(1, one["n_segments"] + 1))
    kinds = [s["type"] for s in one["segments"]]
    assert kinds == sorted(kinds, key=["table", "text_block", "photo"].index)
    some = seg.filter("page_id < 20")
    S.write_manifest(some.withColumn("filename", F.col("page_id").cast("string")), str(tmp_path / "m"), "r1")
    files = [f for _, _, fs in os.walk(tmp_path / "m") for f in fs if f.endswith(".json")]
    assert files
    rows = some.filter("type = 'table'").select(F.col("page_id").cast("string").alias("filename"), F.col("id").alias("segment"), F.lit("a | b").alias("row"))
    S.write_tables_csv(rows, str(tmp_path / "c"), "r1")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == rows.count()


def test_events_by_kind(spark, tmp_path):
    from docketry.operators import tracks as V
    ev = spark.createDataFrame([(1, "REAL_SMILE"), (2, "FAKE_SMILE"), (3, "blink")], "frame_idx int, event_kind string")
    routed = V.route_events(ev)
    assert sorted((r[0], r[1]) for r in routed.collect()) == [(1, "REAL_SMILE"), (1, "smile"), (2, "FAKE_SMILE"), (2, "smile"), (3, "blink")]
    S.write_events(routed, str(tmp_path / "e"), "r1")
    assert sorted(os.listdir(tmp_path / "e" / "run_id=r1"))[-1] == "event_kind=smile"


def test_ids_repeat_for_one_run_only(spark):
    f = X.files(spark, SF)
    a, b, c = (P.assign_txn(f, run).select("txn_id").collect() for run in ("x", "x", "y"))
    assert a == b and a != c and len({r[0] for r in a}) == len(a) and len(a[0][0]) == 12


def test_failed_documents_stay(spark):
    from docketry.operators import ocr as O
    runs = spark.createDataFrame([(1, "a", 1, "some text", None), (2, "a", 1, None, "boom"), (3, "a", 1, " ", None)], "doc_id int, engine string, priority int, full_text string, error string")
    types = spark.createDataFrame([(1, "PAN_CARD")], "doc_id int, best_type string")
    got = {r["doc_id"]: (r["document_type"], r["error"]) for r in P.error_record(O.engine_fallback(runs), runs, types).collect()}
    assert got == {1: ("PAN_CARD", None), 2: ("ERROR", "boom"), 3: ("ERROR", "no engine returned text")}
    assert P.read_and_classify(runs.withColumn("doc_id", F.col("doc_id").cast("bigint"))).count() == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    rows = entry.entry(spark).collect()
    assert sum(r["n_docs"] for r in rows) == X.scans(spark, SF).count()
    json.dumps(sorted(q))


def test_a_failed_rewrite_leaves_the_old_run(spark, tmp_path):
    """A rewrite that dies in the middle changes nothing; one that dies between the renames is set right."""
    out = str(tmp_path / "runs")
    events = spark.range(100).select(F.col("id").alias("frame_idx"), F.when(F.col("id") % 2 == 0, "blink").otherwise("smile").alias("event_kind"))
    S.write_events(events, out, "r1")
    S.write_events(events.limit(10), out, "r2")
    count = lambda: {r["run_id"]: r["count"] for r in spark.read.json(out).groupBy("run_id").count().collect()}
    assert count() == {"r1": 100, "r2": 10}
    dies = events.repartition(4).withColumn("frame_idx", F.when(F.col("frame_idx") == 77, F.raise_error("killed").cast("long")).otherwise(F.col("frame_idx")))
    with pytest.raises(Exception, match="killed"):
        S.write_events(dies, out, "r1")
    assert count() == {"r1": 100, "r2": 10}
    # killed after the old run was moved aside
    os.makedirs(tmp_path / "runs" / "_replaced", exist_ok=True)
    os.rename(tmp_path / "runs" / "run_id=r1", tmp_path / "runs" / "_replaced" / "run-r1")
    assert count() == {"r2": 10}
    with pytest.raises(Exception, match="killed"):
        S.write_events(dies, out, "r1")
    assert count() == {"r1": 100, "r2": 10}
    S.write_events(events.limit(30), out, "r1")
    assert count() == {"r1": 30, "r2": 10} and not S.recover(spark, out, "r1")
    assert not os.listdir(tmp_path / "runs" / "_staging") and not os.listdir(tmp_path / "runs" / "_replaced")


def test_scratch_tables_go(spark):
    from docketry.operators import tracks as V

    faces = X.faces(spark, SF)
    with R.scratch(spark) as folder:
        n = V.track_faces(faces).count()
        assert n == faces.count() and os.listdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:")) and R.shared_folder(spark, "x").count("scratch") == 0
