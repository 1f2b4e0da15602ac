import random

import pytest
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry import fixtures as X
from docketry.functions.similarity import _lcs, lcs_lengths, token_set, with_similarity
from docketry.operators import classify as K
from docketry.plans import documents as P

SF = "/root/testdata/sf0.001"


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    """The published definition, spelled out."""
    ta, tb = set(a.lower().split()), set(b.lower().split())
    if not ta or not tb:
        return 0.0
    s, x, y = (" ".join(sorted(t)) for t in (ta & tb, ta - tb, tb - ta))
    if s and (not x or not y):
        return 100.0
    na, nb = len(" ".join(filter(None, (s, x)))), len(" ".join(filter(None, (s, y))))
    best = 100 - 100 * (len(x) + len(y) - 2 * lcs_table(x, y)) / (na + nb)
    if s:
        best = max(best, 100 - 100 * (1 + len(x)) / (len(s) + na), 100 - 100 * (1 + len(y)) / (len(s) + nb))
    return best


def ratios(spark, pairs, threshold=None):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, x string, y string")
    df = df.select("i", token_set(F.col("x")).alias("a"), token_set(F.col("y")).alias("b"))
    return {r["i"]: r["sim"] for r in with_similarity(df, "a", "b", "sim", threshold).collect()}


def test_hand_cases(spark):
    got = ratios(spark, [
        ("account number", "account statement"), ("date of birth", "date"), ("a b", "b a"), ("abc", "xyz"), ("", "abc"),
        ("Date-of,birth!", "BIRTH of date"), ("snake_case", "snake case"),
    ])
    assert round(got[0], 1) == 66.7
    assert got[1] == 100 and got[2] == 100 and got[3] == 0 and got[4] == 0 and got[5] == 100
    # an underscore is a word character
    assert got[6] < 100


def test_random_pairs_against_definition(spark):
    rng = random.Random(7)
    words = ["account", "number", "acount", "card", "of", "india", "identity", "identty", "x", "ab", "ba", "statement"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(1, 5))), " ".join(rng.choices(words, k=rng.randint(1, 6)))) for _ in range(400)]
    got = ratios(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(ratio(a, b)), (a, b)
    # symmetry, and the threshold form drops exactly the pairs below it
    back = ratios(spark, [(b, a) for a, b in pairs])
    assert all(got[i] == pytest.approx(back[i]) for i in got)
    high = ratios(spark, pairs, 75)
    assert set(high) == {i for i, v in got.items() if v >= 75}


def test_lcs():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abcd ", k=rng.randint(0, 90)))
        b = "".join(rng.choices("abcd ", k=rng.randint(0, 90)))
        assert _lcs(a, b) == lcs_table(a, b)


def naive_hits(lines, text, patterns, threshold=75):
    """Every pattern against every line in order, then the whole text."""
    out = {}
    for n, p in patterns:
        for line in [*lines, " ".join(text.split())]:
            r = ratio(K.plain_words(p), "".join(c if c.isalnum() or c == "_" else " " for c in line))
            if r >= threshold:
                out[n] = (line, int(r))
                break
    return out


def test_candidate_pruning_is_exact(spark):
    rng = random.Random(5)
    vocab = sorted({w for _, _, _, p in C.pattern_rows() for w in K.plain_words(p).split()}) + ["zz", "Dte", "acount", "numbr", "indla"]
    docs = []
    for i in range(60):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        docs.append((i, lines, "\n".join(lines)))
    for threshold in (60, 75, 90):
        df = spark.createDataFrame(docs, "doc_id bigint, lines array<string>, text string").withColumn("todo", K._every_pattern())
        got = {}
        for r in K.fuzzy_hits(df, threshold).collect():
            got.setdefault(r["doc_id"], {})[r["pattern_ord"]] = (r["hit"]["line"], int(r["hit"]["similarity"]))
        patterns = [(n, p) for _, _, n, p in C.pattern_rows()]
        for i, lines, text in docs:
            assert got.get(i, {}) == naive_hits(lines, text, patterns, threshold)


def classify(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in K.classify(df, **kw).orderBy("doc_id").collect()]


def test_first_line_wins_and_whole_text_is_last(spark):
    r = classify(spark, ["Acount Numbr\nAccount Numbe\nzzz", "statement\nof\nunrelated words", "permanent\naccount\nnumber\ncard"])
    by = lambda row: {m["pattern"]: m for m in row["matched"]}
    assert by(r[0])["Account Number"]["match"] == "Acount Numbr"
    assert by(r[0])["Account Number"]["method"] == "fuzzy"
    # a one-word line that is part of a pattern is a full match
    assert by(r[1])["Account Statement"]["score"] == 100
    full = by(r[2])["Permanent Account Number Card"]
    assert full["method"] == "fuzzy" and full["score"] == 100


def test_null_empty_and_plain_documents(spark):
    r = classify(spark, [None, "", "   \n ", "nothing to see"])
    assert [x["best_type"] for x in r] == ["UNKNOWN"] * 4
    assert len(r) == 4


def test_selection_rules(spark):
    rows = [
        (1, 0, "PAN_CARD", 3, True), (1, 3, "VOTER_ID", 3, True),      # tie: earlier type
        (2, 0, "PAN_CARD", 9, False), (2, 3, "VOTER_ID", 3, True),     # best is not acceptable
        (3, 0, "PAN_CARD", 2, False), (3, 4, "BANK_STATEMENT", 3, False),
    ]
    df = spark.createDataFrame(rows, "doc_id int, type_ord int, doc_type string, score int, acceptable boolean")
    best = {r[0]: r[1] for r in K.select_eligible(df).collect()}
    assert best == {1: "PAN_CARD", 2: "VOTER_ID", 3: "UNKNOWN"}
    top = {r["doc_id"]: r["best_type"] for r in K.select_argmax(df).collect()}
    assert top == {1: "PAN_CARD", 2: "PAN_CARD", 3: "BANK_STATEMENT"}
    top = {r["doc_id"]: r["best_type"] for r in K.select_argmax(df, C.RULES).collect()}
    assert top == {1: "PAN_CARD", 2: "PAN_CARD", 3: "UNKNOWN"}


def test_relevant_lines_of_the_best_type(spark):
    text = "INCOME TAX DEPARTMENT\nPermanent Account Number Card\nABCPK1234L\nDate of Birth\nGovernment of India\nmy pan number here"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    plains = K.matched_plains(K.classify(docs))
    assert "pan number" in plains.first()["plains"] and "government of india" not in plains.first()["plains"]
    got = [r["line"] for r in K.relevant_lines(docs.select("doc_id", F.split("text", "\n").alias("lines")), plains).orderBy("line_no").collect()]
    assert "Government of India" not in got and "my pan number here" in got


def test_scans_get_their_types(spark):
    docs = X.scans(spark, SF)
    got = K.classify(docs).join(docs.select("doc_id", "src_key"), "doc_id")
    counts = {(r[0], r[1]) for r in got.select(F.col("src_key") % 6, "best_type").distinct().collect()}
    assert counts == {(0, "AADHAAR_CARD"), (1, "UNKNOWN"), (2, "PAN_CARD"), (3, "DRIVING_LICENSE"), (4, "VOTER_ID"), (5, "BANK_STATEMENT")}


def test_python_only_for_pairs_that_need_it(spark):
    plan = K.classify_regex(X.scans(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Exchange hashpartitioning" not in plan
    plan = K.classify(X.scans(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pdf_children(spark):
    children = spark.createDataFrame([(1, 2, "PAN_CARD"), (1, 1, "UNKNOWN")], "parent int, child_no int, best_type string")
    parents = spark.createDataFrame([(1,), (2,), (2,)], "parent int")
    got = {r["parent"]: (r["n_children"], r["n_known"], r["document_type"], [tuple(c) for c in r["children"]]) for r in K.pdf_rollup(children, parents).collect()}
    assert got == {1: (2, 1, "PDF_CONTAINS_DOCUMENTS", [(1, "UNKNOWN"), (2, "PAN_CARD")]), 2: (0, 0, "ERROR", [])}
    flat = sorted((r[0], r[1] or 0, r[2]) for r in K.pdf_results(children, parents).collect())
    assert flat == [(1, 1, "UNKNOWN"), (1, 2, "PAN_CARD"), (2, 0, "ERROR")]


def test_medians_and_bad_responses(spark):
    import statistics
    from docketry.functions import geometry as G
    from docketry.operators import ocr as O
    rng = random.Random(2)
    runs = [("a", rng.choice([0.05, 0.5, rng.random() * 9]), "x") for _ in range(301)] + [("b", 1.0, "y"), ("b", 2.0, None), ("c", None, "z")]
    got = {r["engine"]: r["median_sec"] for r in O.engine_durations(spark.createDataFrame(runs, "engine string, duration_sec double, full_text string")).collect()}
    assert got["a"] == pytest.approx(statistics.median(d for e, d, _ in runs if e == "a")) and got["b"] == 1.5 and got["c"] is None
    payloads = ["[" * 60_000 + "]" * 60_000, '{"data": [{"note": {"text": "x"}}, {"fullTextAnnotation": {"text": "real"}}]}', '{"data": ', None,
                '{"a": [{"b": {"text": "first"}}, {"text": "second"}]}']
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, payload string")
    texts = {r["i"]: r["fta"]["text"] if r["fta"] else None for r in O.read_annotations(df).collect()}
    assert texts == {0: None, 1: "real", 2: None, 3: None, 4: "first"}
    point = spark.createDataFrame([("[99999999999 1]",)], "s string").select(G.points_from_string(F.col("s")).alias("p")).first()["p"][0]
    assert (point["x"], point["y"]) == (None, 1)


def test_whole_documents_are_classified(spark):
    """The queries over texts hold every document, and long documents as engines read them match by brute force."""
    from pyspark.sql import types as Y

    import __spark_entry__ as entry

    queries = entry.queries()
    n_docs = X.documents(spark, SF).count()
    for name in ("c4_select_eligible_texts", "c5_classification_struct_texts", "c_read_and_classify_texts"):
        got = {r.doc_id for r in queries[name](spark, SF).select("doc_id").collect()}
        unread = {40 * i for i in range(n_docs)} if name.startswith("c_read") else set()
        assert {i for i in got if i % 2 == 0} == {2 * i for i in range(n_docs)} - unread
        assert {i for i in got if i % 2} == {2 * r.doc_id + 1 for r in X.scans(spark, SF).collect()}

    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    lines = [" ".join(rng.choices(words, k=12)) for _ in range(1500)]
    lines[1400:1400] = ["Acount Numbr", "Date of Brth"]
    filler = "\n".join(" ".join(rng.choices(words, k=40)) for _ in range(400))
    docs = [(1, "\n".join(lines)), (2, filler + "\nAcount\nStatemnt"), (3, filler)]
    engines = [(i, e, k, t if e != "alpha" else None, 0.1, None) for i, t in docs for k, e in enumerate(("alpha", "beta"))]
    schema = Y.StructType.fromDDL("doc_id bigint, engine string, priority int, full_text string, duration_sec double, error string")
    rows = {r.doc_id: r for r in P.read_and_classify(spark.createDataFrame(engines, schema)).collect()}
    patterns = [(n, p) for _, _, n, p in C.pattern_rows() if "\\" not in p]
    for i, text in docs:
        seen = list(dict.fromkeys(text.split("\n")))
        want = naive_hits(seen, text, patterns)
        assert {m["pattern_ord"]: (m["match"], m["score"]) for m in rows[i]["matched"] if m["method"] == "fuzzy"} == want
    assert len([m for m in rows[1]["matched"] if m["method"] == "fuzzy"]) >= 2 and rows[3]["best_type"] == C.UNKNOWN


def test_lcs_of_many_pairs_at_once():
    """The batch kernel agrees with the one for a pair, over word borders, strange letters and empty texts."""
    rng = random.Random(12)
    letters = "abcde é中\U0001f389\ud800"
    text = lambda: "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 63, 64, 65, 130])))
    pairs = [(text(), text()) for _ in range(1500)] + [("a" * 64, "a" * 64), ("ab" * 32, "ba" * 100), ("", "")]
    assert lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [_lcs(a, b) for a, b in pairs]
    assert lcs_lengths([], []).tolist() == []


@pytest.mark.parametrize("threshold", [60, 75, 90])
def test_whole_text_travels_once(spark, threshold):
    """Patterns found only in the whole text, over line ends, have it as their match, however many they are."""
    from docketry.operators import classify as K

    words = [K.plain_words(p) for _, _, _, p in C.pattern_rows()]
    rest = "quite ordinary prose without the phrases looked for"
    broken = "\n".join(f"{w} {rest}" for p in words for w in p.split())
    docs = spark.createDataFrame([(1, broken), (2, "nothing of it"), (3, None)], "doc_id bigint, text string")
    rows = [r for r in K.pattern_hits(docs, threshold).collect() if r.method == "fuzzy"]
    whole = " ".join(broken.split())
    assert {r.doc_id for r in rows} == {1} and any(r.match == whole for r in rows)
    todo = list(range(len(words)))
    asked = docs.select("doc_id", "text", F.array(*map(F.lit, todo)).alias("todo"), F.split("text", "\n").alias("lines"))
    hits = K.fuzzy_hits(asked, threshold).collect()
    assert all((r.hit.line == whole) == (r.hit.line_no == 2**31 - 1) for r in hits if r.pattern_ord >= 0) and sum(r.hit.line == whole for r in hits) > 5


@pytest.mark.parametrize("threshold", [0, 0.5, 60, 75, 100])
def test_lines_against_all_patterns_at_once(threshold):
    """The batch form has exactly the pairs at or above the threshold, with the ratio as defined."""
    from docketry.functions.similarity import similar_pairs

    rng = random.Random(13)
    patterns = [sorted(set(K.plain_words(p).lower().split())) for _, _, _, p in C.pattern_rows()] + [[]]
    words = sorted({w for p in patterns for w in p}) + ["acount", "numbr", "é", "中", "x" * 70]
    lines = [" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(150)] + ["", " a ", "acount numbr", "date  of brth"]
    got = {(i, n): r for i, found in similar_pairs(lines, patterns, threshold).items() for n, r in found}
    want = {(i, n): ratio(" ".join(p), line) for i, line in enumerate(lines) for n, p in enumerate(patterns)}
    assert got == pytest.approx({k: r for k, r in want.items() if r >= threshold})


def test_a_document_is_one_row_until_its_lines_are_compared(spark):
    """Rows that wait for Python are documents, not pairs of lines and patterns, whose queue filled the disk.

    The one generator below makes a row of a row.
    """
    docs = X.scans(spark, SF).select("doc_id", "text", F.split("text", "\n").alias("lines"), K._every_pattern().alias("todo"))
    plan = K.fuzzy_hits(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    python = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    below = [line for line in plan[python[0]:] if "Generate" in line]
    assert len(python) == 1 and len(below) == 1 and "explode(array(struct(lines" in below[0]


def test_repeated_and_missing_ids_meet_as_before(spark):
    """Rows with one id, or without any, are one document whose hits are each pattern's first."""
    rows = [(1, "Date of Birth"), (1, "x\nDate of Birth\nAccount Numbr"), (None, "Acount Number"), (None, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in K.classify(docs).collect()}
    assert set(got) == {1, 2, None} and not got[2].matched
    asked = docs.select("doc_id", "text", F.split("text", "\n").alias("lines"), K._every_pattern().alias("todo"))
    hits = {(r.doc_id, r.pattern_ord): r.hit for r in K.fuzzy_hits(asked).collect()}
    birth = next(n for _, _, n, p in C.pattern_rows() if K.plain_words(p).lower() == "date of birth")
    assert hits[1, birth].line_no == 0 and {i for i, _ in hits} == {1, None}
