"""BPE, language, joins and weak-label models against libraries, brute force, round trips and held-out accuracy."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import bpe, cells, embedding_dedup, hashing, language, ngram_join, quality_model, toxicity, weak
from docketry.llm.common import components, held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.01"
WORD_SPLIT = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.Encoder(bpe.rank_lines(RANKS)).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pre_tokens_and_merges(encoding):
    encoder, rng = bpe.Encoder(bpe.rank_lines(RANKS)), random.Random(2)
    bits = list("abstrevldm '\n\t \r\x1c\x85\xa0　​0²1½éñ中한!?-_.") + ["'s", "'re", "'ll", " '", "\n\n", "\U0001f389"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 30_000, "'s" * 500, " " * 3000 + "x", "é!" * 2000]
    for part in bpe.chunks(texts):
        for text, packed in zip(part, encoder.encode(part)):
            assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)


def test_every_code_point(encoding):
    encoder = bpe.Encoder(bpe.rank_lines(RANKS))
    points = [*range(1, 0xD800, 3), *range(0xE000, 0x30000, 5), *range(0xE0000, 0xE0200)]
    texts = ["a%ca1%c1" % (p, p) for p in points]
    for text, packed in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)


def test_bpe_round_trip(spark, encoding):
    texts = [None, "", "it's here\n\n  now", "ü中\U0001f389" * 50, "word " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = df.select("i", bpe.encode(F.col("text"), RANKS).alias("e")).select("i", "e.*")
    out = out.withColumn("back", bpe.decode(F.col("ids"), F.col("offsets"), RANKS))
    assert out.collect() == df.select("i", bpe.recode(F.col("text"), RANKS).alias("e")).select("i", "e.*").collect()
    for r in out.collect():
        raw = (texts[r.i] or "").encode()
        ids = np.frombuffer(r.ids, "<u4")
        assert bytes(r.back) == raw and ids.tolist() == encoding.encode_ordinary(raw.decode())
        at = np.frombuffer(r.offsets, "<u4")
        assert len(at) == len(ids) and (not len(at) or encoding.decode_bytes(ids[: len(at) // 2].tolist()) == raw[: at[len(at) // 2]])
    assert out.limit(0).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    rows = docs.select("lang", held_out(F.col("doc_id")).alias("h"), language.predict(F.col("text"), model).alias("p")).filter("h AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.p.lang for r in rows]) > 0.97
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "12 !! 34", None), (4, "x", None), (5, "the and of " * 9000, None)], "doc_id long, text string, lang string")
    got = [r.p for r in odd.select(language.predict(F.col("text"), model).alias("p")).collect()]
    assert [p.lang for p in got[:3]] == ["und"] * 3 and got[4].lang == "en" and all(0 <= p.score <= 1 for p in got)
    assert language.fit(odd) is None
    assert odd.select(language.predict(F.col("text"), None).alias("p")).filter("p.lang = 'und'").count() == 5


def shingles(text):
    w = [x for x in "".join(" " if c in WORD_SPLIT else c for c in text or "").split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(sets, near):
    ids = sorted(sets)
    links = {i: {j for j in ids if i != j and near(sets[i], sets[j])} for i in ids}
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
        if new == root:
            return {i: (root[i], len(links[i])) for i in ids}
        root = new


def jaccard(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.8


def test_shingle_hashes_match_sets():
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 30))) + rng.choice(["", "\t", "\x85z"]) for _ in range(200)]
    sets = hashing.shingle_sets(texts, 5, hashing.Powers())
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    counts = ngram_join.shared_counts([s for s in sets if len(s)])
    full = [shingles(t) for t in texts if shingles(t)]
    assert all(counts[i, j] == len(full[i] & full[j]) for i in range(len(full)) for j in range(i))


def test_ngram_join(spark):
    rng = random.Random(4)
    vocab = ["w%d" % k for k in range(300)]
    base = [rng.choices(vocab, k=rng.choice([3, 6, 20, 80, 300])) for _ in range(25)]
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two"), (5, "one  two"), (6, "one two three four five"), (None, "one two")]
    for i in range(10, 300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    big = rng.choices(vocab, k=400)
    for i in range(1000, 1400):  # one group of near copies larger than a bucket
        w = list(big)
        w[rng.randrange(400)] = "x%d" % i
        rows.append((i, " ".join(w)))
    rows += rows[10:14]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, idx int, cell int, first int")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(df).collect()}
    assert got == brute({i: shingles(t) for i, t in rows if i is not None}, jaccard)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    rows = [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] * 16, 1), (4, [1.0] * 16, None), (5, [1.0] * 8, 1), (6, [None] * 16, 1), (7, [], 1),
            (8, [float("inf")] * 16, 1), (9, [1e30] * 16, 1), (10, [1e-30] * 16, 1)]
    centres = rng.normal(size=(30, 16))
    for i in range(11, 700):
        c = centres[rng.integers(30)] if i > 400 else centres[0]
        rows.append((i, (c + rng.normal(size=16) * 0.18).tolist(), int(rng.integers(2))))
    rows += [rows[50], rows[60], (2000, rows[50][1], rows[50][2])]
    df = spark.createDataFrame([(i, v, k, 0) for i, v, k in rows], "vec_id long, embedding array<double>, label int, size int")
    good = {i: (k, np.array(v, float)) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (k, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())) for i, (k, v) in good.items()}
    want = brute({i: unit.get(i) for i, _, _ in rows}, lambda a, b: bool(a and b) and a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93)
    got = {r.vec_id: (r.component_id, r.n_links) for r in embedding_dedup.link(df).collect()}
    assert got.keys() == want.keys()
    assert sum(n for _, n in got.values()) >= 0.999 * sum(n for _, n in want.values())
    assert all(got[i][1] <= want[i][1] for i in want) and np.mean([got[i] == want[i] for i in want]) > 0.99
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_cells_meet_every_pair_once(spark):
    leaves = spark.createDataFrame([(i, 0, 7, 300) for i in range(300)] + [(i, 1, 8, 2) for i in range(2)], "idx long, run int, leaf long, n long")
    rows = cells.cells(leaves, most=64).orderBy("cell").toPandas()
    met = set()
    for i, j in cells.neighbours(rows["cell"].to_numpy(), rows["side"].to_numpy(), rows["cross"].to_numpy()):
        for a, b, r in zip(rows["idx"].to_numpy()[i], rows["idx"].to_numpy()[j], rows["run"].to_numpy()[i]):
            assert (r, min(a, b), max(a, b)) not in met
            met.add((r, min(a, b), max(a, b)))
    assert len(met) == 300 * 299 // 2 + 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    sets = {i: i for e in edges for i in e if e[0] != e[1]}
    want = brute(sets, lambda a, b: (a, b) in edges or (b, a) in edges)
    assert got == {i: r for i, (r, _) in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.3
    vote = lambda acc: np.where(rng.random(6000) < 0.7, np.where(rng.random(6000) < acc, 1, -1) * np.where(y, 1, -1), 0)
    votes = np.stack([vote(a) for a in (0.95, 0.85, 0.75, 0.9)] + [rng.integers(-1, 2, 6000)], 1)
    votes = np.concatenate([votes, votes[:, 2:3]], 1)  # a copy of a voter
    model, p = weak.fit_labels(votes, 0.4)
    assert ((p > 0.5) == y).mean() > 0.88
    right = lambda j: model.tables[j, 2, 1] / (model.tables[j, 2, 1] + model.tables[j, 0, 1])
    assert right(0) > right(1) > 0.75 and model.weights[2] < 0.7 < model.weights[0] and model.correlations[2, 5] > 0.9


def test_toxicity(spark):
    rng = random.Random(9)
    vocab = ["word%d" % k for k in range(400)]
    bad = ["vilest", "rotter", "cadlike", "swinish"]
    rows, labels = [], []
    for i in range(1200):
        w, toxic = rng.choices(vocab, k=rng.randint(20, 60)), i % 6 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "x", 0))
        labels.append((i, int(toxic) if i % 7 else None))
    rows += [(5000, None, "x", 0), (5001, "", "x", 0), (5002, "rotter vilest " * 20_000, "x", 0), (None, "word1", "x", 0), (3, rows[3][1], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, y int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), model).alias("s")).collect()}
    assert all((got[i] >= 0.3) == (i % 6 == 0) for i in range(1200))
    assert got[5000] == got[5001] < 0.3 <= got[5002] <= 1
    assert toxicity.fit(docs, marks.limit(0)) is None and toxicity.fit(docs.limit(0), marks) is None


def test_quality_model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.fit(docs)
    rows = docs.join(labels, "doc_id").select("quality", quality_model.score(F.col("text"), model).alias("s")).collect()
    assert np.mean([(r.s >= 0.5) == r.quality for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000), (None, "a b")], "doc_id long, text string")
    assert [r.s for r in odd.select(quality_model.score(F.col("text"), model).alias("s")).collect()][:2] == [0.0, 0.0]
    assert quality_model.fit(odd.limit(0)) is None


def test_quality_model_counts_all_documents(spark):
    """Votes of every document count, and a rare kind of text reaches the scorer's sample whatever the rows' order or bound."""
    assert quality_model.quotas(np.array([1, 5, 900, 900]), 206).tolist() == [1, 5, 100, 100]
    assert quality_model.quotas(np.array([3, 4, 5]), 2).tolist() == [1, 1, 1]

    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "river", "stone", "walked", "Later", "green."]) for _ in range(80)) + "." for _ in range(600)]
    rare = ["| cell | cell " * 30 + str(i) for i in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + rare)], "doc_id long, text string")
    model = quality_model.fit(docs, max_rows=40)
    # the tables hold all 603 documents, so the least probability is that of one in so many
    votes = np.concatenate([quality_model.observe([t], hashing.Powers())[0] for t in good + rare])
    u, n = np.unique(votes, axis=0, return_counts=True)
    start = np.where((u < 0).any(1), 0.1, 0.95)
    whole, _ = weak.fit_labels(u.astype(int), quality_model.PRIOR, correlated=False, start=start, counts=n)
    each, _ = weak.fit_labels(votes.astype(int), quality_model.PRIOR, correlated=False, start=np.where((votes < 0).any(1), 0.1, 0.95))
    assert np.allclose(model.labels.tables, whole.tables) and np.allclose(model.labels.tables, each.tables)
    s = [r.s for r in docs.orderBy("doc_id").select(quality_model.score(F.col("text"), model).alias("s")).collect()]
    assert min(s[:600]) >= 0.5 and max(s[600:]) < 0.5


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf)
        assert out.columns == docs.columns
        before, held = held, out
        if name == "near_duplicates":
            texts = {r.doc_id: r.text for r in before.collect()}
            want = brute({i: shingles(t) for i, t in texts.items()}, jaccard)
            assert {r.doc_id for r in held.collect()} == {i for i, (root, _) in want.items() if root == i}
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf).count() > 0.95 * docs.count()
    got = corpus_pipeline.run(spark, sf).collect()
    digests = {hashlib.sha256(r.text.encode()).hexdigest() for r in held.collect()}
    assert got and {r.decoded_sha256 for r in got} == digests and all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """One row stays of each document that repeats an id and text, and of each group among rows without an id."""
    text = lambda k, n=200: " ".join(f"w{k}-{i}" for i in range(n))
    rows = [(1, text(1)), (1, text(1)), (2, text(2)), (2, text(2)), (3, text(1) + " end"), (None, text(2) + " end"),
            (None, text(4)), (None, text(4)), (None, text(4) + " end"), (None, text(5)), (6, text(6)), (7, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted((i, t) for i, t in got if i) == [(1, text(1)), (2, text(2)), (6, text(6)), (7, ""), (8, "")]
    unnamed = [t for i, t in got if i is None]
    assert len(unnamed) == 2 and text(5) in unnamed and ({text(4), text(4) + " end"} & set(unnamed))


def test_pipeline_without_labels_drops_nothing(spark):
    docs = spark.createDataFrame([(i, f"an English text number {i}", None, "s", 3) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.identify_language(spark, docs, "").count() == 40
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0


def test_training_samples_are_bounded_when_ids_repeat(spark, monkeypatch):
    """One id over many rows, or many copies of a text, neither exceed the bound nor use up a language's places."""
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    monkeypatch.setattr(language, "STEPS", 1)
    seen = []
    monkeypatch.setattr(language, "train", lambda windows, labels, names: seen.append((windows, labels, names)))
    rows = [(0, f"one id, text {i}", "en") for i in range(2000)] + [(4 * i, "the same copy", "de") for i in range(500)]
    rows += [(i, f"ein Satz {i}", "de") for i in range(3000, 3400)] + [(i, f"un {i}", "fr") for i in range(5000, 5005)]
    language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    windows, labels, names = seen[0]
    assert names == ["de", "en", "fr"] and 3 <= (labels == 2).sum() <= 5
    texts = [bytes(w).rstrip(b"\0") for w in windows]
    assert len({t for t, y in zip(texts, labels) if y == 0}) == 20 == (labels == 0).sum()
    assert len({t for t, y in zip(texts, labels) if y == 1}) == 20 == (labels == 1).sum()

    bad = spark.createDataFrame([(0, f"vile words of text {i}") for i in range(300)] + [(i, f"kind {i}") for i in range(1, 40)], "doc_id long, text string")
    labels_ = spark.createDataFrame([(0, 1)] + [(i, 0) for i in range(1, 40)], "doc_id long, toxic int")
    assert toxicity.fit(bad, labels_) is not None


def plain_probabilities(model, window):
    """The network's forward pass by its definition, place by place."""
    def pooled(f):
        best = -1e30
        for at in range(language.WINDOW - max(language.WIDTHS) + 1):
            x = np.concatenate([model.embed[window[at + k]] for k in range(max(language.WIDTHS))])
            best = max(best, float(x @ model.filters[:, f]))
        return max(best + float(model.bias[f]), 0.0)

    z = np.array([pooled(f) for f in range(model.filters.shape[1])]) @ model.out + model.out_bias
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_language_network_against_its_definition():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (60, language.WINDOW)).astype(np.uint8)
    labels = np.arange(60) % 3
    windows[labels == 0, ::2] = 65
    windows[labels == 1, ::3] = 200
    steps, language.STEPS = language.STEPS, 40
    try:
        model = language.train(windows, labels, ["a", "b", "c"])
    finally:
        language.STEPS = steps
    # filters narrower than the widest look at their own bytes only
    for n, w in enumerate(language.WIDTHS):
        assert not model.filters[w * language.EMBED:, n * language.FILTERS:(n + 1) * language.FILTERS].any()
    got = language.probabilities(model, windows[:3])
    assert np.allclose(got, [plain_probabilities(model, w) for w in windows[:3]], atol=1e-4)
    assert (language.probabilities(model, windows).argmax(1) == labels).mean() > 0.8


def test_label_model_against_plain_em():
    """A few rounds of expectation-maximisation on independent voters, counted by hand, agree with the counted one."""
    rng = np.random.default_rng(6)
    y = rng.random(400) < 0.4
    right = [0.9, 0.8, 0.7, 0.95]
    votes = np.array([[0 if rng.random() < 0.3 else (1 if (t if rng.random() < a else not t) else -1) for a in right] for t in y])
    model, post = weak.fit_labels(votes, 0.4, correlated=False)
    assert ((post > 0.5) == y).mean() > 0.85
    # the posterior of each row is what its voters' tables say by Bayes' rule
    prior = model.prior
    for row, p in list(zip(votes, post))[:50]:
        odds = np.log(prior / (1 - prior)) + sum(np.log(model.tables[j, v + 1, 1] / model.tables[j, v + 1, 0]) for j, v in enumerate(row))
        assert abs(1 / (1 + np.exp(-odds)) - p) < 0.02


@pytest.mark.parametrize("d,threshold", [(8, 0.9), (64, 0.8), (300, 0.9)])
def test_tables_follow_from_dimension_and_threshold(d, threshold):
    """Pairs just at the threshold share a bucket, whatever the dimension."""
    rng = np.random.default_rng(d)
    a, b = rng.standard_normal((2, 1500, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = threshold * a + np.sqrt(1 - threshold ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    n = embedding_dedup.tables_needed(d, threshold)
    x, y = embedding_dedup.probes(a, n), embedding_dedup.probes(b, n)
    assert (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3)).mean() > 0.998
