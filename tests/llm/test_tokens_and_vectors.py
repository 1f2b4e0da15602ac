"""Packing, alignment and whitening against libraries, brute force and numpy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm import alignment, packing, subwords, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
BITS = list("abst \n\t \r\x1c\x85\xa0　0²½éñ中!?-_▁\x01") + [
    "  ", " the", " of", "'s", " 'll", "\n\n", "\U0001f389", "<|endoftext|>", "</s>", "<0x41>", "ation", "     "]


def texts(n: int, seed: int = 4) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "x" * 9000, "ab " * 20_000]


@pytest.fixture(scope="module")
def library():
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return Tokenizer.from_file(A), plain, sentencepiece.SentencePieceProcessor(model_file=B)


def test_ids_are_those_of_the_libraries(library):
    some = texts(3000)
    special, plain, pieces = library
    a, b = subwords.BytePairs(A, plain=False), subwords.Pieces(B)
    for t, want in zip(some, special.encode_batch(some, add_special_tokens=False)):
        assert a.encode(t).tolist() == want.ids
    a = subwords.BytePairs(A, plain=True)
    for t in filter(None, some):
        want = plain.encode(" " + t, add_special_tokens=False).ids
        cut = subwords.parts(t, 5)
        assert " ".join(cut) == t
        assert a.encode(" " + t).tolist() == want == [i for w in cut for i in a.encode(" " + w).tolist()]
        assert subwords.BLANK in t or sum(b.encode(cut), []) == pieces.encode(t)
    assert a.bytes[plain.encode(" x").ids[0]] == b" x"


def test_ids_of_every_code_point(library):
    a = subwords.BytePairs(A, plain=False)
    points = [*range(0, 0xD800), *range(0xE000, 0x33000), *range(0xE0000, 0xE0200), 0x10FFFF]
    some = ["a%ca1%c1 %c.%c\n%c" % (p, p, p, p, p) for p in points]
    for t, want in zip(some, library[0].encode_batch(some, add_special_tokens=False)):
        assert a.encode(t).tolist() == want.ids


# --- packing ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity,seed", [(1, 0), (2, 1), (7, 2), (40, 3), (40, 4), (300, 5), (300, 6)])
def test_plan_holds_the_histogram(capacity, seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(capacity + 1, np.int64)
    some = rng.integers(1, capacity + 1, 1 + capacity // 2)
    histogram[some] = rng.integers(1, 10 ** (1 + seed % 4), len(some))
    made = packing.plan(histogram, capacity)
    used = np.zeros_like(histogram)
    for runs, n in made:
        assert n > 0 and sum(a * m for a, m in runs) <= capacity
        for a, m in runs:
            used[a] += n * m
    assert (used == histogram).all()
    # never worse than twice what the tokens need, as any packing without two sequences that fit into one
    need = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    assert need <= sum(n for _, n in made) <= 2 * need + 1


def test_patterns_and_least_squares():
    ways = packing.patterns(np.array([1, 3, 4, 5, 8]), 8)
    assert sorted(map(tuple, ways.tolist())) == [(4, 3, 1), (4, 4, 0), (5, 3, 0), (8, 0, 0)]
    histogram = np.zeros(9, np.int64)
    histogram[[8, 5, 3, 4]] = [7, 10, 10, 6]
    wanted = packing.repeats(histogram, ways)
    fit = {tuple(w): x for w, x in zip(ways.tolist(), wanted)}
    assert abs(fit[8, 0, 0] - 7) < 0.1 and abs(fit[5, 3, 0] - 10) < 0.3 and abs(fit[4, 4, 0] - 3) < 0.3
    made, left = packing.rounded(histogram, ways, wanted)
    assert sum(n for _, n in made) == 20 and left.sum() == 0


def checked_packing(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= capacity
    return filled


def test_pack(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(None, "no id"), (None, "no id"), (3, "an id again"), (9001, None), (9002, ""), (9003, "long " * 9000), (9004, "<|endoftext|>")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = packing.pack(docs, A, carry=["ids"]).collect()
    filled = checked_packing(rows, 2048)
    want = Counter()
    for r in docs.collect():
        ids = library[0].encode(r.text or "", add_special_tokens=False).ids + [0]
        cut = [0] + list(range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048))
        want.update((r.doc_id, k, a, tuple(ids[a:z])) for k, (a, z) in enumerate(zip(cut, cut[1:])))
    assert want == Counter((r.key if "key" in r else r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows)
    assert all(r.length == len(r.ids) // 4 for r in rows)
    assert len(filled) <= -(-sum(r.length for r in rows) // 2048) + 1
    crc = packing.pack(docs, A, carry=[F.crc32("ids").alias("c")]).collect()
    assert Counter(r.c for r in crc) == Counter(zlib.crc32(r.ids) for r in rows)
    assert packing.pack(docs.limit(0), A).count() == 0


def test_pack_one_hot_length(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same").otherwise(F.repeat(F.lit("a b "), (F.col("id") % 50).cast("int"))).alias("text"))
    rows = packing.pack(docs, A, capacity=100, carry=[]).collect()
    filled = checked_packing(rows, 100)
    assert len(rows) == 30_000 and len(filled) <= -(-sum(r.length for r in rows) // 100) * 1.01


# --- alignment --------------------------------------------------------------------------------------------


def brute_alignment(some, plain, pieces):
    """Tokens, groups and links of each text, in plain Python."""
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    a_bytes = subwords.BytePairs(A, plain=True).bytes
    out = []
    for t in some:
        a = plain.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pieces.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            out.append([])
            continue
        ends = []
        for ids, table in ((a, a_bytes), (b, b_bytes)):
            ends.append(np.cumsum([len(table[i]) for i in ids]).tolist())
        cuts = sorted(set(ends[0]) & set(ends[1]))
        place = {e: k for k, e in enumerate(cuts)}
        own = [([], []) for _ in cuts]
        for side, (ids, at) in enumerate(zip((a, b), ends)):
            k = 0
            for i, e in zip(ids, at):
                own[k][side].append(i)
                k = place[e] + 1 if e in place else k
        out.append(own)
    return out


def check_alignment(rows, some, library):
    own = brute_alignment(some, library[1], library[2])
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in own]
    counts = Counter(p for pairs in links for p in set(pairs))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter(
        (k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(pairs),
         ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g),
         sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs))
        for k, (g, pairs) in enumerate(zip(own, links)))
    assert want == Counter((r.k, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in rows)


@pytest.mark.parametrize("heavy", [1 << 20, 50, 0])
def test_align(spark, library, heavy):
    some = [None, *texts(300), *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(some)], "k int, t string, codes string")
    check_alignment(alignment.align(docs.repartition(3), A, B, key="k", text="t", heavy=heavy).collect(), some, library)


def test_align_parts_and_large_groups(spark, library, monkeypatch):
    both = alignment.Aligner(A, B)
    long = ["the cat  sat\n\non a mat " * 300, "aa中 " * 500 + "▁", "x" * 3000, "中\U0001f389" * 500]
    whole = list(both.rows(long))
    monkeypatch.setattr(subwords, "BLOCK", 64)
    monkeypatch.setattr(alignment, "BLOCK", 64)
    monkeypatch.setattr(alignment, "PLAIN", 2)
    assert list(both.rows(long)) == whole
    assert whole[1][:4] == (0, 0, 0, 0)


def test_align_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).count() == 0
    twice = spark.createDataFrame([(None, "a word"), (None, "a word"), (1, None)], "doc_id long, text string")
    rows = sorted(alignment.align(twice, A, B).collect(), key=str)
    assert [r.count_sum for r in rows if r.n_a] == [4, 4] and sum(r.n_a == 0 for r in rows) == 1


def test_pointer_jumping():
    # tokens of 3 bytes against tokens of 2 bytes meet every 6 bytes
    a, b, n = alignment.groups(np.arange(3, 31, 3), np.arange(2, 31, 2))
    assert n == 5 and a.tolist() == np.repeat(range(5), 2).tolist() and b.tolist() == np.repeat(range(5), 3).tolist()
    # one chain over all tokens
    a, b, n = alignment.groups(np.array([*range(2, 2001, 2), 2001]), np.array([*range(1, 2001, 2), 2001]))
    assert n == 1 and not a.any() and not b.any()


# --- whitening --------------------------------------------------------------------------------------------


def check_whitening(spark, vectors, components=16):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, deviation int")
    rows, fit = whitening.whiten(df, components=components)
    good = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}), np.int64)
    n, s = len(x), x.sum(0)
    z = (n * x - s) / n
    cov = z.T @ z / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = int((values[:components] > 1e-9 * values[0]).sum())
    assert fit.n == n and fit.sums.tolist() == s.tolist() and len(fit.values) == k
    assert np.allclose(fit.values, values[:k], rtol=1e-11) and abs(fit.trace / np.trace(cov) - 1) < 1e-12 and fit.identity_error < 1e-10
    got = {}
    for r in rows.collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r.whitened)
    assert sum(map(len, got.values())) == len(good)
    for i, v in good:
        want = (n * np.array(v) - s) / n @ basis[:, :k] / np.sqrt(values[:k])
        sign = np.sign((fit.vectors * basis[:, :k]).sum(0))
        mine = np.array(got[i, sum((n * a - b) ** 2 for a, b in zip(v, s.tolist()))])
        assert np.abs(mine - want * sign).min(0).max() < 1e-7
    return fit


def test_whiten_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening(spark, [(r.vec_id, [float(c) for c in r.embedding]) for r in rows])


def test_whiten_edge_cases(spark):
    rng = np.random.default_rng(3)
    some = [(i, list(map(float, v))) for i, v in enumerate(rng.standard_normal((60, 5)) * [9, 5, 3, 2, 1])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [])]
    check_whitening(spark, some + some[:20] + [(None, [1.0] * 5)] + bad)
    # a dimension without variance, and fewer vectors than dimensions
    check_whitening(spark, [(i, [*v, 7.0]) for i, v in some])
    check_whitening(spark, some[:3])
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    equal, fit = whitening.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0])]))
    assert sorted((r.vec_id, r.deviation, r.whitened) for r in equal.collect()) == [(1, 0, []), (2, 0, [])] and fit.n == 1
    none, fit = whitening.whiten(df([]))
    assert none.collect() == [] and fit is None


def test_large_deviations_are_exact_or_null():
    fit = whitening.Whitening(3, np.array([3_000_001, 3 * 10**12 + 1]), np.zeros(0), np.zeros((2, 0)), 0.0, 0.0)
    x = np.array([[1_000_000, 10**12 + 10**8], [1_000_005, 10**12], [0, 10**12 + 10**10]])
    assert fit.deviations(x) == [1 + (3 * 10**8 - 1) ** 2, 14 * 14 + 1, None]


def test_eigenpairs_of_close_and_equal_values():
    rng = np.random.default_rng(8)
    basis, _ = np.linalg.qr(rng.standard_normal((80, 80)))
    values = np.concatenate([[5, 5, 4, 3.999], np.linspace(3, 0.001, 76)])
    matrix = basis * values @ basis.T
    got, vectors = whitening.eigenpairs(lambda q: matrix @ q, 80, 16)
    assert np.allclose(got, values[:16], rtol=1e-12)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12


def test_digests_of_groups(spark):
    from docketry.llm.queries import op12_alignment

    for r in op12_alignment(spark, SF).select("n_a", "groups_sha256").collect():
        assert (r.groups_sha256 == "") == (r.n_a == 0) and len(r.groups_sha256) in (0, 64)
