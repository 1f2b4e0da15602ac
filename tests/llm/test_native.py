"""Line dedup, mixing, quality rules and chat formatting against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.llm import chat, line_dedup, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, pos int, h1 long, key string, size int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", 1, 2, "k", 3) for i, t, s in rows], SCHEMA)


def edge_rows():
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma,", "delta.", "eps", "|", "!!", "ünï", "##", "x"]
    rows = [(None, "no id", "a"), (1, None, "a"), (2, "", None), (3, " \n\t\n", "b"), (4, "one", None), (4, "one", None)]
    for i in range(5, 60):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        lines.insert(rng.randint(0, len(lines)), rng.choice(["  shared line ", "shared line", "other shared", "rare"]))
        rows.append((i, "\n".join(lines), rng.choice(["s%d" % k for k in range(12)] + [None])))
    rows.append((99, "\n".join(["shared line"] + ["w%d x y z." % (k % 700) for k in range(3000)]), "s1"))
    return rows


def test_line_dedup(spark):
    rows = edge_rows()
    sites, keeper = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(" \t\n\x0b\x0c\r")
            if line:
                sites.setdefault(line, set()).add(s)
                if i is not None:
                    keeper[line] = min(i, keeper.get(line, i))
    wide = {x for x, y in sites.items() if len(y) >= 6}
    assert "shared line" in wide
    got = line_dedup.clean_lines(docs_of(spark, rows), min_sites=6, short_sites=6)
    assert got.columns == ["doc_id", "text", "source", "row", "pos", "h1", "key", "size", "n_lines", "n_removed", "emptied"]
    want = Counter()
    for i, t, s in rows:
        lines = (t or "").split("\n")
        strip = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
        gone = [x in wide and keeper.get(x) != i for x in strip]
        text = None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        n = sum(map(bool, strip))
        want[(i, text, s, n, sum(gone), sum(gone) > 0 and sum(gone) == n)] += 1
    assert Counter((r.doc_id, r.text, r.source, r.n_lines, r.n_removed, r.emptied) for r in got.collect()) == want
    assert line_dedup.clean_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_line_dedup_counts_near_the_threshold(spark):
    rows = [(i, "seven\nsix" if i < 6 else "seven", "s%d" % i) for i in range(7)]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(docs_of(spark, rows), min_sites=7, short_sites=7).collect()}
    assert got == {0: "seven\nsix"} | {i: "six" for i in range(1, 6)} | {6: ""}


def test_line_dedup_default_catches_few_sites(spark):
    """A line on five sites goes from all but its first document, one on four stays."""
    rows = [(i, f"own {i}\nReleased under a license." + ("\nfour" if i < 4 else ""), "s%d" % i) for i in range(5)]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(docs_of(spark, rows)).collect()}
    assert got == {0: rows[0][1]} | {i: f"own {i}" + ("\nfour" if i < 4 else "") for i in range(1, 5)}


def test_line_dedup_keeps_short_lines_that_chance_repeats(spark):
    """Lines of up to three words need ten sites, longer ones five."""
    rows = [(i, f"Page {i} of all\nand then.\nAll rights reserved.\nMade with the press of words.", "s%d" % (i % 9)) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(docs_of(spark, rows)).collect()}
    assert got == {i: t if i == 0 else t.rpartition("\n")[0] for i, t, _ in rows}
    rows = [(i, t, "s%d" % (i % 10)) for i, t, _ in rows]
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(docs_of(spark, rows)).collect()}
    assert got == {i: t if i == 0 else t.partition("\n")[0] for i, t, _ in rows}


@pytest.mark.parametrize("key", [None, 5])
def test_mixing_without_ids_of_their_own(spark, key):
    """A source whose rows have no id, or one and the same, still comes near its target."""
    rows = [(key, f"{'w ' * (100 + i % 7)}n{i}", "a") for i in range(200)] + [(1000 + i, "w " * 90, "b") for i in range(300)]
    got = [r for r in mixing.mix(docs_of(spark, rows)).collect() if r.source == "a"]
    assert abs(sum(r.copies * r["size"] for r in got) - got[0].target) <= 110
    again = mixing.mixed(docs_of(spark, rows)).filter("source = 'a'").collect()
    assert sum(len(r.text.split()) for r in again) == sum(r.copies * r["size"] for r in got)


def reference_mix(rows, weights=(5, 2, 1), most=3):
    sizes = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(most * total[s] for s in full)
        left = sum(weight[s] for s in order if s not in full)
        target = {s: most * total[s] if s in full else rest / left * weight[s] for s in order}
        more = {s for s in order if target[s] > most * total[s]}
        if not more - full:
            return sizes, total, target
        full |= more


def test_mixing(spark):
    rows = edge_rows() + [(200 + i, "w " * (i % 40), "big") for i in range(400)]
    sizes, total, target = reference_mix(rows)
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert Counter((r.key, r.source, r["size"]) for r in got) == Counter(sizes)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mixed(docs_of(spark, rows))
    assert again.columns == docs_of(spark, rows).columns
    assert Counter(r.doc_id for r in again.collect()) == Counter({k: n for k, n in sum((Counter({r.key: r.copies}) for r in got), Counter()).items() if n})
    assert mixing.mix(docs_of(spark, rows).limit(0)).count() == 0
    assert all(r["size"] == 0 for r in mixing.mix(docs_of(spark, [(1, None, None), (2, "", "a")])).collect())


def test_quality_rules(spark):
    rows = edge_rows()
    got = {(r.doc_id, r.text): r for r in quality_rules.judge(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        r, t_ = got[(i, t)], t or ""
        w = WORD.findall(t_)
        lines = [x for x in t_.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t_), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(docs_of(spark, rows).limit(0)).count() == 0


def test_quality_lines(spark):
    prose = "\n".join(" ".join("w%d%s" % (k, c) for c in "abcdefghij") + " end." for k in range(12))
    menu = "\n".join(["Home", "Sign up | Log in | Help", "Next page"] * 30)
    rows = [(1, prose, "a"), (2, menu + "\n" + prose[:300], "a"), (3, prose + "\nAll rights reserved.", "a")]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, rows)).collect()}
    assert got[1].kept and got[1].cleaned == prose
    assert not got[2].kept and "Home" not in got[2].cleaned
    assert got[3].kept and got[3].cleaned == prose


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(5)
    bits = ["<|im_start|>", "<|im_end|>", "\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "$1", "é", "a", " ", "s>", "\\s>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(800)] + ["", "x" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_layouts(spark):
    schema = ("id int, layout_hint string, system string, prompt string, response string, instruction string, input string, output string, "
              "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>")
    odd = "</s>[INST] ok [/INST]"
    rows = [
        (1, "x", None, odd, "b", None, None, None, None, None),
        (2, "x", "sys", None, None, "do", "in", "out", None, None),
        (3, "x", None, None, None, None, None, None, [("user", odd), ("assistant", odd), ("tool\n", None)], None),
        (4, "x", None, None, None, None, None, None, None, [("human", "hi"), ("gpt", "yo"), (None, "n")]),
        (5, "x", None, "only a prompt", None, None, None, None, None, None),
        (6, "x", None, None, None, None, None, None, [], None),
    ]
    fields = ("system", "prompt", "response", "instruction", "input", "output", "messages", "conversations")
    out = chat.formatted(chat.canonical(spark.createDataFrame(rows, schema), fields))
    out = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.id: r for r in out.collect()}
    turns = lambda r: [tuple(t) for t in r.turns]
    assert turns(got[1]) == [("user", odd), ("assistant", "b")] and got[1].layout == "completion"
    assert turns(got[2]) == [("system", "sys"), ("user", "do\n\nin"), ("assistant", "out")]
    assert turns(got[3]) == [("user", odd), ("assistant", odd), ("tool\n", "")]
    assert turns(got[4]) == [("user", "hi"), ("assistant", "yo"), ("", "n")]
    assert got[5].layout is None and got[5].formatted is None and got[6].layout is None
    assert [got[i].masked for i in (1, 2, 3, 4)] == ["b", "out", odd, "yo"]
    for i in (1, 2, 3, 4):
        assert [tuple(t) for t in got[i].back] == turns(got[i])
    assert hashlib.sha256(got[3].formatted.encode()).hexdigest() and got[3].formatted.count("<|im_start|>") == 3


def test_chat_keeps_columns_of_its_own_names(spark):
    turns = [("user", "a"), ("assistant", "b")]
    rows = spark.createDataFrame([(7, turns, "formatted before", 1, 2)], "parts int, turns array<struct<role:string,text:string>>, formatted string, row int, loss_spans int")
    out = chat.formatted(rows)
    assert sorted(out.columns) == ["formatted", "loss_spans", "parts", "row", "turns"]
    r = out.first()
    assert (r.parts, r.row) == (7, 1) and r.formatted.startswith("<|im_start|>user") and len(r.loss_spans) == 1


def test_hot_join_is_a_join(spark, monkeypatch):
    """Keys of any weight meet as in a plain join, and one that holds most rows is dealt over pieces."""
    from docketry.llm import common

    monkeypatch.setattr(common, "PIECES", 16)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).alias("k"))
    counts = common.stored(rows.filter("k <> 5").groupBy("k").agg(F.count("*").alias("n")), "counts")
    want = sorted(map(tuple, rows.join(counts, "k").select("k", "id", "n").collect()))
    got = common.hot_join(rows, counts, ["k"], ["id"])
    assert sorted(map(tuple, got.select("k", "id", "n").collect())) == want and len(want) > 2900
    some = counts.filter("k % 2 = 1").select("k")
    semi = common.hot_join(rows, some, ["k"], ["id"], "left_semi", counts)
    assert sorted(r.id for r in semi.collect()) == sorted(i for k, i, _ in want if k % 2)
    assert common.hot_join(rows.limit(0), counts.limit(0), ["k"], ["id"]).count() == 0


def test_running_sums_over_blocks(spark):
    for n in (0, 1, 3, 4, 5, 16, 17, 200):
        row = spark.range(1).select(F.array(*[F.lit(7 * i % 11) for i in range(n)]).cast("array<int>").alias("a"))
        want = [sum(7 * k % 11 for k in range(i)) for i in range(n)]
        assert list(row.select(chat.running_sums(F.col("a"), 4).alias("s")).first().s) == want


def test_chat_of_many_turns(spark):
    turns = [("user" if i % 2 else "assistant", f"t{i} ü" * (i % 4)) for i in range(700)]
    df = spark.createDataFrame([(turns,), (None,), ([],)], "turns array<struct<role:string,text:string>>")
    r = chat.formatted(df).withColumn("m", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert r[0].m == "".join(t for role, t in turns if role == "assistant") and len(r[0].loss_spans) == 350
    assert r[1].formatted is None and r[1].loss_spans is None and r[2].formatted == "" and r[2].loss_spans == []
