"""Template matching, scoring and selection of document types.

The catalogue is a fixed, 31-row table, so it enters plans as literals inside the row: no cross join.
One pass over a document yields its regex hits, its detector results and its similar lines; only
the first similar line per pattern leaves the scan stage, and they meet again per document in one
aggregation whose partial step runs before the shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions.detectors import (
    detect_account11,
    detect_digit12,
    detect_pan,
    detect_voter,
    id_components,
    id_numbers,
    id_side,
    required_number,
)
from docketry.functions.patterns import WORD, may_hold, unicode_regex
from docketry.functions.similarity import first_similar, token_set, with_similarity
from docketry.functions.text import has_text, match_lines, norm_space, plain_pattern

_FULL_TEXT = 2**31 - 1
_DOCUMENT = -1
_INFO = "array<struct<type_ord:int,doc_type:string,pattern_ord:int,pattern:string>>"


def catalogue(spark, templates=C.TEMPLATES) -> DataFrame:
    """The template table: (type_ord, doc_type, pattern_ord, pattern, plain)."""
    df = spark.createDataFrame(
        C.pattern_rows(templates), "type_ord int, doc_type string, pattern_ord int, pattern string"
    )
    return df.withColumn("plain", plain_pattern(F.col("pattern")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern_info(templates=C.TEMPLATES) -> Column:
    """The catalogue as one literal array."""
    rows = [
        f"struct({t} AS type_ord, {_sql_text(d)} AS doc_type, {n} AS pattern_ord, {_sql_text(p)} AS pattern)"
        for t, d, n, p in C.pattern_rows(templates)
    ]
    return F.expr(f"array({', '.join(rows)})")


def plain_words(pattern: str) -> str:
    """The readable words of one catalogue pattern (same rule as ``plain_pattern``)."""
    return " ".join(re.sub(r"[^A-Za-z0-9]+", " ", pattern.replace(r"\b", " ")).split())


def _pattern_tokens() -> list[list[str]]:
    return [sorted(set(plain_words(p).lower().split())) for _, _, _, p in C.pattern_rows()]


def regex_matches(text: Column, templates=C.TEMPLATES) -> Column:
    """Matched text per pattern, in catalogue order; null where the pattern does not occur.

    A plain phrase is looked up in the lower-cased text first, so the regex engine runs only on hits.
    """
    out = []
    for _, _, _, p in C.pattern_rows(templates):
        hit = F.nullif(F.regexp_extract(text, unicode_regex(p, True), 0), F.lit(""))
        plain = not re.search(r"[\\\[\](){}.*+?^$|]", p)
        out.append(F.when(may_hold(text, p), hit) if plain else hit)
    return F.array(*out)


def _cleaned(line: Column) -> Column:
    """Lower-case words of a line, one blank between two."""
    return F.lower(F.regexp_replace(line, f"[^{WORD}]+", " "))


def _similar(docs: DataFrame, threshold: float, todo: Column, about: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, lines, text, columns of ``todo``) -> (doc_id, line_no, line, whole, pattern_ord, similarity), first line per pattern of a row.

    A document stays one row until its hits are known: its lines and, behind them, its whole text go to the task's
    function together, and only what is similar makes rows.  The white-space-normalised whole text is in ``whole``, and only
    the first of its patterns carries it.  With ``about`` a row with ``line_no`` and ``pattern_ord`` = -1 stands for the
    document itself and carries those columns; each is a column of its own, so that one nobody reads is not computed.
    """
    lines = F.coalesce("lines", F.array().cast("array<string>"))
    others = [c for c in docs.columns if c not in ("doc_id", "text", "lines")]
    df = docs.select("doc_id", "text", lines.alias("lines"), norm_space(F.col("text")).alias("whole"), *others)
    # a generator's input is computed once; plain columns would be inlined into every later use
    df = df.select("doc_id", "text", F.explode(F.array(F.struct("lines", "whole", *others))).alias("o")).select("doc_id", "text", "o.*")
    pieces = F.concat(F.transform("lines", _cleaned), F.array(_cleaned(F.col("whole"))))
    df = df.select(
        "doc_id", "lines", "whole", F.size("lines").alias("last"), *about,
        first_similar(pieces, todo, _pattern_tokens(), threshold).alias("found_in"))
    first_whole = F.array_position(F.transform("found_in", lambda h: h["piece"] == F.col("last")), F.lit(True)) - 1

    def row(h: Column, i: Column) -> Column:
        behind = h["piece"] == F.col("last")
        return F.struct(
            F.when(behind, _FULL_TEXT).otherwise(h["piece"]).alias("line_no"), F.get("lines", h["piece"]).alias("line"),
            F.when(i == first_whole, F.col("whole")).alias("whole"), h["pattern_ord"].alias("pattern_ord"), h["similarity"].alias("similarity"))

    rows = F.transform("found_in", row)
    if not about:
        return df.select("doc_id", F.explode(rows).alias("h")).select("doc_id", "h.*")
    nothing = F.lit(None)
    names = [c for c in df.columns if c not in ("doc_id", "lines", "whole", "last", "found_in")]
    itself = F.struct(
        F.lit(_DOCUMENT).alias("line_no"), nothing.cast("string").alias("line"), nothing.cast("string").alias("whole"),
        F.lit(_DOCUMENT).alias("pattern_ord"), nothing.cast("double").alias("similarity"))
    df = df.select("doc_id", *names, F.explode(F.concat(F.array(itself), rows)).alias("h"))
    # the document's own results ride on its first row only
    return df.select("doc_id", "h.*", *[F.when(F.col("h.line_no") == _DOCUMENT, F.col(c)).alias(c) for c in names])


def fuzzy_hits(docs: DataFrame, threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    """First line at or above the threshold for each pattern listed in ``todo``, whole text last.

    Input: doc_id, lines (array), text, todo (array of pattern ordinals).  Lines are scanned in order;
    the white-space-normalised text stands behind them, so it is used only when no line is similar.
    """
    rows = _similar(docs, threshold, F.col("todo"))
    hits = rows.groupBy("doc_id", "pattern_ord").agg(_first_line().alias("hit"), F.first("whole", ignorenulls=True).alias("whole"))
    per = hits.groupBy("doc_id").agg(F.collect_list(F.struct("pattern_ord", "hit")).alias("hits"), F.first("whole", ignorenulls=True).alias("whole"))
    hit = F.struct(F.col("h.hit.line_no"), F.col("h.hit.similarity"), F.coalesce("h.hit.line", "whole").alias("line"))
    return per.select("doc_id", "whole", F.explode("hits").alias("h")).select("doc_id", "h.pattern_ord", hit.alias("hit"))


def _first_line() -> Column:
    return F.min_by(F.struct("line_no", "similarity", "line"), "line_no")


def _every_pattern() -> Column:
    return F.sequence(F.lit(0), F.lit(len(C.pattern_rows()) - 1))


def pattern_hits(docs: DataFrame, threshold: float = C.FUZZY_THRESHOLD, split_short: bool = False) -> DataFrame:
    """Regex first, fuzzy for the rest: (doc_id, type_ord, doc_type, pattern_ord, pattern, method, match, score)."""
    hits = classify(docs, threshold, split_short).select("doc_id", F.explode("matched").alias("m"))
    return hits.select("doc_id", "m.*").filter("method <> 'detector'")


def _unmatched(found: Column) -> Column:
    return F.filter(F.transform(found, lambda m, i: F.when(m.isNull(), i)), lambda i: i.isNotNull())


def _with_lines(docs: DataFrame, split_short: bool) -> DataFrame:
    if "lines" in docs.columns:
        return docs
    return docs.withColumn("lines", match_lines(F.col("text"), split_short))


def _type_scores(matched_ords: Column, numbers: Column, templates, bonuses) -> Column:
    """[(type_ord, doc_type, score, checks_pass, acceptable)] in catalogue order."""
    rows, out = C.pattern_rows(templates), []
    for type_ord, doc_type in enumerate(templates):
        ords = ", ".join(str(n) for t, _, n, _ in rows if t == type_ord)
        total = F.size(F.array_intersect(matched_ords, F.expr(f"array({ords})")))
        if doc_type in bonuses:
            detector, _, points = bonuses[doc_type]
            total = total + F.when(numbers[detector]["found"], F.lit(points)).otherwise(F.lit(0))
        min_score, check = C.RULES[doc_type]
        passed = numbers[check]["found"] if check else F.lit(True)
        out.append(
            F.struct(
                F.lit(type_ord).alias("type_ord"), F.lit(doc_type).alias("doc_type"), total.alias("score"),
                passed.alias("checks_pass"), ((total >= min_score) & passed).alias("acceptable"),
            )
        )
    return F.array(*out)


def _matched_ords(found: Column) -> Column:
    return F.filter(F.transform(found, lambda m, i: F.when(m.isNotNull(), i)), lambda i: i.isNotNull())


def score_v1(docs: DataFrame) -> DataFrame:
    """Regex-only scores of the first catalogue: (doc_id, type_ord, doc_type, score), all types present."""
    text = F.col("text")
    numbers = F.struct(
        detect_pan(text).alias("pan"), detect_digit12(text).alias("digit12"),
        detect_voter(text, "v1").alias("voter"), detect_account11(text).alias("account11"),
    )
    ords = _matched_ords(regex_matches(text, C.TEMPLATES_V1))
    scored = docs.select("doc_id", ords.alias("ords"), numbers.alias("numbers"))
    scores = _type_scores(F.col("ords"), F.col("numbers"), C.TEMPLATES_V1, C.BONUSES_V1)
    return scored.select("doc_id", F.explode(scores).alias("s")).select("doc_id", "s.type_ord", "s.doc_type", "s.score")


def select_argmax(scores: DataFrame, rules: dict[str, tuple[int, str | None]] = C.RULES_V1) -> DataFrame:
    """Highest score, earliest type on ties; UNKNOWN below the type's minimum score, which is 1 for a type without a rule."""
    top = F.max(F.struct(F.col("score"), (-F.col("type_ord")).alias("o"), F.col("doc_type")))
    best = scores.groupBy("doc_id").agg(top.alias("t")).select("doc_id", "t.doc_type", "t.score")
    need = F.lit(1)
    for doc_type, (min_score, _) in rules.items():
        need = F.when(F.col("doc_type") == doc_type, F.lit(min_score)).otherwise(need)
    return best.select(
        "doc_id", F.when(F.col("score") >= need, F.col("doc_type")).otherwise(C.UNKNOWN).alias("best_type"), "score"
    )


def _select_eligible(scores: Column) -> Column:
    """Highest score among acceptable types, earliest on ties, else UNKNOWN; within the row."""
    ok = F.filter(scores, lambda s: s["acceptable"])
    ranked = F.transform(
        ok, lambda s: F.struct(s["score"].alias("score"), (-s["type_ord"]).alias("o"), s["doc_type"].alias("doc_type"))
    )
    return F.coalesce(F.array_max(ranked)["doc_type"], F.lit(C.UNKNOWN))


def classify_regex(docs: DataFrame) -> DataFrame:
    """Types from regex patterns and detectors only: a single scan without any shuffle."""
    text = F.col("text")
    found = docs.select("doc_id", _matched_ords(regex_matches(text)).alias("ords"), id_numbers(text).alias("numbers"))
    scores = _type_scores(F.col("ords"), F.col("numbers"), C.TEMPLATES, C.BONUSES)
    return found.select("doc_id", "numbers", scores.alias("scores")).select(
        "doc_id", "numbers", "scores", _select_eligible(F.col("scores")).alias("best_type")
    )


_OWN = ("found", "numbers", "components", "whole")
_ENTRY = "struct<type_ord:int,pattern_ord:int,doc_type:string,pattern:string,match:string,method:string,score:int>"


def classify(docs: DataFrame, threshold: float = C.FUZZY_THRESHOLD, split_short: bool = False) -> DataFrame:
    """One row per document: numbers, scores per type, matched patterns, best type, card side.

    The text is read once.  Each document becomes one row for itself plus one per pattern that a line or the whole text
    resembles, and all of them meet in an aggregation by document.
    """
    docs = _with_lines(docs, split_short)
    docs = docs.select("doc_id", "text", "lines", regex_matches(F.col("text")).alias("found"))
    text = F.col("text")
    about = (F.col("found"), id_numbers(text).alias("numbers"), id_components(text).alias("components"))
    rows = _similar(docs, threshold, _unmatched(F.col("found")), about)
    hits = rows.groupBy("doc_id", "pattern_ord").agg(
        _first_line().alias("hit"), *[F.first(c, ignorenulls=True).alias(c) for c in _OWN]
    )
    # at most one row per catalogue pattern is left of each document
    near = F.when(F.col("pattern_ord") >= 0, F.struct("pattern_ord", "hit"))
    df = hits.groupBy("doc_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in _OWN], F.collect_list(near).alias("fuzzy")
    )
    ords = F.concat(_matched_ords(F.col("found")), F.transform("fuzzy", lambda f: f["pattern_ord"]))
    df = df.withColumn("ords", ords)
    df = df.withColumn("scores", _type_scores(F.col("ords"), F.col("numbers"), C.TEMPLATES, C.BONUSES))
    df = df.withColumn("best_type", _select_eligible(F.col("scores")))
    return df.select(
        "doc_id", "best_type", "scores", _matched(F.col("found"), F.col("fuzzy"), F.col("numbers"), F.col("whole")).alias("matched"),
        "numbers", required_number(F.col("numbers"), F.col("best_type")).alias("required"),
        "components", id_side(F.col("components")).alias("side"),
    )


def _matched(found: Column, fuzzy: Column, numbers: Column, whole: Column) -> Column:
    """Matched patterns in catalogue order, each type's detector bonus behind its patterns."""
    info = _pattern_info()

    def row(p: Column, match: Column, method: str, score: Column) -> Column:
        return F.struct(
            p["type_ord"].alias("type_ord"), p["pattern_ord"].alias("pattern_ord"), p["doc_type"].alias("doc_type"),
            p["pattern"].alias("pattern"), match.alias("match"), F.lit(method).alias("method"), score.alias("score"),
        ).cast(_ENTRY)

    none = F.lit(None).cast("int")
    regex = F.transform(found, lambda m, i: F.when(m.isNotNull(), row(F.get(info, i), m, "regex", none)))
    near = F.transform(
        fuzzy,
        lambda f: row(F.get(info, f["pattern_ord"]), F.coalesce(f["hit"]["line"], whole), "fuzzy", F.floor(f["hit"]["similarity"]).cast("int")),
    )
    bonus = []
    for type_ord, doc_type in enumerate(C.TEMPLATES):
        if doc_type in C.BONUSES:
            detector, label, _ = C.BONUSES[doc_type]
            p = F.struct(
                F.lit(type_ord).alias("type_ord"), F.lit(_FULL_TEXT).alias("pattern_ord"),
                F.lit(doc_type).alias("doc_type"), F.lit(label).alias("pattern"),
            )
            hit = numbers[detector]
            bonus.append(F.when(hit["found"], row(p, hit["normalized"], "detector", none)))
    return F.array_sort(F.filter(F.concat(regex, near, F.array(*bonus)), lambda m: m.isNotNull()))


def score_v2(docs: DataFrame, threshold: float = C.FUZZY_THRESHOLD) -> DataFrame:
    """(doc_id, type_ord, doc_type, score, checks_pass, acceptable) for every document and type."""
    return classify(docs, threshold).select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*")


def select_eligible(scores: DataFrame) -> DataFrame:
    """Table form of the final choice: best acceptable type per document, else UNKNOWN."""
    rank = F.struct(F.col("score"), (-F.col("type_ord")).alias("o"), F.col("doc_type"))
    best = scores.groupBy("doc_id").agg(F.max(F.when(F.col("acceptable"), rank)).alias("t"))
    return best.select("doc_id", F.coalesce("t.doc_type", F.lit(C.UNKNOWN)).alias("best_type"))


def type_distribution(classified: DataFrame, source: str) -> DataFrame:
    """Documents, unknown rate and mean best score per source and type, with subtotals."""
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    df = classified.select(source, "best_type", top.alias("top_score"))
    return df.rollup(source, "best_type").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("best_type") == C.UNKNOWN).alias("n_unknown"),
        F.avg("top_score").alias("mean_score"),
        F.grouping_id().cast("int").alias("level"),
    )


def relevant_lines(
    docs: DataFrame, matched_plains: DataFrame, threshold: float = C.FUZZY_THRESHOLD, fallback: int = 6
) -> DataFrame:
    """Lines that carry a matched phrase or resemble one; else the first ``fallback`` lines.

    ``docs``: doc_id, lines (parsed lines in order).  ``matched_plains``: doc_id, plains (at most one
    lower-case phrase per catalogue pattern).  Output: (doc_id, line_no, line), each text once.
    """
    df = docs.join(matched_plains, "doc_id", "left")
    df = df.select(
        "doc_id", F.coalesce("plains", F.array().cast("array<string>")).alias("plains"),
        F.posexplode("lines").alias("line_no", "line"),
    )
    df = df.withColumn("line", F.trim("line"))
    low = F.lower("line")
    df = df.withColumn("direct", F.exists("plains", lambda p: F.contains(low, p)))
    # only lines without the phrase itself need a similarity, and only against this document's phrases
    rest = df.filter((F.col("line") != "") & ~F.col("direct")).select("doc_id", "line_no", "line", F.explode("plains").alias("p"))
    rest = rest.select("doc_id", "line_no", "line", token_set(F.col("p")).alias("a"), token_set(F.lower("line")).alias("b"))
    near = with_similarity(rest, "a", "b", "similarity", threshold).select("doc_id", "line_no", "line")
    plain = df.filter((F.col("line") != "") & (F.col("direct") | (F.col("line_no") < fallback)))
    rows = plain.select("doc_id", "line_no", "line", "direct").unionByName(near.withColumn("direct", F.lit(True)))
    # first position of each distinct line, separately for matches and for the fallback
    rows = rows.groupBy("doc_id", "line").agg(
        F.min(F.when(F.col("direct"), F.col("line_no"))).alias("hit_no"), F.min("line_no").alias("any_no")
    )
    picked = rows.join(
        rows.filter("hit_no IS NOT NULL").select("doc_id").distinct().withColumn("any_hit", F.lit(True)), "doc_id", "left"
    )
    line_no = F.when(F.col("any_hit"), F.col("hit_no")).otherwise(F.col("any_no"))
    return picked.select("doc_id", line_no.alias("line_no"), "line").filter("line_no IS NOT NULL")


def phrase_ords(low_text: Column) -> Column:
    """Catalogue patterns whose readable words occur verbatim in a lower-cased text."""
    hits = [
        F.when(F.contains(low_text, F.lit(plain_words(p).lower())), F.lit(n)) for _, _, n, p in C.pattern_rows()
    ]
    return F.filter(F.array(*hits), lambda n: n.isNotNull())


def matched_plains(classified: DataFrame) -> DataFrame:
    """Distinct lower-case phrases of what matched for each document's best-scoring type, a detector's by its own phrase.

    The best-scoring type is the first with the highest score, accepted or not.  Output: (doc_id, plains).
    """
    plains = F.expr("array(" + ", ".join(_sql_text(plain_words(p).lower()) for _, _, _, p in C.pattern_rows()) + ")")
    phrases = F.create_map(*[F.lit(x) for pair in C.DETECTOR_PHRASES.items() for x in pair])
    ranked = F.transform("scores", lambda s: F.struct(s["score"].alias("score"), (-s["type_ord"]).alias("o")))
    best = -F.array_max(ranked)["o"]
    return classified.withColumn("_best", best).select(
        "doc_id", F.array_distinct(F.transform(
            F.filter("matched", lambda m: m["type_ord"] == F.col("_best")),
            lambda m: F.when(m["method"] == "detector", F.element_at(phrases, m["pattern"])).otherwise(F.get(plains, m["pattern_ord"])),
        )).alias("plains")
    )


def pdf_rollup(children: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Documents found inside one PDF -> one row per PDF, with its children in order.

    ``children``: parent, child_no, best_type.  ``parents`` (parent) adds the PDFs in which nothing was found, as ERROR.
    A PDF's children are kept in its row; they are as many as documents on its pages.
    """
    rows = children if parents is None else parents.select("parent").distinct().join(children, "parent", "left")
    child = F.when(F.col("best_type").isNotNull(), F.struct("child_no", "best_type"))
    return rows.groupBy("parent").agg(
        F.count("best_type").alias("n_children"),
        F.count_if(F.col("best_type") != C.UNKNOWN).alias("n_known"),
        F.when(F.count("best_type") > 0, F.lit("PDF_CONTAINS_DOCUMENTS")).otherwise("ERROR").alias("document_type"),
        F.array_sort(F.collect_list(child)).alias("children"),
    )


def pdf_results(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent, child_no, document_type): a result for each child, and one for a PDF without any."""
    rows = parents.select("parent").distinct().join(children, "parent", "left")
    return rows.select("parent", "child_no", F.coalesce("best_type", F.lit("ERROR")).alias("document_type"))


def text_filter(lines: DataFrame, column: str = "text") -> DataFrame:
    """Keep lines that hold a letter or digit."""
    return lines.filter(has_text(F.col(column)))
