"""Comparison queries for cleaning, detectors, fuzzy matching and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlbase import (
    FILES, OCR_LINES, SCANS, SP, TEXTS, bounded, has, has_bounded, hit, norm_space, q, strip,
)
from docketry import catalog as C
from docketry import fixtures as X
from docketry.functions import detectors as D
from docketry.functions import text as T
from docketry.functions.similarity import token_set, with_similarity
from docketry.operators import classify as K
from docketry.operators import lines as L
from docketry.plans import documents as P

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def texts(spark, sf):
    a = X.scans(spark, sf).select(F.lit("scan").alias("src"), "doc_id", "text")
    return a.unionByName(X.documents(spark, sf).select(F.lit("doc").alias("src"), "doc_id", "text"))


# --- file names, ids ---------------------------------------------------------------------------

@query("p1_clean_filename", f"""WITH {FILES},
 n AS (SELECT doc_id, regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9_.-]', '_', 'g') AS clean FROM files)
SELECT doc_id, clean, CASE WHEN regexp_matches(clean, '^\\.*[^.].*\\.[^.]*$') THEN regexp_extract(clean, '^(.*)\\.[^.]*$', 1) ELSE clean END AS stem,
 CASE WHEN contains(clean, '.') THEN lower(regexp_extract(clean, '\\.([^.]*)$', 1)) ELSE 'png' END AS ext FROM n""")
def p1(spark, sf):
    c = T.clean_filename(T.basename(F.col("path")))
    f = X.files(spark, sf).select("doc_id", c.alias("clean"))
    return f.select("doc_id", "clean", T.stem(F.col("clean")).alias("stem"), T.extension(F.col("clean")).alias("ext"))


@query("p2_assign_txn", f"""WITH {FILES},
 n AS (SELECT *, substr(sha256(path || '#' || length || '#run-1'), 1, 12) AS txn_id,
  regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9_.-]', '_', 'g') AS clean FROM files),
 s AS (SELECT *, CASE WHEN regexp_matches(clean, '^\\.*[^.].*\\.[^.]*$') THEN regexp_extract(clean, '^(.*)\\.[^.]*$', 1) ELSE clean END AS stem FROM n)
SELECT path, txn_id, stem || '_' || txn_id AS base_dir, stem || '_' || strftime(modificationTime, '%Y%m%d_%H%M%S') AS stamped,
  stem || '_page_01_doc_01.png' AS first_child FROM s""")
def p2(spark, sf):
    df = P.assign_txn(X.files(spark, sf), "run-1")
    return df.select("path", "txn_id", "base_dir", "stamped",
                     P.child_name(F.col("stem"), F.lit(1), F.lit(1)).alias("first_child"))


# --- lines -------------------------------------------------------------------------------------

@query("p3_text_filter", f"""WITH {OCR_LINES}
SELECT doc_id, line_no, text FROM ocr_lines WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')""")
def p3(spark, sf):
    return K.text_filter(X.ocr_lines(spark, sf)).select("doc_id", "line_no", "text")


@query("p4_dedup_keep_first", f"""WITH {OCR_LINES}
SELECT doc_id, text, min(line_no) AS line_no FROM ocr_lines GROUP BY ALL""")
def p4(spark, sf):
    return L.dedup_keep_first(X.ocr_lines(spark, sf), ["doc_id"], "text", "line_no").select("doc_id", "text", "line_no")


#: What the pages' references stand for, and references written behind each page with what they stand for.
_SEEN = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&reg;": "\u00ae", "&middot;": "\u00b7",
    "&bull;": "\u2022", "&hellip;": "\u2026", "&ndash;": "\u2013", "&mdash;": "\u2014", "&lsquo;": "\u2018", "&rsquo;": "\u2019",
    "&ldquo;": "\u201c", "&rdquo;": "\u201d", "&laquo;": "\u00ab", "&raquo;": "\u00bb", "&euro;": "\u20ac", "&pound;": "\u00a3",
    "&times;": "\u00d7", "&deg;": "\u00b0", "&#39;": "'", "&#x27;": "'", "&amp;": "&",
}
_WRITTEN = "<br>caf&eacute; &Auml;x &hearts; it&#39 s &amp x &#x41 &notit; &notin; &copyright &unknown; &zz &NotEqualTilde; &lt"
_READ = "caf\u00e9 \u00c4x \u2665 it' s & x A \u00acit; \u2209 \u00a9right &unknown; &zz \u2242\u0338 <"
_ENT = "s2"
for _k, _v in _SEEN.items():
    _ENT = f"replace({_ENT}, {q(_k)}, {q(_v)})"
_ENT = f"{_ENT} || chr(10) || {q(_READ)}"


def pages(spark, sf):
    return X.widen(X.table(spark, sf, "pages")).select("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit(_WRITTEN)).alias("html"))


@query("p5_strip_markup", f"""WITH a AS (
 SELECT page_id, regexp_replace(regexp_replace(html, '<br{SP}*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS s2 FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)),
b AS (SELECT page_id, list_filter([{strip('x')} for x in regexp_split_to_array({_ENT}, '[\\r\\n]+')], lambda y: y <> '') AS p FROM a)
SELECT page_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS line_no, unnest(p) AS line FROM b""")
def p5(spark, sf):
    d = pages(spark, sf)
    return d.select("page_id", F.posexplode(T.strip_markup(F.col("html"))).alias("line_no", "line"))


_NOISE_SQL = f"""
u AS (SELECT id, pos, {strip('s')} AS s FROM raw),
v AS (SELECT id, pos, s, regexp_matches(s, '[{{}}\\[\\]()]') AS br,
   length(regexp_replace(s, '[^A-Za-z\\x{{0900}}-\\x{{097F}}]', '', 'g')) / greatest(1, length(s)) AS ratio FROM u),
w AS (SELECT id, pos, {norm_space("CASE WHEN br THEN regexp_replace(s, '[{}\\[\\]()]', ' ', 'g') ELSE s END")} AS line
   FROM v WHERE NOT (br AND ratio < 0.07)),
z AS (SELECT id, line, min(pos) AS pos FROM w
   WHERE line <> '' AND NOT regexp_matches(line, '^[\\[\\]()\\p{{Nd}}.,\\s\\-:;]+$')
     AND NOT regexp_matches(line, '^(?:conf(?:idence)?[:\\s]*)?\\p{{Nd}}{{1,3}}(?:\\.\\p{{Nd}}+)?$') GROUP BY ALL)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS line_no, line FROM z"""


@query("p6_drop_ocr_noise", f"""WITH {OCR_LINES},
raw AS (SELECT doc_id AS id, 4 * line_no AS pos, CASE WHEN line_no % 4 = 2 THEN '(' || text || ')' ELSE text END AS s FROM ocr_lines
 UNION ALL SELECT doc_id, 4 * line_no + 1, '[' || doc_id || ', ' || line_no || '] (0.5)' FROM ocr_lines
 UNION ALL SELECT doc_id, 4 * line_no + 2, 'conf: 0.' || (doc_id % 100) FROM ocr_lines),""" + _NOISE_SQL)
def p6(spark, sf):
    """Document lines, some in brackets, each followed by coordinates and a confidence such as engines print."""
    i = F.col("doc_id")

    def noisy(s, n):
        return F.array(
            F.when(n % 4 == 2, F.concat(F.lit("("), s, F.lit(")"))).otherwise(s),
            F.concat(F.lit("["), i.cast("string"), F.lit(", "), n.cast("string"), F.lit("] (0.5)")),
            F.concat(F.lit("conf: 0."), (i % 100).cast("string")))

    lines = F.flatten(F.transform(F.split("text", "\n"), noisy))
    d = X.documents(spark, sf).select(i.alias("id"), T.drop_ocr_noise(lines).alias("lines"))
    return d.select("id", F.posexplode("lines").alias("line_no", "line"))


@query("p6_drop_ocr_noise_html", f"""WITH a AS (
 SELECT page_id, regexp_replace(regexp_replace(html, '<br{SP}*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS s2 FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)),
b AS (SELECT page_id, list_filter([{strip('x')} for x in regexp_split_to_array({_ENT}, '[\\r\\n]+')], lambda y: y <> '') AS p FROM a),
raw AS (SELECT page_id AS id, generate_subscripts(p, 1) AS pos, unnest(p) AS s FROM b),""" + _NOISE_SQL)
def p6h(spark, sf):
    d = pages(spark, sf)
    d = d.select(F.col("page_id").alias("id"), T.drop_ocr_noise(F.array("html")).alias("lines"))
    return d.select("id", F.posexplode("lines").alias("line_no", "line"))


@query("p7_norm_space", f"""SELECT conv_id, turn, {norm_space('text')} AS text FROM conversations""")
def p7(spark, sf):
    return X.table(spark, sf, "conversations").select("conv_id", "turn", T.norm_space(F.col("text")).alias("text"))


def _match_lines_sql(split_short: bool) -> str:
    more = f"list_filter([{strip('x')} for x in regexp_split_to_array(text, '[.,;:]')], lambda y: y <> '')"
    pick = f"CASE WHEN len(a) < 5 THEN list_concat(a, {more}) ELSE a END" if split_short else "a"
    return f"""WITH {TEXTS},
l AS (SELECT src, doc_id, text, list_filter([{strip('x')} for x in regexp_split_to_array(text, '[\\r\\n]+')], lambda y: y <> '') AS a FROM texts),
m AS (SELECT src, doc_id, {pick} AS p FROM l),
n AS (SELECT src, doc_id, generate_subscripts(p, 1) AS pos, {norm_space('unnest(p)')} AS line FROM m),
o AS (SELECT src, doc_id, line, min(pos) AS pos FROM n WHERE line <> '' GROUP BY ALL)
SELECT src, doc_id, CAST(row_number() OVER (PARTITION BY src, doc_id ORDER BY pos) - 1 AS INTEGER) AS line_no, line FROM o"""


@query("p8_match_lines", _match_lines_sql(True))
def p8(spark, sf):
    return texts(spark, sf).select("src", "doc_id", F.posexplode(T.match_lines(F.col("text"))).alias("line_no", "line"))


@query("p8b_match_lines_as_is", _match_lines_sql(False))
def p8b(spark, sf):
    return texts(spark, sf).select(
        "src", "doc_id", F.posexplode(T.match_lines(F.col("text"), split_short=False)).alias("line_no", "line"))


@query("p9_min_text", f"""WITH {OCR_LINES}
SELECT doc_id, line_no, length({strip('text')}) >= 4 AS usable, length({strip('text')}) >= 1 AS not_blank FROM ocr_lines""")
def p9(spark, sf):
    return X.ocr_lines(spark, sf).select(
        "doc_id", "line_no", T.min_text(F.col("text")).alias("usable"), T.min_text(F.col("text"), 1).alias("not_blank"))


@query("p10_plain_pattern", f"""WITH {SCANS}, pats AS (SELECT * FROM (VALUES {", ".join(f"({n}, {q(p)})" for _, _, n, p in C.pattern_rows())}) t(pattern_ord, pattern)),
pl AS (SELECT pattern_ord, trim(regexp_replace(regexp_replace(replace(pattern, '\\b', ' '), '[^A-Za-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM pats)
SELECT CAST(pattern_ord AS INTEGER) AS pattern_ord, plain, count(doc_id) AS n_docs FROM pl LEFT JOIN scans ON contains(lower(text), lower(plain)) GROUP BY ALL""")
def p10(spark, sf):
    """Documents holding each readable pattern verbatim (the phrases join to documents by occurrence)."""
    spark_cat = K.catalogue(spark).select("pattern_ord", "plain")
    occ = X.scans(spark, sf).select("doc_id", K.phrase_ords(F.lower("text")).alias("ords"))
    n = occ.select(F.explode("ords").alias("pattern_ord")).groupBy("pattern_ord").count()
    j = spark_cat.join(n, "pattern_ord", "left")
    return j.select("pattern_ord", "plain", F.coalesce("count", F.lit(0).cast("bigint")).alias("n_docs"))


@query("p11_first_text", """SELECT doc_id, coalesce(nullif(trim(CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '  ' END), ''),
  nullif(trim(text), ''), nullif(trim(lang), '')) AS first_text FROM documents""")
def p11(spark, sf):
    i = F.col("doc_id") % 3
    return X.documents(spark, sf).select("doc_id", T.first_text(
        F.when(i == 0, F.col("source")).when(i == 1, "  "), F.col("text"), F.col("lang")).alias("first_text"))


@query("p12_preview", """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS preview,
 CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines FROM documents""")
def p12(spark, sf):
    d = X.documents(spark, sf).select("doc_id", F.split("text", "\n").alias("lines"))
    return d.select("doc_id", T.preview(F.col("lines")).alias("preview"), F.size("lines").alias("n_lines"))


# --- detectors ---------------------------------------------------------------------------------

_DIG = lambda x: f"regexp_replace({x}, '\\P{{Nd}}', '', 'g')"
_UPW = lambda x: f"upper(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"
_PAN_OK = "'^[A-Z]{5}\\p{Nd}{4}[A-Z]$'"


def digit12_sql(t):
    return f"coalesce({bounded(t, chr(92) + 'd{12}')}, {bounded(t, r'\d{4}[-\s]?\d{4}[-\s]?\d{4}')}, {hit(t, r'\d{4}\D?\d{4}\D?\d{4}')})"


def account_sql(t):
    loose = hit(t, r"(?:\d{2,5}\D?){2,4}\d{2,5}")
    return f"coalesce({bounded(t, r'\d{11}')}, {bounded(t, r'\d{3}[-\s]?\d{4}[-\s]?\d{4}')}, CASE WHEN length({_DIG(loose)}) = 11 THEN {loose} END)"


def pan_sql(t):
    cands = [bounded(t, r"[A-Z]{5}\d{4}[A-Z]", True),
             bounded(t, r"[A-Z]{5}" + SP + r"?\d{4}" + SP + "?[A-Z]", True),
             bounded(t, r"[A-Z]{5}[-\s]?\d{4}[-\s]?[A-Z]", True), hit(t, "[A-Za-z0-9]{10}")]
    whens = " ".join(f"WHEN regexp_matches({_UPW(c)}, {_PAN_OK}) THEN {c}" for c in cands)
    return f"CASE {whens} END"


_PHRASE = r"(Elector(?:'s)? Name|Elector Photo Identity Card|ELECTION COMMISSION OF INDIA)"


def voter_sql(t):
    head = f"regexp_extract({t}, {q('(?s)^.*?' + _PHRASE)}, 0, 'i')"
    ctx = f"substr({t}, greatest(0, length({head}) - 120) + 1, length({head}) + 120 - greatest(0, length({head}) - 120))"
    return (f"coalesce({bounded(t, r'[A-Z]{3}\d{7}', True)}, "
            f"CASE WHEN regexp_matches({t}, {q(_PHRASE)}, 'i') THEN {hit(ctx, '[A-Z0-9]{8,10}', True)} END)")


def voter_v1_sql(t):
    cands = [bounded(t, p, True) for p in (r"[A-Z]{3}\d{7}", r"[A-Z]{5}\d{4}[A-Z]", r"[A-Z]{5}" + SP + r"?\d{4}" + SP + "?[A-Z]",
                                           r"[A-Z]{5}[-\s]?\d{4}[-\s]?[A-Z]")]
    run = hit(t, "[A-Za-z0-9]{10}")
    return f"coalesce({', '.join(cands)}, CASE WHEN regexp_matches(upper({run}), {_PAN_OK}) THEN {run} END)"


def _detector(name, fn, expr, norm):
    sql = f"""WITH {TEXTS}, d AS (SELECT src, doc_id, {expr('text')} AS original FROM texts)
SELECT src, doc_id, original IS NOT NULL AS found, {norm('original')} AS normalized, original FROM d"""

    @query(name, sql)
    def run(spark, sf):
        return texts(spark, sf).select("src", "doc_id", fn(F.col("text")).alias("d")).select("src", "doc_id", "d.*")


_detector("e1_digit12", D.detect_digit12, digit12_sql, _DIG)
_detector("e2_pan", D.detect_pan, pan_sql, _UPW)
_detector("e3_voter", D.detect_voter, voter_sql, _UPW)
_detector("e3v_voter_v1", lambda c: D.detect_voter(c, "v1"), voter_v1_sql, _UPW)
_detector("e4_account11", D.detect_account11, account_sql, _DIG)

_M = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_DN = r"\d{1,2}[\/\-\s]\d{1,2}[\/\-\s]\d{2,4}"
_DM = rf"\d{{1,2}}[\/\-\s](?:{_M}|[0-9]{{1,2}})[\/\-\s]\d{{2,4}}"


def components_sql(t, compat):
    son = "on of" if compat == "v14" else "son of"
    yf = r"\d{4}[\/\-\s]\d{1,2}[\/\-\s]\d{1,1}" if compat == "v11" else r"\d{4}[\/\-\s]\d{1,2}[\/\-\s]\d{1,2}"
    word = has_bounded(t, "Date of Birth|DOB", True)
    if compat == "v14":
        dob_text = bounded(t, f"{_DN}|{yf}|{_DM}", True)
    else:
        dob_text = f"CASE WHEN {word} THEN {bounded(t, f'{_DN}|{yf}')} ELSE {bounded(t, f'{_DM}|{_DN}', True)} END"
    male, letter = has_bounded(t, "Male", True), has_bounded(t, r"(?:Gender|Sex)[:\s]*M", True)
    return f"""{digit12_sql(t)} IS NOT NULL AS number_found, {_DIG(digit12_sql(t))} AS number_value,
 ({male} OR {letter}) AS male_found, CASE WHEN {male} THEN 'Male' WHEN {letter} THEN 'M' END AS male_value,
 ({word} OR {has_bounded(t, f'{_DM}|{_DN}', True)}) AS dob_found, {dob_text} AS dob_text,
 {has(t, 'Government of India', True)} AS issuer_found, {has(t, 'Unique Identification Authority|UIDAI', True)} AS authority_found,
 {has_bounded(t, 'Address', True)} AS address_found,
 {has_bounded(t, f'S/O|SO|D/O|DO|W/O|WO|{son}|wife of|daughter of', True)} AS relation_found"""


def _components(name, compat):
    @query(name, f"WITH {TEXTS} SELECT src, doc_id, {components_sql('text', compat)} FROM texts")
    def run(spark, sf):
        return texts(spark, sf).select("src", "doc_id", D.id_components(F.col("text"), compat).alias("d")).select("src", "doc_id", "d.*")


_components("e5_id_components", "v5")
_components("e5v_id_components_v14", "v14")
_components("e5v_id_components_v11", "v11")

_SIDE = """, c AS (SELECT src, doc_id, CAST(number_found AS INT) + CAST(male_found AS INT) + CAST(dob_found AS INT) + CAST(issuer_found AS INT) AS front_count,
 CAST(authority_found AS INT) + CAST(address_found AS INT) + CAST(relation_found AS INT) AS back_count FROM p)
SELECT *, front_count >= 2 AS front, back_count >= 1 AS back, {both} AS "both" FROM c"""


def _side(name, compat, both):
    @query(name, f"WITH {TEXTS}, p AS (SELECT src, doc_id, {components_sql('text', 'v5')} FROM texts)" + _SIDE.format(both=both))
    def run(spark, sf):
        d = texts(spark, sf).select("src", "doc_id", D.id_components(F.col("text")).alias("c"))
        return d.select("src", "doc_id", D.id_side(F.col("c"), compat).alias("s")).select("src", "doc_id", "s.*")


_side("e6_id_side", "strict", "front_count >= 2 AND back_count >= 1")
_side("e6v_id_side_v5", "v5", "true")


# --- template similarity ------------------------------------------------------------------------

PATS = "pats AS (SELECT * FROM (VALUES " + ", ".join(
    f"({t}, {q(d)}, {n}, {q(p)}, {q(' '.join(sorted(set(K.plain_words(p).lower().split()))))})"
    for t, d, n, p in C.pattern_rows()) + ") t(type_ord, doc_type, pattern_ord, pattern, ptoks))"


def tokens_sql(t):
    return f"list_sort(list_distinct(list_filter(string_split(lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> '')))"


_LCS = """len(x) + len(y) - 2 * list_last(list_reduce(list_prepend([0 for j in range(len(y) + 1)], [[i::INT] for i in range(1, len(x) + 1)]),
   lambda row, i: list_reduce(list_prepend([0], [[j::INT] for j in range(1, len(y) + 1)]),
     lambda acc, j: list_append(acc, CASE WHEN x[i[1]] = y[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], list_last(acc)) END))))"""


def ratio_ctes(src: str, keep: str, threshold: float, p: str = "r") -> str:
    """From ``src`` (keep, a, b token lists): sim >= threshold."""
    return f"""{p}0 AS (SELECT {keep}, a, b, list_filter(a, lambda t: list_contains(b, t)) AS s FROM {src} WHERE len(a) > 0 AND len(b) > 0),
{p}1 AS (SELECT *, array_to_string(list_filter(a, lambda t: NOT list_contains(s, t)), ' ') AS x, array_to_string(list_filter(b, lambda t: NOT list_contains(s, t)), ' ') AS y,
   length(array_to_string(s, ' ')) AS ns, length(array_to_string(a, ' ')) AS na, length(array_to_string(b, ' ')) AS nb FROM {p}0),
{p}2 AS (SELECT *, CASE WHEN len(s) > 0 AND (x = '' OR y = '') THEN 100.0::DOUBLE
     WHEN len(s) > 0 THEN greatest(100 - 100 * (1 + length(x))::DOUBLE / (ns + na), 100 - 100 * (1 + length(y))::DOUBLE / (ns + nb)) ELSE 0 END AS known,
   100 - 100 * abs(length(x) - length(y))::DOUBLE / (na + nb) AS bound FROM {p}1),
{p}3 AS (SELECT *, known < 100 AND bound >= {threshold} AND bound > known AS ask FROM {p}2 WHERE greatest(known, bound) >= {threshold}),
{p}u AS (SELECT DISTINCT x, y FROM {p}3 WHERE ask),
{p}l AS (SELECT x, y, {_LCS} AS dist FROM {p}u),
{p}4 AS (SELECT {p}3.*, CASE WHEN ask THEN greatest(known, 100 - 100 * dist::DOUBLE / (na + nb)) ELSE known END AS sim FROM {p}3 LEFT JOIN {p}l ON ask AND {p}3.x = {p}l.x AND {p}3.y = {p}l.y),
{p}sims AS (SELECT {keep}, sim FROM {p}4 WHERE sim >= {threshold})"""


@query("f1_token_set_ratio", f"""WITH {SCANS}, {PATS},
pairs AS (SELECT doc_id, {tokens_sql('text')} AS a, {tokens_sql("(SELECT string_agg(n_name, ' ') FROM nation WHERE n_nationkey = c_nationkey) || ' identity card customer'")} AS b
  FROM scans JOIN customer ON doc_id = c_custkey),
{ratio_ctes('pairs', 'doc_id', 0)}
SELECT doc_id, round(sim, 6) AS sim FROM rsims""")
def f1(spark, sf):
    """Every scan against a phrase made from its customer's nation."""
    n = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey").join(n, "c_nationkey")
    d = X.scans(spark, sf).join(c, "doc_id")
    d = d.select("doc_id", token_set(F.col("text")).alias("a"), token_set(F.concat("n_name", F.lit(" identity card customer"))).alias("b"))
    return with_similarity(d, "a", "b", "sim").select("doc_id", F.round("sim", 6).alias("sim"))


def _lines(split: str) -> str:
    return f"""ls AS (SELECT doc_id, text, list_filter([{strip('z')} for z in regexp_split_to_array(text, '[\\r\\n]+')], lambda y: y <> '') AS a0 FROM scans),
mm AS (SELECT doc_id, text, {split} AS p FROM ls),
ln AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, {norm_space('unnest(p)')} AS line FROM mm),
lines0 AS (SELECT doc_id, line, min(pos) AS pos FROM ln WHERE line <> '' GROUP BY ALL),
lines1 AS (SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS line_no FROM lines0),
lines AS (SELECT * FROM lines1 UNION ALL SELECT doc_id, {norm_space('text')}, 2147483647 FROM scans)"""
_SPLIT = "CASE WHEN len(a0) < 5 THEN list_concat(a0, list_filter([" + strip("z") + " for z in regexp_split_to_array(text, '[.,;:]')], lambda y: y <> '')) ELSE a0 END"


def _regex_sql(p):
    if p == r"\bpan\b":
        return bounded("text", "pan", True)
    if p == r"\b[A-Z]{3}\d{7}\b":
        return bounded("text", r"[A-Z]{3}\d{7}", True)
    return hit("text", p, True)


RX = "rx AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {n} AS pattern_ord, {_regex_sql(p)} AS match FROM scans" for _, _, n, p in C.pattern_rows()) + ")"


def fuzzy_ctes(split: str, every: bool, threshold: int = 75) -> str:
    cond = "" if every else "JOIN rx ON rx.doc_id = lines.doc_id AND rx.pattern_ord = pats.pattern_ord AND rx.match IS NULL"
    return f"""{SCANS}, {PATS}, {RX}, {_lines(split)},
cand AS (SELECT lines.doc_id, pats.pattern_ord, line_no, line, string_split(ptoks, ' ') AS a, {tokens_sql('line')} AS b
   FROM lines CROSS JOIN pats {cond}),
{ratio_ctes('cand', 'doc_id, pattern_ord, line_no, line', threshold)},
fz AS (SELECT doc_id, pattern_ord, min(line_no) AS line_no, arg_min(line, line_no) AS line, arg_min(sim, line_no) AS sim FROM rsims GROUP BY ALL)"""


def _all_fuzzy(spark, sf, split_short=True, threshold=C.FUZZY_THRESHOLD):
    d = X.scans(spark, sf)
    asked = d.select("doc_id", "text", T.match_lines(F.col("text"), split_short).alias("lines"), K._every_pattern().alias("todo"))
    return K.fuzzy_hits(asked, threshold)


@query("f2_first_line_match", f"""WITH {fuzzy_ctes(_SPLIT, True)}
SELECT doc_id, CAST(pattern_ord AS INTEGER) AS pattern_ord, line_no, line, round(sim, 6) AS sim FROM fz WHERE line_no < 2147483647""")
def f2(spark, sf):
    h = _all_fuzzy(spark, sf).filter("hit.line_no < 2147483647")
    return h.select("doc_id", "pattern_ord", "hit.line_no", "hit.line", F.round("hit.similarity", 6).alias("sim"))


def _at_threshold(threshold: int):
    @query(f"f5_threshold_{threshold}", f"""WITH {fuzzy_ctes(_SPLIT, True, threshold)}
SELECT doc_id, CAST(pattern_ord AS INTEGER) AS pattern_ord, line_no, line, round(sim, 6) AS sim FROM fz""")
    def f5(spark, sf):
        h = _all_fuzzy(spark, sf, threshold=threshold)
        return h.select("doc_id", "pattern_ord", "hit.line_no", "hit.line", F.round("hit.similarity", 6).alias("sim"))


for _threshold in (60, 90):
    _at_threshold(_threshold)


_BROKEN = SCANS.replace("scans AS", "whole AS", 1) + """, scans AS (SELECT doc_id, replace(text, ' ', ' quixotic rigmarole' || chr(10) || 'zanzibar ') AS text FROM whole)"""


@query("f3_full_text_fallback", f"""WITH {fuzzy_ctes(_SPLIT, True).replace(SCANS, _BROKEN)}
SELECT doc_id, CAST(pattern_ord AS INTEGER) AS pattern_ord, line, round(sim, 6) AS sim FROM fz WHERE line_no = 2147483647""")
def f3(spark, sf):
    """Scans whose phrases are broken over lines, amid other words, so that only the whole text has them."""
    d = X.scans(spark, sf).select("doc_id", F.replace("text", F.lit(" "), F.lit(" quixotic rigmarole\nzanzibar ")).alias("text"))
    h = K.fuzzy_hits(d.select("doc_id", "text", T.match_lines(F.col("text"), True).alias("lines"), K._every_pattern().alias("todo")))
    h = h.filter("hit.line_no = 2147483647")
    return h.select("doc_id", "pattern_ord", "hit.line", F.round("hit.similarity", 6).alias("sim"))


def _hits_ctes(split):
    return fuzzy_ctes(split, False) + """,
hits AS (SELECT doc_id, pattern_ord, 'regex' AS method, match, CAST(NULL AS INTEGER) AS score FROM rx WHERE match IS NOT NULL
  UNION ALL SELECT doc_id, pattern_ord, 'fuzzy', line, CAST(floor(sim) AS INTEGER) FROM fz)"""


@query("f4_pattern_hit", f"""WITH {_hits_ctes('a0')}
SELECT doc_id, CAST(type_ord AS INTEGER) AS type_ord, doc_type, CAST(pattern_ord AS INTEGER) AS pattern_ord, pattern, method, match, score FROM hits JOIN pats USING (pattern_ord)""")
def f4(spark, sf):
    return K.pattern_hits(X.scans(spark, sf))


_NUMS = ", ".join(f"{e} AS {n}" for n, e in (
    ("pan", _UPW(pan_sql("text"))), ("digit12", _DIG(digit12_sql("text"))), ("voter", _UPW(voter_sql("text"))), ("account11", _DIG(account_sql("text")))))
_TYPES = "types AS (SELECT * FROM (VALUES (0,'PAN_CARD',3,'pan',1),(1,'AADHAAR_CARD',3,'digit12',1),(2,'DRIVING_LICENSE',3,NULL,0),(3,'VOTER_ID',3,'voter',1),(4,'BANK_STATEMENT',4,'account11',1)) t(type_ord, doc_type, min_score, chk, bonus))"
_FOUND = "CASE chk WHEN 'pan' THEN pan IS NOT NULL WHEN 'digit12' THEN digit12 IS NOT NULL WHEN 'voter' THEN voter IS NOT NULL WHEN 'account11' THEN account11 IS NOT NULL ELSE true END"
SCORES = f"""{_hits_ctes('a0')}, {_TYPES}, nums AS (SELECT doc_id, {_NUMS} FROM scans),
hc AS (SELECT doc_id, type_ord, count(*) AS n FROM hits JOIN pats USING (pattern_ord) GROUP BY ALL),
scores AS (SELECT nums.doc_id, CAST(types.type_ord AS INTEGER) AS type_ord, types.doc_type,
  CAST(coalesce(hc.n, 0) + CASE WHEN bonus > 0 AND {_FOUND} THEN bonus ELSE 0 END AS INTEGER) AS score, {_FOUND} AS checks_pass, min_score
  FROM nums CROSS JOIN types LEFT JOIN hc ON hc.doc_id = nums.doc_id AND hc.type_ord = types.type_ord),
best AS (SELECT doc_id, coalesce(arg_max(doc_type, score * 10 - type_ord) FILTER (WHERE score >= min_score AND checks_pass), 'UNKNOWN') AS best_type,
  max(score) AS top_score FROM scores GROUP BY doc_id)"""


@query("c2_score_v2", f"WITH {SCORES} SELECT doc_id, type_ord, doc_type, score, checks_pass, score >= min_score AND checks_pass AS acceptable FROM scores")
def c2(spark, sf):
    return K.score_v2(X.scans(spark, sf))


@query("c4_select_eligible", f"WITH {SCORES} SELECT doc_id, best_type FROM best")
def c4(spark, sf):
    return K.select_eligible(K.score_v2(X.scans(spark, sf)))


@query("c5_classification_struct", f"""WITH {SCORES},
m AS (SELECT doc_id, string_agg(pattern || '|' || method || '|' || match || '|' || coalesce(CAST(score AS VARCHAR), ''), chr(10) ORDER BY type_ord, pattern_ord) AS matched
 FROM (SELECT doc_id, type_ord, pattern_ord, pattern, method, match, score FROM hits JOIN pats USING (pattern_ord)
   UNION ALL SELECT doc_id, type_ord, 1000, CASE chk WHEN 'pan' THEN 'PAN_NUMBER' WHEN 'digit12' THEN 'AADHAAR_NUMBER' WHEN 'voter' THEN 'VOTERID_NUMBER' ELSE 'ACCOUNT11_NUMBER' END,
     'detector', CASE chk WHEN 'pan' THEN pan WHEN 'digit12' THEN digit12 WHEN 'voter' THEN voter ELSE account11 END, NULL
   FROM nums CROSS JOIN types WHERE bonus > 0 AND {_FOUND}) GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(doc_type || '=' || score, ',' ORDER BY type_ord) AS scores FROM scores GROUP BY doc_id)
SELECT doc_id, best_type, s.scores, m.matched FROM best JOIN s USING (doc_id) LEFT JOIN m USING (doc_id)""")
def c5(spark, sf):
    return shown(K.classify(X.scans(spark, sf)))


def shown(k):
    """Scores and matched patterns as text, for comparison."""
    m = F.transform("matched", lambda m: F.concat_ws("|", m["pattern"], m["method"], m["match"], F.coalesce(m["score"].cast("string"), F.lit(""))))
    s = F.transform("scores", lambda s: F.concat_ws("=", s["doc_type"], s["score"].cast("string")))
    return k.select("doc_id", "best_type", F.array_join(s, ",").alias("scores"), F.nullif(F.array_join(m, "\n"), F.lit("")).alias("matched"))


# --- the same over scans and whole documents -----------------------------------------------------

_TEXTS = SCANS.replace("scans AS", "whole AS", 1) + """, scans AS (SELECT 2 * doc_id + 1 AS doc_id, text FROM whole UNION ALL SELECT 2 * doc_id, text FROM documents)"""
_BROKEN_TEXTS = _TEXTS.replace("+ 1 AS doc_id, text", "+ 1 AS doc_id, replace(text, ' ', ' quixotic rigmarole' || chr(10) || 'zanzibar ') AS text").replace(
    "SELECT 2 * doc_id, text FROM documents", """SELECT 2 * doc_id, CASE WHEN doc_id % 5 = 0 THEN
 'quixotic rigmarole permanent' || chr(10) || 'account zanzibar rigmarole' || chr(10) || 'number quixotic zanzibar' || chr(10) || text ELSE text END FROM documents""")


def classified_texts(spark, sf):
    """Scans (odd ids) and whole documents (even ids)."""
    n = F.when(F.col("src") == "scan", 1).otherwise(0)
    return texts(spark, sf).select((2 * F.col("doc_id") + n).alias("doc_id"), "text")


def _over_texts(name, run, scans_name):
    """A query over scans again, its SQL with the documents added to the scans."""
    query(name, SQL[scans_name].replace(SCANS, _TEXTS))(run)


def f2_texts(spark, sf):
    d = classified_texts(spark, sf)
    h = K.fuzzy_hits(d.select("doc_id", "text", T.match_lines(F.col("text"), True).alias("lines"), K._every_pattern().alias("todo")))
    h = h.filter("hit.line_no < 2147483647")
    return h.select("doc_id", "pattern_ord", "hit.line_no", "hit.line", F.round("hit.similarity", 6).alias("sim"))


def f3_texts(spark, sf):
    """Scans with broken phrases, as in f3_full_text_fallback, and whole documents, some with a phrase broken over three lines."""
    broken = F.replace("text", F.lit(" "), F.lit(" quixotic rigmarole\nzanzibar "))
    phrase = F.lit("quixotic rigmarole permanent\naccount zanzibar rigmarole\nnumber quixotic zanzibar\n")
    long = F.when(F.col("doc_id") % 10 == 0, F.concat(phrase, "text")).otherwise(F.col("text"))
    d = classified_texts(spark, sf).withColumn("text", F.when(F.col("doc_id") % 2 == 1, broken).otherwise(long))
    h = K.fuzzy_hits(d.select("doc_id", "text", T.match_lines(F.col("text"), True).alias("lines"), K._every_pattern().alias("todo")))
    h = h.filter("hit.line_no = 2147483647")
    return h.select("doc_id", "pattern_ord", "hit.line", F.round("hit.similarity", 6).alias("sim"))


def f4_texts(spark, sf):
    return K.pattern_hits(classified_texts(spark, sf))


def c2_texts(spark, sf):
    return K.score_v2(classified_texts(spark, sf))


def c4_texts(spark, sf):
    return K.select_eligible(K.score_v2(classified_texts(spark, sf)))


def c5_texts(spark, sf):
    return shown(K.classify(classified_texts(spark, sf)))


_over_texts("f2_first_line_match_texts", f2_texts, "f2_first_line_match")
query("f3_full_text_fallback_texts", SQL["f3_full_text_fallback"].replace(_BROKEN, _BROKEN_TEXTS))(f3_texts)
_over_texts("f4_pattern_hit_texts", f4_texts, "f4_pattern_hit")
_over_texts("c2_score_v2_texts", c2_texts, "c2_score_v2")
_over_texts("c4_select_eligible_texts", c4_texts, "c4_select_eligible")
_over_texts("c5_classification_struct_texts", c5_texts, "c5_classification_struct")


@query("e7_id_numbers", f"""WITH {SCORES},
n2 AS (SELECT nums.*, best_type FROM nums JOIN best USING (doc_id))
SELECT doc_id, best_type, pan, digit12, voter, account11,
 CASE best_type WHEN 'PAN_CARD' THEN pan WHEN 'AADHAAR_CARD' THEN digit12 WHEN 'VOTER_ID' THEN voter WHEN 'BANK_STATEMENT' THEN account11 END AS required FROM n2""")
def e7(spark, sf):
    k = K.classify(X.scans(spark, sf))
    cols = [F.col(f"numbers.{n}.normalized").alias(n) for n in ("pan", "digit12", "voter", "account11")]
    return k.select("doc_id", "best_type", *cols, F.col("required.normalized").alias("required"))


@query("c6_type_distribution", f"""WITH {SCORES}, j AS (SELECT c_mktsegment AS source, best_type, top_score FROM best JOIN customer ON c_custkey = doc_id)
SELECT source, best_type, count(*) AS n_docs, count(*) FILTER (WHERE best_type = 'UNKNOWN') AS n_unknown, avg(top_score) AS mean_score, CAST(grouping_id(source, best_type) AS INTEGER) AS level
FROM j GROUP BY ROLLUP (source, best_type)""")
def c6(spark, sf):
    k = K.classify(X.scans(spark, sf)).select("doc_id", "best_type", "scores")
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_mktsegment").alias("source"))
    return K.type_distribution(k.join(c, "doc_id"), "source")


@query("c7_pdf_rollup", f"""WITH {SCORES}
SELECT doc_id // 4 AS parent, count(*) AS n_children, count(*) FILTER (WHERE best_type <> 'UNKNOWN') AS n_known, 'PDF_CONTAINS_DOCUMENTS' AS document_type,
 string_agg(doc_id % 4 || ':' || best_type, ',' ORDER BY doc_id) AS children FROM best GROUP BY 1
UNION ALL SELECT DISTINCT -1 - doc_id // 4, 0, 0, 'ERROR', '' FROM best""")
def c7(spark, sf):
    """Four documents a PDF, and as many PDFs without any."""
    children, parents = _pdfs(spark, sf)
    c = F.transform("children", lambda c: F.concat_ws(":", c["child_no"].cast("string"), c["best_type"]))
    return K.pdf_rollup(children, parents).withColumn("children", F.array_join(c, ","))


def _pdfs(spark, sf):
    parent = F.expr("doc_id div 4")
    children = K.classify(X.scans(spark, sf)).select(parent.alias("parent"), (F.col("doc_id") % 4).alias("child_no"), "best_type")
    return children, X.scans(spark, sf).select(F.explode(F.array(parent, -1 - parent)).alias("parent"))


@query("c7_pdf_children", f"""WITH {SCORES}
SELECT doc_id // 4 AS parent, doc_id % 4 AS child_no, best_type AS document_type FROM best
UNION ALL SELECT DISTINCT -1 - doc_id // 4, CAST(NULL AS BIGINT), 'ERROR' FROM best""")
def c7c(spark, sf):
    return K.pdf_results(*_pdfs(spark, sf))


def _v1_sql():
    rows = C.pattern_rows(C.TEMPLATES_V1)
    arms = []
    for t, name in enumerate(C.TEMPLATES_V1):
        parts = [f"CAST({_regex_sql(p)} IS NOT NULL AS INT)" for tt, _, _, p in rows if tt == t]
        extra = {"PAN_CARD": pan_sql("text"), "AADHAAR_CARD": digit12_sql("text"), "VOTER_ID": voter_v1_sql("text")}.get(name)
        if extra:
            parts.append(f"CAST({extra} IS NOT NULL AS INT)")
        arms.append(f"SELECT doc_id, {t} AS type_ord, '{name}' AS doc_type, CAST({' + '.join(parts)} AS INTEGER) AS score FROM scans")
    return f"{SCANS}, v1 AS (" + " UNION ALL ".join(arms) + ")"


@query("c1_score_v1", f"WITH {_v1_sql()} SELECT doc_id, CAST(type_ord AS INTEGER) AS type_ord, doc_type, score FROM v1")
def c1(spark, sf):
    return K.score_v1(X.scans(spark, sf))


@query("c3_select_argmax", f"""WITH {_v1_sql()},
b AS (SELECT doc_id, arg_max(doc_type, score * 10 - type_ord) AS t, max(score) AS score FROM v1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN score >= CASE t WHEN 'BANK_STATEMENT' THEN 1 ELSE 3 END THEN t ELSE 'UNKNOWN' END AS best_type, score FROM b""")
def c3(spark, sf):
    return K.select_argmax(K.score_v1(X.scans(spark, sf)))


@query("f6_relevant_lines", f"""WITH {SCORES},
top AS (SELECT doc_id, arg_max(type_ord, score * 10 - type_ord) AS type_ord FROM scores GROUP BY doc_id),
pl AS (SELECT DISTINCT doc_id, lower(plain) AS p FROM hits JOIN pats USING (pattern_ord) JOIN top USING (doc_id, type_ord) JOIN (SELECT * FROM (VALUES {", ".join(f"({n}, {q(K.plain_words(p))})" for _, _, n, p in C.pattern_rows())}) t(pattern_ord, plain)) USING (pattern_ord)
 UNION SELECT doc_id, CASE chk WHEN 'pan' THEN 'pan number' WHEN 'digit12' THEN '12 digit number' WHEN 'voter' THEN 'voterid number' ELSE '11 digit account number' END
  FROM nums JOIN top USING (doc_id) JOIN types USING (type_ord) WHERE bonus > 0 AND {_FOUND}),
raw AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, trim(unnest(a)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM scans)),
pp AS (SELECT raw.doc_id, line_no, line, p, {tokens_sql('p')} AS a, {tokens_sql('line')} AS b FROM raw JOIN pl USING (doc_id) WHERE line <> ''),
{ratio_ctes('pp', 'doc_id, line_no, line', 75, 'k')},
m AS (SELECT DISTINCT doc_id, line_no, line FROM pp WHERE contains(lower(line), p) UNION SELECT doc_id, line_no, line FROM ksims),
f AS (SELECT * FROM m UNION ALL SELECT doc_id, line_no, line FROM raw WHERE line <> '' AND line_no < 6 AND doc_id NOT IN (SELECT doc_id FROM m))
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_no, line FROM f GROUP BY doc_id, line""")
def f6(spark, sf):
    d = X.scans(spark, sf)
    plains = K.matched_plains(K.classify(d))
    return K.relevant_lines(d.select("doc_id", F.split("text", "\n").alias("lines")), plains)
