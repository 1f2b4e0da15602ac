"""Column expressions for cleaning names, lines and markup."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions.patterns import SPACE, unicode_regex

# the characters of SPACE
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ANY_SPACE = rf"[{SPACE}]+"


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(_SPACES))


def norm_space(c: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(c, _ANY_SPACE, " "))


def has_text(c: Column) -> Column:
    """At least one letter or digit."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def min_text(c: Column, n: int = C.MIN_ENGINE_TEXT) -> Column:
    """Text counts as usable when its trimmed length reaches ``n``."""
    return F.coalesce(F.length(strip(c)) >= n, F.lit(False))


def first_text(*cs: Column) -> Column:
    """First alternative that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


# --- file names --------------------------------------------------------------------------------

def clean_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*$", 0)


def stem(c: Column) -> Column:
    """Name without its last extension; a name that is only dots and a word has no extension."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(\.*[^.].*)\.[^.]*$", 1), F.lit("")), c)


def extension(c: Column, default: str = "png") -> Column:
    return F.when(F.instr(c, ".") > 0, F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))).otherwise(F.lit(default))


# --- base64 payloads ---------------------------------------------------------------------------

def decode_payload(c: Column) -> Column:
    """Bytes of a base64 payload, with or without a data-URI prefix."""
    marker = F.instr(c, ";base64,")
    body = F.when(c.startswith("data:") & (marker > 0), F.substring(c, marker + 8, F.length(c))).otherwise(c)
    return F.unbase64(body)


def encode_data_uri(c: Column, fmt: Column) -> Column:
    # base64() breaks lines for MIME; a data URI has none
    return F.concat(F.lit("data:image/"), fmt, F.lit(";base64,"), F.regexp_replace(F.base64(c), r"\s", ""))


# --- lines -------------------------------------------------------------------------------------

def _clean_pieces(text: Column, pattern: str) -> Column:
    pieces = F.transform(F.split(text, pattern), strip)
    return F.filter(pieces, lambda s: s != "")


def text_lines(text: Column) -> Column:
    """Trimmed non-blank lines, in order."""
    return _clean_pieces(text, r"[\r\n]+")


def match_lines(text: Column, split_short: bool = True) -> Column:
    """Lines to compare with templates: short texts are also cut at punctuation."""
    lines = text_lines(text)
    if split_short:
        lines = F.when(F.size(lines) < 5, F.concat(lines, _clean_pieces(text, r"[.,;:]"))).otherwise(lines)
    return F.array_distinct(F.filter(F.transform(lines, norm_space), lambda s: s != ""))


def _windows_1252(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


_C1 = [_windows_1252(n) for n in range(0x80, 0xA0)]


def _reference_names() -> Column:
    """First letter -> name -> characters, from the standard table; names with and without their semicolon."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by_letter.setdefault(name[0], {})[name] = chars
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string,map<string,string>>")


#: Names that count without a semicolon, longest first, so that a match is the longest one.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def unescape(c: Column) -> Column:
    """Replace character references in one pass: all standard names, and any number.

    A name without its semicolon counts if the standard lists it so, and then also as the beginning of a longer word.
    """
    names = _reference_names()

    def code_point(digits: Column, base: int) -> Column:
        # more than seven digits is beyond Unicode in either base
        n = F.conv(F.when(F.length(digits) <= 7, digits).otherwise("0"), base, 10).cast("bigint")
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        # control and non-characters vanish, the C1 range is read as Windows-1252
        silent = n.between(1, 8) | n.isin(0x0B, 0x7F) | n.between(0x0E, 0x1F) | n.between(0xFDD0, 0xFDEF)
        silent = silent | (valid & (n % 0x10000).isin(0xFFFE, 0xFFFF))
        western = F.element_at(F.array(*[F.lit(x) for x in _C1]), (n - 0x80 + 1).cast("int"))
        return F.when(digits != "", F.when(silent, "").when(n.between(0x80, 0x9F), western).otherwise(char))

    def named(name: Column) -> Column:
        return F.element_at(F.element_at(names, F.substring(name, 1, 1)), name)

    def one(piece: Column, i: Column) -> Column:
        number = F.regexp_extract(piece, r"^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", 0)
        decimal = F.regexp_extract(number, r"^#0*([0-9]+)", 1)
        hexa = F.regexp_extract(number, r"^#[xX]0*([0-9A-Fa-f]+)", 1)
        whole = F.regexp_extract(piece, "^[^\t\n\f <&#;]{1,32};?", 0)
        start = F.regexp_extract(piece, f"^(?:{_OPEN_NAMES})", 0)
        zero = F.when(number.rlike("^#(?:0+|[xX]0+);?$"), F.lit("\ufffd"))
        ref = F.when(number != "", number).when(named(whole).isNotNull(), whole).otherwise(start)
        char = F.when(number != "", F.coalesce(zero, code_point(decimal, 10), code_point(hexa, 16))).otherwise(
            F.coalesce(named(whole), named(start)))
        rest = F.substring(piece, F.length(ref) + 1, F.length(piece))
        return F.when(i == 0, piece).when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    done = F.array_join(F.transform(F.split(c, "&"), one), "")
    return F.when(F.instr(c, "&") > 0, done).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Lines of a marked-up text: breaks become line ends, tags go, references are resolved."""
    s = F.regexp_replace(c, rf"(?i)<br[{SPACE}]*/?>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    return text_lines(unescape(s))


# --- OCR noise ---------------------------------------------------------------------------------

def alpha_ratio(c: Column) -> Column:
    """Share of Latin and Devanagari letters."""
    letters = F.length(F.regexp_replace(c, r"[^A-Za-z\x{0900}-\x{097F}]", ""))
    return letters / F.greatest(F.lit(1), F.length(c))


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated a single time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _noise_free(line: Column) -> Column:
    """The cleaned line, or null when it is only coordinates, a confidence, or bracket noise."""
    def judge(p: Column) -> Column:
        noise = (p == "") | p.rlike(unicode_regex(C.COORDINATES_ONLY)) | p.rlike(unicode_regex(C.CONFIDENCE_ONLY))
        return F.when(~noise, p)

    bracketed = line.rlike(C.BRACKETS)
    plain = once(norm_space(F.regexp_replace(line, C.BRACKETS, " ")), judge)
    return F.when(~bracketed, once(norm_space(line), judge)).when(alpha_ratio(line) >= C.MIN_ALPHA_RATIO, plain)


def drop_ocr_noise(lines: Column) -> Column:
    """Array of lines -> array of cleaned, distinct, textual lines."""
    marked = F.exists(lines, lambda s: s.contains("<") & s.contains(">"))
    expanded = F.when(
        marked,
        F.flatten(F.transform(lines, lambda s: F.when(s.contains("<") & s.contains(">"), strip_markup(s)).otherwise(F.array(strip(s))))),
    ).otherwise(F.transform(lines, strip))
    return F.array_distinct(F.filter(F.transform(expanded, _noise_free), lambda s: s.isNotNull()))


def plain_pattern(c: Column) -> Column:
    """Readable words of a regex pattern, for fuzzy comparison: its runs of ASCII letters and digits, word-boundary marks apart."""
    return F.array_join(F.regexp_extract_all(F.replace(c, F.lit(r"\b"), F.lit(" ")), F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")


def preview(lines: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(lines, 1, n), "\n")
