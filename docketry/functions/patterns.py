"""Spelling of the fixed patterns for the JVM regex engine.

The fixed patterns assume Unicode classes: a word character is a letter, a number or an
underscore, a digit is any decimal digit, a space is any Unicode space.  The JVM defaults are
ASCII, so the classes are spelled out here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_CLASSES = {r"\d": r"\p{Nd}", r"\D": r"\P{Nd}", r"\s": f"[{SPACE}]", r"\/": "/"}
# letters outside ASCII that equal an ASCII letter when case is ignored
_ODD_CASE = "[\u017f\u212a\u0130\u0131]"


def unicode_regex(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern with Unicode meaning for ``\\b \\d \\D \\s``.

    A boundary that opens a pattern, group or alternative stands before a word character, any other one
    behind it, so a single look-around does.
    """
    pattern = re.sub(r"(^|[(|:])\\b", lambda m: m.group(1) + rf"(?<![{WORD}])", pattern)
    pattern = pattern.replace(r"\b", rf"(?![{WORD}])")
    for short, spelled in _CLASSES.items():
        pattern = pattern.replace(short, spelled)
    return ("(?iu)" if ignore_case else "") + pattern


def may_hold(text: Column, *phrases: str) -> Column:
    """False only if no phrase, in any case, can be in the text.  A byte search, much cheaper than a regex."""
    low = F.lower(text)
    some = text.rlike(_ODD_CASE)
    for p in phrases:
        some = F.contains(low, F.lit(p.lower())) | some
    return F.coalesce(some, F.lit(False))


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text.rlike(unicode_regex(pattern, ignore_case)), F.lit(False))


def first_match(text: Column, pattern: str, ignore_case: bool = False, group: int = 1) -> Column:
    """First match of ``group``, or null.  For patterns that never match the empty string."""
    hit = F.regexp_extract(text, unicode_regex(pattern, ignore_case), group)
    return F.nullif(hit, F.lit(""))


def found_after(text: Column, phrases: tuple[str, ...], pattern: str) -> Column:
    """``found`` ignoring case, for patterns every match of which holds one of the phrases."""
    return F.when(may_hold(text, *phrases), found(text, pattern, True)).otherwise(F.lit(False))
