"""Identity-number detectors: text column -> struct(found, normalized, original)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions.patterns import WORD, first_match, found, found_after, may_hold, unicode_regex

_NOT_WORD = rf"[^{WORD}]"


def _result(normalized: Column, original: Column) -> Column:
    return F.struct(
        normalized.isNotNull().alias("found"), normalized.alias("normalized"), original.alias("original")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{Nd}", "")


def _upper_word(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, _NOT_WORD, ""))


def detect_digit12(text: Column) -> Column:
    """Twelve digits: contiguous, grouped 4-4-4, or 4-4-4 with any single separators.

    The loosest form also matches whatever the stricter ones match, so most texts cost one scan.
    """
    loose = C.DIGIT12[2]
    hit = F.when(found(text, loose), F.coalesce(*[first_match(text, p) for p in C.DIGIT12]))
    return _result(_digits(hit), hit)


def _pan_candidates(text: Column) -> list[tuple[Column, Column]]:
    hits = [(first_match(text, p, True)) for p in C.PAN]
    pairs = [(_upper_word(h), h) for h in hits]
    run = first_match(text, C.TEN_ALNUM)
    return pairs + [(F.upper(run), run)]


def detect_pan(text: Column) -> Column:
    """Five letters, four digits, one letter; a candidate that fails validation yields to the next rule."""
    shape = r"[A-Z]{5}[-\s]?\d{4}[-\s]?[A-Z]"
    valid = unicode_regex(C.PAN_VALID)
    chosen = F.coalesce(
        *[F.when(norm.rlike(valid), F.struct(norm.alias("n"), hit.alias("o"))) for norm, hit in _pan_candidates(text)]
    )
    chosen = F.when(found(text, shape, True), chosen)
    return _result(chosen["n"], chosen["o"])


def detect_voter(text: Column, variant: str = "v2") -> Column:
    """Three letters and seven digits; else (v2) a code near an election phrase, or (v1) a PAN-like code."""
    strict = first_match(text, C.VOTER, True)
    if variant == "v1":
        loose = F.coalesce(strict, *[first_match(text, p, True) for p in C.PAN])
        run = first_match(text, C.TEN_ALNUM)
        valid_run = F.when(F.upper(run).rlike(unicode_regex(C.PAN_VALID)), run)
        hit = F.coalesce(loose, valid_run)
        return _result(_upper_word(hit), hit)
    # everything up to the end of the first phrase; its length is where the phrase ends
    head = F.regexp_extract(text, "(?s)^.*?" + unicode_regex(C.VOTER_PHRASE, True), 0)
    end = F.length(head)
    start = F.greatest(F.lit(0), end - C.VOTER_CONTEXT_CHARS)
    context = F.substring(text, start + 1, end + C.VOTER_CONTEXT_CHARS - start)
    phrase = may_hold(text, "elector", "election commission of india") & found(text, C.VOTER_PHRASE, True)
    near = F.when(phrase, first_match(context, C.VOTER_NEARBY, True))
    hit = F.coalesce(strict, near)
    return _result(_upper_word(hit), hit)


def detect_account11(text: Column) -> Column:
    """Eleven digits: contiguous, grouped 3-4-4, or the first loose digit run if it holds eleven."""
    loose = first_match(text, C.ACCOUNT11[2])
    # no loose run means no eleven digits in any shape
    hit = F.when(
        found(text, C.ACCOUNT11[2]),
        F.coalesce(
            first_match(text, C.ACCOUNT11[0]),
            first_match(text, C.ACCOUNT11[1]),
            F.when(F.length(_digits(loose)) == 11, loose),
        ),
    )
    return _result(_digits(hit), hit)


def id_components(text: Column, compat: str = "v5") -> Column:
    """Seven identity-card flags and their values.

    ``compat``: ``v5`` reads a birth date in numeric form when a birth-date word is present and with a
    month name otherwise; ``v14`` reads either form always and keeps that version's relation words;
    ``v11`` is ``v5`` with that version's one-digit day in year-first dates.
    """
    number = detect_digit12(text)
    word_male = found_after(text, ("male",), C.MALE_WORD)
    letter_male = found_after(text, ("gender", "sex"), C.MALE_LETTER)
    male = word_male | letter_male
    birth_word = found_after(text, ("date of birth", "dob"), C.DOB_WORD)
    named = rf"{C.DATE_MONTH_NAME}|{C.DATE_NUMERIC}"
    if compat == "v14":
        dob = birth_word | found(text, named, True)
        dob_text = first_match(text, f"({C.DATE_NUMERIC}|{C.DATE_YEAR_FIRST}|{C.DATE_MONTH_NAME})", True)
        relation = C.RELATION_V14
    else:
        year_first = C.DATE_YEAR_FIRST_V11 if compat == "v11" else C.DATE_YEAR_FIRST
        dob = birth_word | found(text, named, True)
        dob_text = F.when(birth_word, first_match(text, f"({C.DATE_NUMERIC}|{year_first})")).otherwise(
            first_match(text, f"({named})", True)
        )
        relation = C.RELATION
    return F.struct(
        number["found"].alias("number_found"),
        number["normalized"].alias("number_value"),
        male.alias("male_found"),
        F.when(word_male, F.lit("Male")).when(letter_male, F.lit("M")).alias("male_value"),
        dob.alias("dob_found"),
        dob_text.alias("dob_text"),
        found_after(text, ("government of india",), C.ISSUER).alias("issuer_found"),
        found_after(text, ("unique identification authority", "uidai"), C.AUTHORITY).alias("authority_found"),
        found_after(text, ("address",), C.ADDRESS).alias("address_found"),
        found(text, relation, True).alias("relation_found"),
    )


def id_side(parts: Column, compat: str = "strict") -> Column:
    """Which side of an identity card the text shows.  ``compat='v5'`` reports both sides always."""
    def count(*names: str) -> Column:
        total = F.lit(0)
        for n in names:
            total = total + parts[n].cast("int")
        return total

    front = count("number_found", "male_found", "dob_found", "issuer_found")
    back = count("authority_found", "address_found", "relation_found")
    both = F.lit(True) if compat == "v5" else (front >= 2) & (back >= 1)
    return F.struct(
        front.alias("front_count"),
        back.alias("back_count"),
        (front >= 2).alias("front"),
        (back >= 1).alias("back"),
        both.alias("both"),
    )


def id_numbers(text: Column) -> Column:
    """All four detectors in one struct, keyed by detector name."""
    return F.struct(
        detect_pan(text).alias("pan"),
        detect_digit12(text).alias("digit12"),
        detect_voter(text).alias("voter"),
        detect_account11(text).alias("account11"),
    )


def required_number(numbers: Column, best_type: Column) -> Column:
    """The number the chosen type is checked by, or null when that type has no check."""
    chosen = F.lit(None).cast("struct<found:boolean,normalized:string,original:string>")
    for doc_type, (_, check) in C.RULES.items():
        if check:
            chosen = F.when(best_type == doc_type, numbers[check]).otherwise(chosen)
    return chosen
