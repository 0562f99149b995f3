"""Tokens and rule checks of captions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import BLANK, END, SPACE, START, any_of, let

_EDGES = ".,!?;:()[]{}\"'`"
_APART = rf"[\x09-/\x85-\x{{3000}}&&{SPACE[:-1]}/\-]]"
#: Letters in text, the most frequent first; others are rarer.
_COMMON = " etaoinshrdlucmwfgypbvkxjqz"
_EDGE = "[" + "".join(f"\\{c}" for c in _EDGES) + "]"


def words(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "")


def fewer_words(text: Column, n: int) -> Column:
    """size(words(text)) < n, told by the first n words."""
    other = "[^" + SPACE[1:]
    return ~_in_opening(text, f"^{BLANK}*+(?:{other}++{BLANK}++){{{n - 1}}}{other}", 2 * n) if n > 0 else F.lit(False)


def _in_opening(text: Column, pattern: str, spaces: int) -> Column:
    """Whether a pattern that no later text undoes is found, in the text up to a space or else in all of it."""
    return F.rlike(F.substring_index(text, " ", spaces), F.lit(pattern)) | F.rlike(text, F.lit(pattern))


def stripped_tokens(text: Column, apart: str = "/-") -> Column:
    """Distinct lower-cased tokens without outer punctuation, after the characters of ``apart`` have become spaces."""
    spaced = F.translate(text, apart, " " * len(apart))
    return F.array_distinct(F.transform(words(spaced), lambda x: F.lower(F.btrim(x, F.lit(_EDGES)))))


def evidence_tokens(text: Column, stop: Sequence[str] = rules.STOP_WORDS) -> Column:
    """Distinct tokens of a letter and two or more letters, digits or hyphens that aren't stop words."""
    found = F.regexp_extract_all(F.replace(F.lower(text), F.lit("/"), F.lit(" ")), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def word_count(text: Column, most: int | None = None) -> Column:
    """Words of letters and digits with one hyphen or apostrophe; counted up to ``most``."""
    n = F.regexp_count(text, F.lit(r"[A-Za-z0-9]+([-'][A-Za-z0-9]+)?"))
    if most is None:
        return n
    many = rf"^[^A-Za-z0-9]*+(?:[A-Za-z0-9]++(?:[-'][A-Za-z0-9]++)?+[^A-Za-z0-9]*+){{{most}}}"
    return F.when(F.rlike(text, F.lit(many)), most).otherwise(n)


def has_terms(text: Column, terms: Sequence[str]) -> Column:
    """Whether a term occurs as a whole word or phrase."""
    return let(F.lower(text), lambda low: low_terms(low, terms)) if terms else F.lit(False)


def has_substring(text: Column, terms: Sequence[str]) -> Column:
    """Whether a term occurs anywhere, within words too."""
    return let(F.lower(text), lambda low: low_within(low, terms)) if terms else F.lit(False)


# Tests of a lower-cased text. A search for plain strings is a tenth of the work of a pattern, which runs where it finds one.


def low_within(low: Column, terms: Sequence[str]) -> Column:
    """has_substring of a text that is lower-cased already."""
    return reduce(Column.__or__, (_found(low, t) for t in terms)) if terms else F.lit(False)


def _found(low: Column, term: str) -> Column:
    """A search stops at each first letter. So the part of the term that starts with its rarest letter is looked for first."""
    rarest = max(range(max(1, len(term) - 2)), key=lambda i: (_COMMON.find(term[i : i + 1]) % 99, -i))
    whole = F.contains(low, F.lit(term))
    return F.contains(low, F.lit(term[rarest:])) & whole if rarest else whole


def _matches(low: Column, hints: Sequence[str], pattern: str) -> Column:
    """Whether a pattern, each match of which holds one of the hints, is found."""
    return low_within(low, hints) & F.rlike(low, F.lit(pattern))


def _between_spaces(low: Column, terms: Sequence[str], most: int = 4) -> Column:
    """Whether one of a few terms stands between spaces, where it is a word and a token; searches for many would cost more than a pattern."""
    return low_within(low, [f" {t} " for t in terms]) if len(terms) <= most else F.lit(False)


def _apart(low: Column, terms: Sequence[str]) -> Column:
    """Whether a term occurs without an ASCII letter, digit or underscore beside it, as between ``START`` and ``END``; Java's own class is the quickest."""
    return F.rlike(F.concat(F.lit(" "), low), F.lit(rf"\W{any_of(terms)}(?!\w)"))


def low_terms(low: Column, terms: Sequence[str]) -> Column:
    """has_terms of a text that is lower-cased already."""
    return low_within(low, terms) & (_between_spaces(low, terms) | _apart(low, terms)) if terms else F.lit(False)


def _tokens(low: Column, terms: Sequence[str]) -> Column:
    """overlaps(stripped_tokens(text), terms) without making the tokens."""
    if not terms or "" in terms:
        return overlaps(stripped_tokens(low), terms)
    whole = [t for t in terms if t.strip(_EDGES) == t and not any(c in "/-" or c.isspace() for c in t)]  # no token is another one
    if not whole:
        return F.when(low.isNotNull(), F.lit(False))
    token = F.rlike(low, F.lit(f"(?:^|{_APART}){_EDGE}*{any_of(whole)}{_EDGE}*(?={_APART}|\\z)"))
    return low_within(low, whole) & (_between_spaces(low, whole) | (_apart(low, whole) & token))


def overlaps(tokens: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, terms))) if terms else F.lit(False)


def looks_english(text: Column) -> Column:
    """An a-z letter, and no more than two or a twentieth of the characters outside ASCII."""

    def few(n: Column, more: Column) -> Column:  # a character outside ASCII has one to three bytes more
        most = F.greatest(F.lit(2), F.floor(n / 20))
        outside = n - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
        return F.when(more <= most, F.lit(True)).when(more > 3 * most, F.lit(False)).otherwise(outside <= most)

    return _in_opening(text, "[A-Za-z]", 3) & let(F.char_length(text), lambda n: few(n, F.octet_length(text) - n))


def has_jargon(text: Column, banned: Sequence[str] = rules.TECH_WORDS, phrases: Sequence[str] = rules.TECH_PHRASES) -> Column:
    return let(F.lower(text), lambda low: low_jargon(low, banned, phrases))


def low_jargon(low: Column, banned: Sequence[str] = rules.TECH_WORDS, phrases: Sequence[str] = rules.TECH_PHRASES) -> Column:
    """has_jargon of a text that is lower-cased already."""
    return low_within(low, phrases) | _tokens(low, banned)


def has_reference(text: Column, banned: Sequence[str] = rules.TECH_WORDS, phrases: Sequence[str] = rules.TECH_PHRASES, more: Sequence[str] = rules.TECH_REFERENCES) -> Column:
    """Looser than has_jargon: words with an everyday sense count too."""
    return has_jargon(text, [*banned, *more], phrases)


def has_person(text: Column, terms: Sequence[str] = rules.PERSON_WORDS) -> Column:
    return let(F.lower(text), lambda low: _tokens(low, terms))


def has_person_pattern(text: Column, terms: Sequence[str] = rules.PERSON_WORDS) -> Column:
    """The audits' form: a word anywhere between non-letters."""
    return has_terms(text, terms)


def is_sensitive(text: Column, terms: Sequence[str] = rules.SENSITIVE_TERMS) -> Column:
    return let(F.lower(text), lambda low: _sensitive(low, terms))


def _sensitive(low: Column, terms: Sequence[str] = rules.SENSITIVE_TERMS) -> Column:
    skin = _matches(low, rules.SKIN_HINTS, START + f"({rules.SKIN_PATTERN})" + END)
    return skin | _matches(low, rules.PERSON_HINTS, START + rules.PERSON_PATTERN + END) | low_terms(low, terms)


def style_reason(style: Column, text: Column, banned: Sequence[str] = rules.TECH_WORDS, phrases: Sequence[str] = rules.TECH_PHRASES, more: Sequence[str] = rules.TECH_REFERENCES, person: Sequence[str] = rules.PERSON_WORDS, low_taste: Sequence[str] = ()) -> Column:
    """The first rule that a caption breaks, or ``ok``. The ban list and the require list for tech words differ."""

    def judged(low: Column) -> Column:
        jargon = low_jargon(low, banned, phrases)
        return (
            F.when(_sensitive(low), "sensitive_appearance")
            .when(low_terms(low, low_taste), "low_taste_term")
            .when((style == "humorous_non_tech") & jargon, "tech_jargon_banned")
            .when((style == "humorous_tech") & ~(jargon | _tokens(low, more)), "missing_tech_term")
            .when(style.isin("formal", "sarcastic") & F.contains(text, F.lit("!")), "exclamation")
            .when((style == "formal") & _tokens(low, person), "first_second_person")
            .when((style == "sarcastic") & jargon, "tech_jargon_banned")
            .otherwise("ok")
        )

    return F.when(~looks_english(text), "not_english").otherwise(let(F.lower(text), judged))


def style_passes(style: Column, text: Column, **lists) -> Column:
    return style_reason(style, text, **lists) == "ok"
