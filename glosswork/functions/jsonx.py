"""Objects, lists and scores out of noisy model replies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def slice_object(text: Column, schema: str) -> Column:
    """What lies between the first { and the last }, parsed; null where it isn't JSON."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def list_or_lines(text: Column) -> Column:
    """The list between the first [ and the last ] without blank items, else the lines without bullets."""
    found = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), "array<string>")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[\s\-*•]+|\s+$", ""))
    return F.filter(F.coalesce(found, lines), lambda x: F.trim(x) != "")


def judge_score(text: Column, first: str = "accuracy", second: str = "style_match") -> Column:
    """struct<accuracy, style>: from the text as JSON, else from the object that holds both keys, else from the numbers after the keys. Null outside [0, 1]."""

    def parsed(c: Column) -> Column:
        return F.from_json(c, f"{first} double, {second} double")

    flat = parsed(F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0))
    whole = parsed(text)

    def one(key: str) -> Column:
        both = lambda x: F.when(x[first].isNotNull() & x[second].isNotNull(), x[key])
        salvaged = F.regexp_extract(text, rf'(?s)"?{key}"?\s*[:=]\s*"?{_NUMBER}', 1).try_cast("double")
        return F.coalesce(both(whole), both(flat), salvaged)

    a, b = one(first), one(second)
    return F.when(a.between(0, 1) & b.between(0, 1), F.struct(a.alias("accuracy"), b.alias("style")))


def facts_richness(value: dict) -> int:
    """Words of the text fields and items of the list fields of a parsed object."""
    texts = sum(len(v.split()) for v in (value.get(f) for f in rules.STRING_FACTS) if isinstance(v, str))
    return texts + sum(1 for v in (value.get(f) for f in rules.LIST_FACTS) if isinstance(v, list) for x in v if str(x).strip())


def _useful(value: dict) -> bool:
    return facts_richness(value) >= 8 and bool(str(value.get("summary", "")).strip())


def best_object_of(text: str | None) -> str | None:
    """The richest object of a reply, as JSON with sorted keys.

    A reply that is JSON as a whole is that object if it is a useful one, else null: what lies inside it doesn't count. Otherwise objects may start at
    any {, nested ones too; useful ones come before others, and the first of equals is taken. Null has no object.
    """
    text = text or ""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        pass
    else:
        return json.dumps(value, sort_keys=True) if isinstance(value, dict) and _useful(value) else None
    best, rank = None, None
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            this = (_useful(value), facts_richness(value))
            if rank is None or this > rank:
                best, rank = json.dumps(value, sort_keys=True), this
        at = text.find("{", at + 1)
    return best


@F.pandas_udf(StringType())
def best_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """best_object_of over a column; nested braces need a scanner that SQL doesn't have."""
    for t in texts:
        yield t.map(best_object_of)


def embedded_records(page: Column, chunk: str, record: str) -> Column:
    """Records of a page: those of its streamed chunks, unescaped and joined in order, else those of the page itself."""
    stream = F.array_join(F.regexp_extract_all(page, F.lit(chunk), F.lit(1)), "")
    plain = F.replace(F.replace(stream, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    tries = [F.regexp_extract_all(c, F.lit(record), F.lit(0)) for c in (stream, plain, page)]
    some = [F.when(F.size(t) > 0, t) for t in tries]
    return F.coalesce(*some, F.array().cast("array<string>"))


def memo_key(value: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a value's JSON."""
    return F.left(F.sha2(F.to_json(value), 256), F.lit(length))


def ordered_list(text: Column) -> Column:
    """A comma list, trimmed, lowered and without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def model_candidates(primary: Column, others: Column) -> Column:
    """The primary model and the listed ones, each once, in order."""
    listed = F.filter(F.transform(F.split(others, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(primary), listed))


def retry_wait(header: Column, attempt: Column, cap: float = 8.0, give_up: float = 60.0, default: float = 2.0) -> Column:
    """Seconds to wait: the header's number or the default, plus the attempt, capped; -1 beyond the limit."""
    wait = F.coalesce(F.trim(header).try_cast("double"), F.lit(default))
    return F.when(wait > give_up, F.lit(-1.0)).otherwise(F.least(wait + attempt, F.lit(cap)))


def time_label(number: Column, total: Column, seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("Frame %d/%d at %d:%02d", number, total, F.floor(whole / 60), whole % 60)


def data_uri(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))
