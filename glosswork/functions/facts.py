"""Scene facts: richness, evidence terms and phrases, scores of captions against them, and captions built from them.

A facts column is a struct; fields that it lacks count as null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .checks import evidence_tokens, style_passes, word_count, words
from .text import END, START, let, lower_lead, one_space

#: Words of a text that are looked at before all others.
_OPENING = 60
#: From so many words on a caption is long enough in every style.
_MOST_WORDS = max(max(row[0], row[2]) for row in (*rules.EVIDENCE.values(), rules.EVIDENCE_OTHERWISE))
_CODES = ("too_short", "missing_visual_anchors", "missing_clear_tech_reference")


class Facts:
    """Access to the facts struct ``name`` of a DataFrame: known fields, and typed nulls for others."""

    def __init__(self, df: DataFrame, name: str = "facts"):
        self.name, self.fields = name, set(df.schema[name].dataType.fieldNames())

    def text(self, field: str) -> Column:
        return F.coalesce(F.col(f"{self.name}.{field}"), F.lit("")) if field in self.fields else F.lit("")

    def items(self, field: str, first: int | None = None) -> Column:
        """The items of a list, or of the ``first`` ones, that aren't blank."""
        if field not in self.fields:
            return F.array().cast("array<string>")
        held = F.col(f"{self.name}.{field}")
        return F.coalesce(F.filter(F.slice(held, 1, first) if first else held, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))

    def score(self) -> Column:
        """Richness: words of the text fields and items of the list fields."""
        sizes = [F.size(words(self.text(f))) for f in rules.STRING_FACTS] + [F.size(self.items(f)) for f in rules.LIST_FACTS]
        return reduce(Column.__add__, sizes)

    def useful(self, least: int = 8) -> Column:
        return (self.score() >= least) & (F.trim(self.text("summary")) != "")

    def all_text(self, most: int = 8) -> Column:
        """Lower-cased text of the fields that name what is seen, no more than ``most`` items of each list."""
        texts = [F.nullif(self.text(f), F.lit("")) for f in ("summary", "setting", "temporal_progression")]
        lists = [F.slice(self.items(f), 1, most) for f in ("subjects", "actions", "visual_details", "fine_grained_observations")]
        return F.lower(F.concat_ws(" ", *texts, *lists))

    def first_words(self, most: int) -> Column:
        return F.array_join(F.slice(words(self.all_text()), 1, most), " ")

    def evidence_terms(self, stop: Sequence[str] = rules.STOP_WORDS, opening: bool = False) -> Column:
        """Distinct tokens of four or more characters of all fields, in order; some of them, from the first items of each list, as the ``opening``."""
        lists = [self.items(f, 8 if opening else None) for f in rules.LIST_FACTS]
        said = F.concat_ws(" ", *(F.nullif(self.text(f), F.lit("")) for f in (*rules.STRING_FACTS, "audio_hint")), *lists)
        return F.filter(evidence_tokens(_opening(said) if opening else said, stop), lambda t: F.char_length(t) >= 4)

    def _phrases(self, singles: Sequence[str]) -> Column:
        def bare(c: Column) -> Column:
            return F.rtrim(F.trim(c), F.lit("."))

        lists = [F.transform(self.items(f), bare) for f in rules.PHRASE_FACTS]
        own = F.filter(F.array(*(bare(self.text(f)) for f in singles)), lambda x: F.trim(x) != "")
        long = F.filter(F.concat(*lists, own), lambda x: F.size(words(x)).between(2, 12))
        return long

    def evidence_phrases(self) -> Column:
        """Phrases of 2 to 12 words, distinct but for case, in order of first occurrence."""
        return distinct_but_for_case(self._phrases(("camera", "temporal_progression", "setting")))

    def background_phrases(self, noise: str = rules.FRAMING_PATTERN) -> Column:
        """The same without the fields on camera and time, and without phrases on framing."""
        return distinct_but_for_case(F.filter(self._phrases(("setting",)), lambda x: ~F.rlike(F.lower(x), F.lit(f"{START}({noise}){END}"))))

    def formal(self, budget: int = 292, most: int = 4) -> Column:
        """The summary and the first phrases that say something new, within a budget of characters.

        A phrase counts as new if none of its words of more than four letters is in the summary or in a phrase picked before.
        """
        base = F.rtrim(F.trim(self.text("summary")), F.lit("."))
        tidy = F.transform(self.background_phrases(), lambda x: one_space(F.rtrim(F.trim(x), F.lit("."))))
        short = F.filter(tidy, lambda x: (x != "") & (F.size(words(x)) <= 8))
        start = F.struct(F.lower(base).alias("present"), F.array().cast("array<string>").alias("picked"))

        def pick(acc: Column, x: Column) -> Column:
            known = F.exists(F.split(F.lower(x), " "), lambda w: (F.char_length(w) > 4) & F.contains(acc.present, w))
            seen = (F.lower(x) == F.lower(base)) | F.exists(acc.picked, lambda p: F.lower(p) == F.lower(x))
            more = F.struct(F.concat(acc.present, F.lit(" "), F.lower(x)).alias("present"), F.array_append(acc.picked, x).alias("picked"))
            return F.when((F.size(acc.picked) >= most) | known | seen, acc).otherwise(more)

        picked = F.aggregate(short, start, pick, lambda acc: acc.picked)
        kept = F.transform(within_budget(picked, F.lit(budget - len(" Also visible: .")) - F.char_length(base) - 1, most), lambda x: lower_lead(x))

        def told(k: Column) -> Column:
            n = F.size(k)
            detail = F.when(n == 1, F.get(k, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(k, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(k, F.lit(-1))))
            return F.when(n == 0, F.concat(base, F.lit("."))).otherwise(F.concat(base, F.lit(". Also visible: "), detail, F.lit(".")))

        return F.when(base == "", F.lit("")).otherwise(let(kept, told))

    def enriched(self, caption: Column, enough: int = 34, budget: int = 292, most: int = 3) -> Column:
        """A caption of fewer words than enough, with phrases that it lacks appended within the budget."""
        low = F.lower(caption)
        tidy = F.transform(self.background_phrases(), lambda x: F.rtrim(F.trim(x), F.lit(".")))
        fresh = F.filter(tidy, lambda x: (x != "") & (F.size(words(x)) <= 8) & ~F.contains(low, F.lower(x)) & ~F.exists(F.split(F.lower(x), " "), lambda w: (F.char_length(w) > 4) & F.contains(low, w)))
        cut = F.rtrim(caption)
        joined = F.when(F.endswith(cut, F.lit(".")), cut).otherwise(F.concat(cut, F.lit(".")))
        kept = F.transform(within_budget(distinct_but_for_case(fresh), F.lit(budget - len(" In the background, .")) - F.char_length(joined), most), lambda x: lower_lead(x))
        told = let(kept, lambda k: F.when(F.size(k) == 0, caption).otherwise(F.concat(joined, F.lit(" In the background, "), _three(k), F.lit("."))))
        return F.when(word_count(caption) >= enough, caption).otherwise(told)

    def formal_or(self, caption: Column, enough: int = 20) -> Column:
        """The built formal caption if it has enough words, else the given one, enriched."""
        return let(self.formal(), lambda built: F.when(word_count(built) >= enough, built).otherwise(self.enriched(caption)))

    def evidence_caption(self, style: Column, caption: Column, cap: int = 300) -> Column:
        """Formal captions only: the summary and the first three phrases that it lacks."""
        own = F.rtrim(F.trim(self.text("summary")), F.lit("."))
        base = F.when(F.trim(self.text("summary")) != "", own).otherwise(F.rtrim(F.trim(caption), F.lit(".")))
        lacking = F.slice(F.filter(self.evidence_phrases(), lambda x: ~F.contains(F.lower(base), F.lower(x))), 1, 3)
        told = let(lacking, lambda k: F.when(F.size(k) == 0, caption).otherwise(F.trim(F.left(F.concat(base, F.lit(", with "), _three(k), F.lit(".")), F.lit(cap)))))
        return F.when(style != "formal", caption).otherwise(told)

    def issues(self, style: Column, caption: Column, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, terms: Column | None = None) -> Column:
        """Codes of what a caption lacks; ``terms`` as in ``graded``."""
        least, anchors, _, _ = _by_style(style)
        known = self.evidence_terms(stop) if terms is None else terms

        def codes(found: Column) -> Column:
            lacks_tech = (style == "humorous_tech") & ~F.arrays_overlap(found, F.array(*map(F.lit, clear)))
            return F.array_compact(F.array(F.when(word_count(caption) < least, _CODES[0]), F.when(F.size(F.array_intersect(found, known)) < anchors, _CODES[1]), F.when(lacks_tech, _CODES[2])))

        return let(evidence_tokens(caption, stop), codes)

    def anchors(self, caption: Column, stop: Sequence[str] = rules.STOP_WORDS) -> Column:
        return F.size(F.array_intersect(evidence_tokens(caption, stop), self.evidence_terms(stop)))

    def graded(self, style: Column, caption: Column, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, terms: Column | None = None) -> Column:
        """A struct of ``value``, length and anchors, each up to 1, less a fifth for every issue, and ``n_issues``.

        Words and anchors beyond those of a full score change nothing. So words are counted up to that, and anchors are first sought among the opening
        words of caption and facts; where these don't hold enough, among all. ``terms`` are those of ``evidence_terms``, where a column holds them already.
        """
        least, enough, length, anchors = _by_style(style)
        clear_terms = F.array(*map(F.lit, clear))
        opening = evidence_tokens(_opening(caption), stop)
        met = lambda found, known: F.size(F.array_intersect(found, known))
        few = met(opening, self.evidence_terms(stop, opening=True) if terms is None else F.slice(terms, 1, _OPENING))
        every = met(evidence_tokens(caption, stop), self.evidence_terms(stop) if terms is None else terms)
        shared = let(few, lambda m: F.when(m >= F.greatest(anchors, enough), m).otherwise(every))
        lacks_tech = (style == "humorous_tech") & ~(F.arrays_overlap(opening, clear_terms) | F.arrays_overlap(evidence_tokens(caption, stop), clear_terms))

        def value(n: Column, shared: Column, issues: Column) -> Column:
            return F.struct((F.least(n / length, F.lit(1.0)) + F.least(shared / anchors, F.lit(1.0)) - issues * 0.2).alias("value"), issues.alias("n_issues"))

        def judged(n: Column, shared: Column) -> Column:
            return let((n < least).cast("int") + (shared < enough).cast("int") + lacks_tech.cast("int"), lambda issues: value(n, shared, issues))

        return let(word_count(caption, _MOST_WORDS), lambda n: let(shared, lambda m: judged(n, m)))

    def evidence_score(self, style: Column, caption: Column, clear: Sequence[str] = rules.CLEAR_TECH_WORDS, stop: Sequence[str] = rules.STOP_WORDS, terms: Column | None = None, **lists) -> Column:
        """The graded value; -10 for a caption that breaks a style rule."""
        return F.when(style_passes(style, caption, **lists), self.graded(style, caption, clear, stop, terms)["value"]).otherwise(F.lit(-10.0))

    def scene(self, most: int = 180) -> Column:
        """The first characters of the summary, without its full stop."""
        return F.left(F.rtrim(F.trim(self.text("summary")), F.lit(".")), F.lit(most))

    def fallback(self, style: Column, static: dict[str, str] | None = None, grounded: dict[str, tuple[str, str]] | None = None) -> Column:
        """A caption by template: from the summary, else from the first words of the facts, else a fixed one."""
        static, grounded = static or rules.STATIC_FALLBACKS, grounded or rules.GROUNDED_FALLBACKS
        scene = self.scene()
        details = F.transform(F.concat(*(self.items(f) for f in ("visual_details", "fine_grained_observations", "salient_objects"))), lambda x: F.rtrim(F.trim(x), F.lit(".")))
        extra = F.slice(F.filter(details, lambda x: ~F.contains(F.lower(scene), F.lower(x))), 1, 2)
        formal = F.when(F.size(extra) > 0, F.left(F.concat(scene, F.lit(", with "), F.array_join(extra, " and "), F.lit(".")), F.lit(300))).otherwise(F.concat(scene, F.lit(".")))
        phrase = self.first_words(26)
        from_scene, from_words = F.when(style == "formal", formal), F.when(style == "formal", F.concat(F.lit("In view: "), phrase, F.lit(".")))
        for s, (before, after) in grounded.items():
            from_scene = from_scene.when(style == s, F.concat(F.lit(before), F.lower(scene) if before else scene, F.lit(after)))
            from_words = from_words.when(style == s, F.concat(F.lit(before), phrase, F.lit(after)))
        return F.coalesce(F.when(scene != "", from_scene), F.when(phrase != "", from_words), static_fallback(style, static))


def _opening(text: Column) -> Column:
    """The text up to a space; no evidence token crosses one."""
    return F.substring_index(text, " ", _OPENING)


def static_fallback(style: Column, static: dict[str, str] | None = None) -> Column:
    """The fixed caption of a style; an unknown style gets the formal one."""
    static = static or rules.STATIC_FALLBACKS
    return reduce(lambda c, s: c.when(style == s, static[s]), static, F.when(F.lit(False), "")).otherwise(static["formal"])


def _three(items: Column) -> Column:
    """One to three items: "a", "a and b", "a, b, and c"."""
    return F.when(F.size(items) <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, 1, 2), ", "), F.lit(", and "), F.try_element_at(items, F.lit(-1))))


def _by_style(style: Column) -> list[Column]:
    rows = rules.EVIDENCE
    return [reduce(lambda c, s: c.when(style == s, rows[s][i]), rows, F.when(F.lit(False), 0)).otherwise(rules.EVIDENCE_OTHERWISE[i]) for i in range(4)]


def distinct_but_for_case(items: Column) -> Column:
    """Items in order of first occurrence, those that differ only in case once."""
    once = lambda all_, low: F.filter(all_, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return let(items, lambda a: let(F.transform(a, lambda x: F.lower(x)), lambda low: once(a, low)))


def within_budget(items: Column, budget: Column, most: int) -> Column:
    """The first items whose lengths, plus two each, stay within the budget; the first overflow ends it."""
    start = F.struct(budget.cast("int").alias("room"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        left = acc.room - F.char_length(x) - 2
        over = acc.full | (left < 0) | (F.size(acc.kept) >= most)
        return F.struct(F.when(over, acc.room).otherwise(left).cast("int").alias("room"), over.alias("full"), F.when(over, acc.kept).otherwise(F.array_append(acc.kept, x)).alias("kept"))

    return F.aggregate(items, start, take, lambda acc: acc.kept)
