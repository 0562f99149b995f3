"""Training sets: balanced draws, seeded choices, style writers, chat texts and prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import human_list
from .ordered import ranked, small


def seeded(seed: str, *parts: Column | str) -> Column:
    """A hex digest of the seed and the parts: an order or a choice that no partitioning changes."""
    return F.md5(F.concat_ws("/", F.lit(seed), *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts)))


def choice(seed: str, n: Column | int, *parts: Column | str) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.conv(F.left(seeded(seed, *parts), F.lit(8)), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def balanced_draw(df: DataFrame, category: str, n: int, seed: str, key: str) -> DataFrame:
    """n rows over the k categories: n // k of each, and one more of the first n mod k by name.

    No task sorts a whole category: every task first keeps no more of it than the largest quota.
    """
    names = ranked(df.select(category).distinct(), [], [category], "_cat")
    total = names.count()
    quota = small(names.select(F.col(category).alias("_of"), (F.lit(n // max(1, total)) + F.when(F.col("_cat") <= n % max(1, total), 1).otherwise(0)).alias("_quota")))
    order = F.row_number().over(Window.partitionBy(category).orderBy(seeded(seed, key), key))
    drawn = df.withColumn("_n", order).filter(F.col("_n") <= n // max(1, total) + 1)
    return drawn.join(quota, drawn[category].eqNullSafe(quota["_of"])).filter(F.col("_n") <= F.col("_quota")).drop("_of", "_quota", "_n")


def shuffled(df: DataFrame, keys: Sequence[str], seed: str, key: str, place: str = "place") -> DataFrame:
    """``df`` with the place of each row in a seeded order of its keys, from 1; no task holds all rows of a key."""
    return ranked(df.withColumn("_seeded", seeded(seed, key)), keys, ["_seeded", key], place).drop("_seeded")


def cycled(pool: DataFrame, order: str, quota: int) -> DataFrame:
    """``quota`` rows from a pool, from its first on and over again; ``slot`` counts from 0."""
    places = ranked(pool, [], [order], "_place")
    slots = pool.sparkSession.range(quota).select(F.col("id").alias("slot"), (F.pmod("id", F.lit(max(1, pool.count()))) + 1).alias("_place"))
    return slots.join(small(places), "_place").drop("_place")


def cross_styles(df: DataFrame, styles: Sequence[str]) -> DataFrame:
    """Every row once for each style."""
    return df.select("*", F.explode(F.array(*map(F.lit, styles))).alias("style"))


def write_caption(style: Column, subjects: Column, action: Column, setting: Column, mood: Column, seed: str, key: str) -> Column:
    """A caption by template; an unknown style gives an empty one."""
    who = human_list(subjects, "the subject")
    what = F.coalesce(F.nullif(F.trim(action), F.lit("")), F.lit("moving through the frame"))
    where = F.coalesce(F.nullif(F.trim(setting), F.lit("")), F.lit("an open space"))
    tone = F.coalesce(F.nullif(F.trim(mood), F.lit("")), F.lit("calm"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (choice(seed, len(xs), key, style) + 1).cast("int"))
    return (
        F.when(style == "formal", F.concat(pick("Here one finds ", "Visible are, in this order, ", "On view: "), who, F.lit(", "), what, F.lit(" in "), where, F.lit(", with a "), tone, F.lit(" mood.")))
        .when(style == "sarcastic", F.concat(pick("Of course ", "Naturally, ", "As everybody had hoped, "), who, F.lit(" spent the day "), what, F.lit(" in "), where, F.lit(", and the world held its breath.")))
        .when(style == "humorous_tech", F.concat(pick("Deployed to production: ", "Pipeline passed: ", "Hotfix shipped: "), who, F.lit(", "), what, F.lit(" in "), where, F.lit(" with zero downtime.")))
        .when(style == "humorous_non_tech", F.concat(pick("Breaking news from the sofa: ", "Meanwhile, in slow motion: ", "Somebody tell grandma: "), who, F.lit(" is "), what, F.lit(" in "), where, F.lit(" again.")))
        .otherwise("")
    )


def mock_results(tasks: DataFrame, seed: str, styles: Sequence[str] = rules.STYLES) -> DataFrame:
    """Results without a model, to try what follows: ``tasks(task_id, styles)`` with captions by template from placeholder facts of the task id.

    Null or empty styles mean all of ``styles``; each style comes once; an unknown one has an empty caption.
    """
    wanted = F.array_compact(F.array_distinct("styles"))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(*map(F.lit, styles)))
    subjects = F.array(F.concat(F.lit("thing "), F.col("task_id").cast("string")), F.lit("one more"))
    caption = lambda s: write_caption(s, subjects, F.lit("moving"), F.lit("some place"), F.lit("neutral"), seed, "task_id")
    return tasks.withColumn("_wanted", wanted).select("task_id", F.map_from_arrays("_wanted", F.transform("_wanted", caption)).alias("captions"))


def valid_caption(style: Column, caption: Column, banned: dict[str, Sequence[str]], least: int = 15, most: int = 260) -> Column:
    """Length within bounds and none of the style's banned substrings."""
    out = F.char_length(caption).between(least, most)
    for s, terms in banned.items():
        out = out & ~((style == s) & F.rlike(F.lower(caption), F.lit("|".join(terms))))
    return out


def chat_text(system: Column | str, user: Column, reply: Column) -> Column:
    return F.concat(F.lit("<system>\n"), F.lit(system) if isinstance(system, str) else system, F.lit("\n<user>\n"), user, F.lit("\n<assistant>\n"), reply)


def messages(system: str, shots: Sequence[tuple[str, str]], final: Column) -> Column:
    """System message, example pairs and the final user message as array<struct<role, content>>."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), (F.lit(text) if isinstance(text, str) else text).alias("content"))
    return F.array(one("system", system), *(one(r, t) for q, a in shots for r, t in (("user", q), ("assistant", a))), one("user", final))


def judge_prompt(style: Column, definition: Column, caption: Column) -> Column:
    return F.format_string("Style: %s\nDefinition: %s\nCaption: %s\nRate accuracy and style from 0 to 1.", style, definition, caption)


def repair_prompt(caption: Column, codes: Column, terms: Column, most: int = 14) -> Column:
    return F.concat(F.lit("Caption:\n"), caption, F.lit("\nIssues: "), F.array_join(codes, ", "), F.lit(".\nEvidence: "), F.array_join(F.slice(terms, 1, most), ", "), F.lit("."))


def observation_blocks(details: DataFrame, task: str, model: str, position: str, text: str) -> DataFrame:
    """Per task, one block for each model: a header with the count, then bulleted details; blocks parted by blank lines."""
    own = details.groupBy(task, model).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: F.concat(F.lit("- "), x[text])), "\n").alias("lines"))
    block = F.concat(F.col(model), F.lit(" ("), F.col("n").cast("string"), F.lit("):\n"), F.col("lines"))
    return own.groupBy(task).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), block.alias("b")))), lambda x: x.b), "\n\n").alias("blocks"))
