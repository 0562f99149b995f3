"""Model calls as distributed batch jobs: one call per distinct prompt, errors as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import judge_score
from .ordered import small

Model = Callable[[list[str]], list[str]]


def _calls(model: Model, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):  # a batch stays in Arrow's buffers; only the prompts of one call become strings
                prompts = b.column("prompt").slice(at, size).to_pylist()
                try:
                    texts, errors = model(prompts), [None] * len(prompts)
                except Exception:  # noqa: BLE001  a failed batch is called row by row
                    texts, errors = [], []
                    for prompt in prompts:
                        try:
                            texts.append(model([prompt])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            texts.append(None)
                            errors.append(type(e).__name__)
                ok = [x is None and bool((t or "").strip()) for x, t in zip(errors, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, size), pa.array(ok, pa.bool_()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["key", "ok", "text", "error"])

    return run


def generate(prompts: DataFrame, model: Model, parallel: int = 0, size: int = 64, asked: DataFrame | None = None) -> DataFrame:
    """Rows (prompt, ...) with ok, text and error of the model's reply; equal prompts are called once.

    ``parallel`` bounds the calls at a time; 0 leaves it to the shuffle. Replies that are blank are not ok.
    ``asked`` has the same prompts where they are cheaper to get at than in rows that were joined.
    """
    keyed = prompts.withColumn("key", F.sha2("prompt", 256))
    once = (keyed if asked is None else asked.withColumn("key", F.sha2("prompt", 256))).select("key", "prompt").dropDuplicates(["key"])
    once = once.repartition(parallel, "key") if parallel else once
    replies = once.mapInArrow(_calls(model, size), "key string, ok boolean, text string, error string")
    return keyed.join(replies, "key").drop("key")


#: What a style's rule holds: the system text, example pairs and the template of the last message, in which {facts} stands for the facts.
STYLE_RULES = "style string, system string, shots array<struct<user: string, reply: string>>, template string"


def style_prompts(rows: DataFrame, table: DataFrame, facts: Column) -> DataFrame:
    """``rows`` (style, ...) with prompt: the style's rule of ``table`` filled with the facts; null for a style without a rule."""
    shots = F.transform("shots", lambda s: F.concat(F.lit("\n<user>\n"), s["user"], F.lit("\n<assistant>\n"), s["reply"]))
    filled = F.replace("template", F.lit("{facts}"), facts)
    prompt = F.concat(F.lit("<system>\n"), F.col("system"), F.array_join(shots, ""), F.lit("\n<user>\n"), filled)
    return rows.join(small(table), "style", "left").select(*rows.columns, prompt.alias("prompt"))


def write_styles(rows: DataFrame, table: DataFrame, facts: Column, model: Model, fallback: Column, neutral: Column, **kw) -> DataFrame:
    """``rows`` with the caption that their style's rule gets from the model, and how it came (``way``): model, failed or no rule.

    A call that fails gets the ``fallback`` caption. A style without a rule calls no model and gets the ``neutral`` one.
    """
    asked = style_prompts(rows.withColumns({"_fallback": fallback, "_neutral": neutral}), table, facts)
    called = generate(asked.filter("prompt is not null"), model, **kw)
    done = called.select(*rows.columns, F.when(F.col("ok"), F.trim("text")).otherwise(F.col("_fallback")).alias("written"), F.when(F.col("ok"), "model").otherwise("failed").alias("way"))
    return done.unionByName(asked.filter("prompt is null").select(*rows.columns, F.col("_neutral").alias("written"), F.lit("no rule").alias("way")))


def judge(prompts: DataFrame, model: Model, **kw) -> DataFrame:
    """generate() with the verdict parsed into accuracy and style; null where there is none."""
    return generate(prompts, model, **kw).withColumn("verdict", judge_score(F.col("text"))).select("*", "verdict.accuracy", "verdict.style").drop("verdict")
