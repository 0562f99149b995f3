"""Chat formatting by prefix-target expansion: one training example for each assistant turn."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the control strings that may not occur inside a role or a text.

    A text is escaped by doubling every backslash and then putting one after the first character of every
    control string. As a doubled backslash never stands where a control string has its single one, the
    two steps can be undone in the opposite order.
    """

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<|", "[INST]", "[/INST]", "<s>", "</s>")

    def escape(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), self.control, doubled)

    def unescape(self, text: Column) -> Column:
        plain = reduce(lambda c, s: F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s)), self.control, text)
        return F.replace(plain, F.lit("\\\\"), F.lit("\\"))

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.turn), self.escape(role), F.lit(self.body), self.escape(text), F.lit(self.end))

    def read(self, formatted: Column) -> Column:
        """The turns of a formatted text: array<struct<role, text>>."""
        parts = F.split(formatted, self.turn.replace("|", "\\|"))
        parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        before, after = lambda p: F.substring_index(p, self.body, 1), lambda p: F.substring_index(F.substring_index(p, self.body, -1), self.end, 1)
        return F.transform(parts, lambda p: F.struct(self.unescape(before(p)).alias("role"), self.unescape(after(p)).alias("text")))


def prefix_target_examples(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Examples of ``conversations(conv_id, turn, role, text)``.

    Every assistant turn gives one row: its text after all turns before it, with only that reply trainable. A
    conversation that ends with another role gives one more row of all its turns, with nothing
    trainable, so that no turn is lost. Columns: conv_id, example (from 0), target_turn, formatted,
    loss_start (0-based offset in ``formatted``), loss_length (code points; 0: nothing trainable), last.

    Turns are in the order of turn, then role, then text; nulls come first. A null role or text is an
    empty string; rows with a null conv_id are one conversation; repeated rows are turns of their own; an empty
    table gives no rows. Further columns are ignored.

    The examples of a conversation are prefixes of one string: it is built once, and each example cuts
    its own out after the rows are dealt, so that no more than one example is held beside it.
    """
    t = template or Template()
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("rendered", t.render(F.col("role"), F.col("text")))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("stop", F.sum(F.char_length("rendered")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.char_length(t.escape(F.col("text")))
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "rendered"))).alias("turns"),
        F.max("place").alias("size"),
        F.array_sort(F.collect_list(F.struct("place", "turn", "stop", (F.col("role") == "assistant").alias("trainable"), length.alias("length")))).alias("targets"),
    )
    whole = turns.select("conv_id", "size", F.array_join(F.transform("turns", lambda x: x.rendered), "").alias("whole"), F.filter("targets", lambda x: x.trainable | (x.place == F.col("size"))).alias("targets"))
    each = whole.select("conv_id", "size", "whole", F.posexplode("targets").alias("example", "target"))
    cut = F.col("target.stop").cast("int")
    return each.select(
        "conv_id",
        "example",
        F.col("target.turn").alias("target_turn"),
        F.substring("whole", F.lit(1), cut).alias("formatted"),
        (cut - len(t.end) - F.col("target.length")).alias("loss_start"),
        F.when(F.col("target.trainable"), F.col("target.length")).otherwise(0).alias("loss_length"),
        (F.col("target.place") == F.col("size")).alias("last"),
    )


def read_back(examples: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, what its examples hold: turns of the last one, and the text under all loss masks."""
    t = template or Template()
    turns = F.when(F.col("last"), t.read(F.col("formatted")))
    loss = t.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    each = examples.select(
        "conv_id",
        "example",
        F.size(turns).cast("long").alias("turns"),
        F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("digest"),
        loss.alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    losses = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    return each.groupBy("conv_id").agg(
        F.max("turns").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.sum(F.char_length("loss")).cast("long").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )
