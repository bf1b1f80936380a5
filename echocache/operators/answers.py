"""Answers for missed prompts: recorded ones, or a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echocache.functions import text
from echocache.operators.rank import rank_within
from echocache.scratch import materialize

#: Misses of one prompt that are given their answer together, and the most prompts that are cut into parts.
HOT_ROWS, MAX_HOT = 100_000, 1_024


def recorded(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, response) for user turns followed by an assistant turn.

    The next turn is the one with the next larger number, whatever is between. Turns are ranked
    first, so that it is an equi-join; a very long conversation spreads over all tasks, unlike a
    window over the conversation. ``turn`` is unique in its conversation.
    """
    placed = rank_within(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"], "place")
    asked = placed.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("place") + 1).alias("next")
    )
    replied = placed.where("role = 'assistant'").select(
        "conv_id", F.col("place").alias("next"), F.col("text").alias("response")
    )
    return asked.join(replied, ["conv_id", "next"]).drop("next")


def answer_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """One answer per clean prompt: the first recorded one in ``order``."""
    return rows.groupBy(text.clean("prompt").alias("prompt")).agg(
        F.min_by("response", F.struct(*order)).alias("response")
    )


def attach(misses: DataFrame, answers: DataFrame) -> DataFrame:
    """Add ``response`` to each miss; NULL where no answer is recorded.

    A prompt that makes up a large share of the misses meets one answer row. Adaptive skew
    handling splits it, because ``answers`` has unique prompts.
    """
    return misses.join(answers.select("prompt", "response"), "prompt", "left").select(
        *[c for c in misses.columns if c != "response"], "response"
    )


def generate(
    misses: DataFrame, generator: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
) -> DataFrame:
    """Add ``response`` from a user generator that gets batches of prompts, once per miss."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from generator(batches)

    # A model may answer differently when asked again, so Spark must not ask twice.
    return misses.withColumn("response", run.asNondeterministic()("prompt"))


def coalesced(
    misses: DataFrame, answer: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``answer`` asked once for each prompt, by its earliest miss, and given to all misses of that prompt.

    Prompts are clean already. Counts and earliest misses are combined before the shuffle. A prompt with more than
    ``hot_rows`` misses is joined in parts, so that it stays spread over tasks; as a part has at least
    a share of 1 / ``MAX_HOT`` of all misses, the table of such prompts is small enough to be sent to every task.
    """
    first = F.min(F.struct("collection", "seq", "request_id")).alias("first")
    prompts = materialize(misses.groupBy("prompt").agg(first, F.count(F.lit(1)).alias("n")), "prompts")
    total = prompts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part_rows = max(hot_rows, -(-total // MAX_HOT))
    key = ["prompt", "collection", "seq", "request_id"]
    asked = misses.join(prompts.select("prompt", "first.*"), key, "left_semi").select(*misses.columns)
    answers = materialize(answer(asked), "answers").select("prompt", "response").dropDuplicates(["prompt"])
    hot = F.broadcast(
        prompts.where(F.col("n") > part_rows).select("prompt", F.ceil(F.col("n") / part_rows).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    left = misses.drop("response").join(hot, "prompt", "left").withColumn("_part", F.pmod(F.xxhash64("request_id"), parts).cast("int"))
    right = answers.join(hot, "prompt", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right.drop("_parts"), ["prompt", "_part"], "left").select(
        *[c for c in misses.columns if c != "response"], "response"
    )
