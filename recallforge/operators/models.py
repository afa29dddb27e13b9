"""Where models are called: writers and judges over Arrow batches, with caches of their replies.

A writer takes questions and lists of passages and gives texts; a judge takes prompts and gives
labels of its rubric. Both are plain functions, called once for each distinct request.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.session import cut_lineage
from recallforge.sources.files import Cache

#: Labels that judges may give.
GROUNDEDNESS, CORRECTNESS = ("supported", "partial", "unsupported"), ("correct", "incorrect")


def request_key(*parts) -> Column:
    """Digest of a request; the model's name and version belong to its parts."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def call(requests: DataFrame, model: Callable[[list[str]], list[str]], cache: Cache | None = None, fresh: bool = False) -> DataFrame:
    """(key, prompt) -> (key, value): replies to distinct requests, those in the cache not asked again.

    ``fresh`` asks all and leaves the cache as it is.
    """
    distinct = requests.select("key", "prompt").dropDuplicates(["key"])
    known = None if cache is None or fresh else cache.get()
    new = distinct if known is None else distinct.join(known, "key", "left_anti")

    def run(batches):
        for b in batches:
            yield b[["key"]].assign(value=model(b["prompt"].tolist()))

    # written once: else every look at the replies would ask the model again
    replies = cut_lineage(new.mapInPandas(run, "key string, value string"))
    if cache is None or fresh:
        return replies
    cache.put(replies)
    return distinct.select("key").join(cache.get(), "key")


def write_answers(questions: DataFrame, model: Callable, name: str, cache: Cache | None = None, fresh: bool = False) -> DataFrame:
    """(setup, question_id, question, passages) with ``text`` and ``declined``."""
    asked = questions.withColumn("prompt", tx.answer_prompt(F.col("question"), F.col("passages"))).withColumn("key", request_key(F.lit(name), "prompt"))
    written = asked.join(call(asked, model, cache, fresh), "key", "left").withColumnRenamed("value", "text")
    return written.withColumn("declined", tx.is_declined(F.coalesce("text", F.lit("")))).drop("prompt", "key")


def judge_answers(answers: DataFrame, model: Callable, name: str, labels: tuple[str, ...] = GROUNDEDNESS, cache: Cache | None = None) -> DataFrame:
    """answer rows with ``verdict``; declined answers are not judged, a label outside the rubric raises.

    As many calls run at once as there are tasks; the first error ends the job.
    """
    prompt = tx.groundedness_prompt(F.col("question"), F.col("passages"), F.col("text")) if labels == GROUNDEDNESS else tx.correctness_prompt(F.col("question"), F.col("references"), F.col("text"))
    asked = answers.withColumn("prompt", F.when(~F.col("declined"), prompt)).withColumn("key", request_key(F.lit(name), "prompt"))
    told = call(asked.where("prompt IS NOT NULL"), model, cache)
    verdict = F.when(F.col("value").isNull() | F.col("value").isin(*labels), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a label of the rubric: "), "value")))
    return asked.join(told, "key", "left").withColumn("verdict", verdict).drop("prompt", "key", "value")


def extractive_writer(prompts: list[str]) -> list[str]:
    """Stand-in writer: the passage line with the most words of the question."""
    out = []
    for prompt in prompts:
        passages, _, question = prompt.rpartition("\n\nQuestion: ")
        asked = set(re.findall(r"\w+", question.lower()))
        lines = [x for x in passages.split("\n")[1:] if x and not x.startswith("[")]
        out.append(max(lines, key=lambda x: len(asked & set(re.findall(r"\w+", x.lower()))), default="I don't know"))
    return out


def overlap_judge(prompts: list[str]) -> list[str]:
    """Stand-in judge of groundedness: by the share of the answer's words in the passages."""
    out = []
    for prompt in prompts:
        read, _, answer = prompt.rpartition("\n\nAnswer: ")
        said, there = set(re.findall(r"\w+", answer.lower())), set(re.findall(r"\w+", read.lower()))
        share = len(said & there) / len(said) if said else 1.0
        out.append(GROUNDEDNESS[0 if share == 1 else 1 if share >= 0.5 else 2])
    return out
