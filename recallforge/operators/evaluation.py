"""Relevance judgements and retrieval metrics in long form.

Judgements are (question_id, doc_id, grade), rankings (question_id, rank, doc_id), metrics
(question_id, metric, value). All questions are evaluated in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.operators.ordered import with_percentiles


def span_judgements(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that cover any part of an answer's span: [start, end) overlaps [start, end).

    spans are (question_id, page_id, start, end[, grade]). An equi-join on the page with the
    overlap as residual; the grade of a chunk is the greatest of its spans, 1 without grades.
    """
    grade = F.col("grade") if "grade" in spans.columns else F.lit(1)
    s = spans.select("question_id", "page_id", F.col("start").alias("s0"), F.col("end").alias("s1"), grade.alias("grade"))
    c = chunks.select("page_id", "chunk_id", F.col("start").alias("c0"), F.col("end").alias("c1"))
    met = s.join(c, "page_id").where((F.col("c0") < F.col("s1")) & (F.col("s0") < F.col("c1")))
    return met.groupBy("question_id", F.col("chunk_id").alias("doc_id")).agg(F.max("grade").alias("grade"))


def split_evaluable(questions: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with a relevant document, and those without: listed, never counted as 0."""
    relevant = judgements.where("grade > 0").select("question_id")
    return questions.join(relevant, "question_id", "left_semi"), questions.join(relevant, "question_id", "left_anti")


def check_inputs(ranking: DataFrame, judgements: DataFrame, cutoffs: list[int]) -> None:
    """Raise on cutoffs below 1, documents ranked twice, negative grades and questions without a
    relevant document. Two small actions."""
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("cutoffs must be at least 1")
    if ranking.groupBy("question_id", "doc_id").count().where("count > 1").take(1):
        raise ValueError("a ranking has a document twice")
    bad = judgements.groupBy("question_id").agg(F.min("grade").alias("least"), F.max("grade").alias("most")).where("least < 0 OR most <= 0").take(1)
    if bad:
        raise ValueError(f"question {bad[0].question_id} has a negative grade or no relevant document")


def question_metrics(ranking: DataFrame, judgements: DataFrame, cutoffs: list[int]) -> DataFrame:
    """precision, recall, ndcg and rr at each cutoff, of every judged question.

    precision divides by k, recall by all relevant documents; ndcg has linear gain, a discount
    of log2(rank + 1) and an ideal of all judged documents; rr is 0 without a relevant document
    in the first k. Questions that nothing was ranked for have 0.
    """
    positive = judgements.where("grade > 0")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("grade"), "doc_id"))
    gain = F.col("grade") / F.log2(F.col("place") + 1)
    ideal = positive.withColumn("place", place).groupBy("question_id").agg(
        F.count("*").alias("relevant"), *[F.sum(F.when(F.col("place") <= k, gain)).alias(f"ideal{k}") for k in cutoffs]
    )
    hits = ranking.join(positive, ["question_id", "doc_id"]).where(F.col("rank") <= max(cutoffs))
    found = hits.groupBy("question_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hits{k}") for k in cutoffs],
        *[F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))).alias(f"dcg{k}") for k in cutoffs],
        F.min("rank").alias("first"),
    )
    joined = ideal.join(found, "question_id", "left")
    values: list[Column] = []
    for k in cutoffs:
        n, dcg = F.coalesce(f"hits{k}", F.lit(0)), F.coalesce(f"dcg{k}", F.lit(0.0))
        of = {"precision": n / k, "recall": n / F.col("relevant"), "ndcg": dcg / F.col(f"ideal{k}"), "rr": F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(F.lit(0.0))}
        values += [F.struct(F.lit(f"{m}@{k}").alias("metric"), v.cast("double").alias("value")) for m, v in of.items()]
    return joined.select("question_id", F.inline(F.array(*values)))


def average(metrics: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """(answer_type, metric, value): means over all questions (type null) and over each type,
    in one pass. rr is called mrr once it is averaged."""
    name = F.regexp_replace("metric", "^rr@", "mrr@").alias("metric")
    if questions is None:
        return metrics.groupBy(name).agg(F.avg("value").alias("value"))
    rows = metrics.join(questions.select("question_id", "answer_type"), "question_id").select("answer_type", name, "value")
    # each row counts once for its type and once for all
    rows = rows.select(F.explode(F.array(F.struct(F.col("answer_type").alias("t")), F.struct(F.lit("all").alias("t")))).alias("x"), "metric", "value")
    return rows.groupBy(F.col("x.t").alias("answer_type"), "metric").agg(F.avg("value").alias("value"))


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median (interpolated), p95 (nearest rank) and max of each key."""
    found = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_percentiles(found, rows, keys, value)
