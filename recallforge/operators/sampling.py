"""Seeded samples. Draws order rows by MD5 of seed and id: the same on any cluster and engine.

``draw_like_python`` gives the draws of Python's generator, for samples made elsewhere.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(id_col: Column, seed: int = 1) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def quotas(rows: DataFrame, stratum: str, size: int) -> DataFrame:
    """(stratum, n, quota): largest remainders. Leftovers go to the greatest fractions, of equals
    to the smaller stratum. Null is a stratum of its own."""
    counted = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(whole)
    exact = F.least(F.lit(size), total) * F.col("n") / total
    parts = counted.withColumn("floor", F.floor(exact)).withColumn("fraction", F.round(exact - F.floor(exact), 9)).withColumn("left", F.least(F.lit(size), total) - F.sum(F.floor(exact)).over(whole))
    order = whole.orderBy(F.desc("fraction"), F.col(stratum).asc_nulls_first())
    return parts.withColumn("at", F.row_number().over(order)).select(stratum, "n", (F.col("floor") + F.when(F.col("at") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def stratified(rows: DataFrame, stratum: str, id_col: str, size: int, seed: int = 1) -> DataFrame:
    """A sample with the quotas of each stratum, drawn by hash."""
    order = Window.partitionBy(stratum).orderBy(draw_key(F.col(id_col), seed), id_col)
    # at most ``size`` strata have a quota, and no stratum needs more rows than that
    quota = quotas(rows, stratum, size).where("quota > 0").withColumnRenamed(stratum, "_s").select("_s", "quota")
    numbered = rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= size)
    return numbered.join(F.broadcast(quota), F.col(stratum).eqNullSafe(F.col("_s"))).where("_at <= quota").drop("_at", "_s", "quota")


def per_group(rows: DataFrame, group: str, id_col: str, size: int, seed: int = 1) -> DataFrame:
    """At most ``size`` rows of each group; the draw depends on the id alone, so groups that
    share ids draw the same ones."""
    order = Window.partitionBy(group).orderBy(draw_key(F.col(id_col), seed), id_col)
    return rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= size).drop("_at")


def first_by_hash(rows: DataFrame, id_col: str, size: int, seed: int = 1) -> DataFrame:
    return rows.orderBy(draw_key(F.col(id_col), seed), id_col).limit(size)


def golden_slice(questions: DataFrame, pages: DataFrame, stratum: str, size: int, distractors: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Sampled questions with pages, and their pages with other pages beside them."""
    asked = stratified(questions.join(pages.select("page_id"), "page_id", "left_semi"), stratum, "question_id", size, seed)
    own = pages.join(asked.select("page_id"), "page_id", "left_semi").withColumn("distractor", F.lit(False))
    other = first_by_hash(pages.join(asked.select("page_id"), "page_id", "left_anti"), "page_id", distractors, seed)
    return asked, own.unionByName(other.withColumn("distractor", F.lit(True)))


def draw_like_python(ids: list[str], size: int, seed: int) -> list[str]:
    """The sample of ``random.Random(seed)`` over sorted ids, sorted; ids are of a bounded set."""
    return sorted(random.Random(seed).sample(sorted(ids), min(size, len(ids))))
