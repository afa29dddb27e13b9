"""Paired tests, intervals, corrections and agreement of raters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.operators.ordered import running

#: Trials, and draws that are in memory at once: few enough for a processor's cache.
TRIALS, DRAWS = 10_000, 131_072
#: Tasks that resampling is spread over.
TASKS = 64


def paired(metrics: DataFrame, pairs: DataFrame, item: str = "question_id") -> DataFrame:
    """(a, b, item, diff, va, vb) of the items that both setups of a pair have.

    metrics are (setup, item, value), pairs (a, b).
    """
    first = metrics.select(F.col("setup").alias("a"), item, F.col("value").alias("va"))
    second = metrics.select(F.col("setup").alias("b"), item, F.col("value").alias("vb"))
    return pairs.join(first, "a").join(second, ["b", item]).select("a", "b", item, "va", "vb", (F.col("va") - F.col("vb")).alias("diff"))


def means(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg("diff").alias("difference"))


def randomisation(diffs: np.ndarray, trials: int = TRIALS, seed: int = 1) -> float:
    """p-value of the mean under random signs, two-sided, with one added to both counts."""
    rng, observed, extreme = np.random.default_rng(seed), abs(diffs.mean()), 0
    batch = max(1, DRAWS // len(diffs))  # the draws go on from batch to batch, so they are the same for any
    for first in range(0, trials, batch):
        signs = rng.choice([-1.0, 1.0], (min(batch, trials - first), len(diffs)))
        extreme += int((np.abs((signs * diffs).mean(axis=1)) >= observed - 1e-12).sum())
    return (extreme + 1) / (trials + 1)


def bootstrap(values: np.ndarray, trials: int = TRIALS, seed: int = 1, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean."""
    rng, found = np.random.default_rng(seed), []
    batch = max(1, DRAWS // len(values))
    for first in range(0, trials, batch):
        found.append(values[rng.integers(0, len(values), (min(batch, trials - first), len(values)))].mean(axis=1))
    low, high = np.quantile(np.concatenate(found), [(1 - level) / 2, (1 + level) / 2])
    return float(low), float(high)


def compare(metrics: DataFrame, pairs: DataFrame, trials: int = TRIALS, seed: int = 1) -> DataFrame:
    """Means, interval, p-value and its Holm correction of every pair of setups.

    One group is one pair's shared items, of as many rows as there are questions.
    """

    def test(key, group: pd.DataFrame) -> pd.DataFrame:
        diffs = group.sort_values("question_id")["diff"].to_numpy()
        (low, high), p = (bootstrap(diffs, trials, seed), None) if key[2] == "interval" else ((None, None), randomisation(diffs, trials, seed))
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "ci_low": [low], "ci_high": [high], "p_value": [p]}).astype({c: float for c in ("ci_low", "ci_high", "p_value")})

    rows = paired(metrics, pairs)
    # each pair's interval and p-value are draws one after another: they get tasks of their own
    apart = rows.withColumn("what", F.explode(F.array(F.lit("interval"), F.lit("p")))).repartition(TASKS, "a", "b", "what")
    tested = apart.groupBy("a", "b", "what").applyInPandas(test, "a string, b string, ci_low double, ci_high double, p_value double")
    tested = tested.groupBy("a", "b").agg(*[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in ("ci_low", "ci_high", "p_value")])
    return holm(means(rows).join(tested, ["a", "b"]), "p_value", ["a", "b"])


def holm(rows: DataFrame, p: str, keys: list[str], family: list[str] | None = None) -> DataFrame:
    """``p_holm``: the running maximum of min(1, (m - i) p) in order of p, then of the keys."""
    one = [F.col(c) for c in family] if family else [F.lit(0)]
    order = Window.partitionBy(*one).orderBy(p, *keys)
    stepped = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*one)) - F.row_number().over(order) + 1) * F.col(p))
    return rows.withColumn("_step", stepped).withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def hashed_bit(*parts: Column) -> Column:
    """True for half of the keys, by MD5: the same in every engine."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 1) < "8"


def randomisation_by_hash(pairs: DataFrame, trials: int, item: str = "question_id") -> DataFrame:
    """The randomisation test with signs from MD5, for few trials: (a, b, n, observed, p_value).

    Signed sums of all trials are columns of one aggregation: nothing is exploded.
    """
    sums = [F.sum(F.when(hashed_bit(F.col(item).cast("string"), F.lit(str(t))), F.col("diff")).otherwise(-F.col("diff"))) for t in range(trials)]
    one = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("diff").alias("observed"), F.array(*sums).alias("sums"))
    extreme = F.size(F.filter("sums", lambda s: F.abs(s / F.col("n")) >= F.abs(F.col("observed")) - 1e-9))
    return one.select("a", "b", "n", "observed", ((extreme + 1) / (trials + 1)).alias("p_value"))


def kappa(rows: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """(items, observed, expected, kappa) of two raters; kappa is null where chance is certain.

    Rows that lack a label are left out.
    """
    keys = keys or []
    cells = confusion(rows, first, second, keys)
    total = Window.partitionBy(*(keys or [F.lit(0)]))
    sides = cells.withColumn("items", F.sum("n").over(total))
    a = sides.groupBy(*keys, "items", F.col("first").alias("label")).agg(F.sum("n").alias("na"))
    b = sides.groupBy(*keys, F.col("second").alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, [*keys, "label"], "left").groupBy(*keys, "items").agg(F.sum(F.coalesce("nb", F.lit(0)) * F.col("na")).alias("both"))
    same = cells.groupBy(*keys).agg(F.sum(F.when(F.col("first") == F.col("second"), F.col("n")).otherwise(0)).alias("same"))
    joined = chance.join(same, keys) if keys else chance.join(same)
    observed, expected = F.col("same") / F.col("items"), F.col("both") / (F.col("items").cast("double") * F.col("items"))
    return joined.select(*keys, "items", observed.alias("observed"), expected.alias("expected")).withColumn(
        "kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected")))
    )


def confusion(rows: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """(first, second, n): how often the raters gave each pair of labels."""
    both = rows.select(*(keys or []), F.col(first).alias("first"), F.col(second).alias("second")).where("first IS NOT NULL AND second IS NOT NULL")
    return both.groupBy(*(keys or []), "first", "second").agg(F.count("*").alias("n"))


def kappa_bootstrap(cells: DataFrame, trials: int = 2_000, seed: int = 1) -> DataFrame:
    """(kappa_low, kappa_high) from resampling a confusion table: multinomial draws over its
    cells, so that the items themselves are not needed. Undefined resamples are left out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["first"], *group["second"]})
        table = np.zeros((len(names), len(names)))
        for r in group.itertuples():
            table[names.index(r.first), names.index(r.second)] = r.n
        n = int(table.sum())
        draws = np.random.default_rng(seed).multinomial(n, (table / n).ravel(), trials).reshape(trials, len(names), len(names)) / n
        draws = np.concatenate((draws, table[None] / n))
        po, pe = np.trace(draws, axis1=1, axis2=2), (draws.sum(1) * draws.sum(2)).sum(1)
        ok = pe < 1
        found = (po[ok] - pe[ok]) / (1 - pe[ok])
        known = found[:-1] if len(found) > 1 else found
        low, high = np.quantile(known, [0.025, 0.975]) if len(known) else (np.nan, np.nan)
        return pd.DataFrame({"kappa_low": [low], "kappa_high": [high]})

    return cells.groupBy().applyInPandas(run, "kappa_low double, kappa_high double")


def roc_auc(rows: DataFrame, score: str, positive: str, keys: list[str] | None = None) -> DataFrame:
    """(positives, negatives, auc); ties count half; null where a class is missing.

    Scores are counted first, so ranks are sums over distinct scores.
    """
    keys = keys or []
    counted = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q")
    )
    won = running(counted, keys, ["s"], upto="q").withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2.0))
    sums = won.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("won").alias("won"))
    return sums.select(*keys, "positives", "negatives", F.try_divide(F.col("won"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"))
