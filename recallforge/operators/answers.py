"""Written answers: summaries, verdicts, costs, agreement with people, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.functions.stem import stem
from recallforge.operators import stats
from recallforge.operators.ordered import running, with_percentiles
from recallforge.session import cut_lineage

# Cut-offs of support, and prices per million tokens.
NLI_CUTOFF, LEXICAL_CUTOFF = 0.5, 1.0
PER_INPUT, PER_OUTPUT = 0.10, 0.50


def share(count: Column, of: Column) -> Column:
    """count / of; 0 of nothing."""
    return F.coalesce(F.try_divide(count, of), F.lit(0.0))


def summary(answers: DataFrame) -> DataFrame:
    """Answers, share declined, tokens and seconds of each setup. Tokens and seconds that are
    null, and negative tokens, count nothing."""
    tokens = [F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(c) for c in ("prompt_tokens", "output_tokens")]
    found = answers.groupBy("setup").agg(
        F.count("*").alias("answers"), share(F.count_if(F.coalesce("declined", F.lit(False))), F.count("*")).alias("declined"), *tokens,
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("mean"),
    )
    return with_percentiles(found, answers, ["setup"], "seconds").na.fill(0.0, ["p50", "p95"])


def scored(answers: DataFrame, references: DataFrame, stems: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """Each answer with whether it contains a reference, its lexical support and, with ``verdicts``
    (answer_id, correctness, groundedness, nli, cost), what judges say of it.

    Declined answers contain nothing, have no support and no verdict (null, not 0) and cost 0.
    answers are (answer_id, setup, question_id, question, text, declined, passages), references
    (question_id, short_answers). With ``stems`` (term, stem) questions, answers, passages and function
    words are compared by their stems.
    """
    gone = tx.is_declined(F.coalesce("text", F.lit(""))) | F.coalesce("declined", F.lit(False))
    said = answers.withColumn("declined", gone).withColumn("text", F.coalesce("text", F.lit("")))
    joined = said.join(references.select("question_id", "short_answers"), "question_id", "left")
    asked, new, there = (tx.tokenize(x) for x in (F.col("question"), F.col("text"), F.array_join(F.coalesce("passages", F.array().cast("array<string>")), " ")))
    if stems is None:
        joined = joined.withColumn("lexical", tx.lexical_support(asked, new, there))
    else:
        # one row for each distinct term of an answer, told where it stands; the vocabulary is joined once
        parts = F.array(*[F.struct(F.lit(n).alias("part"), F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))).alias("terms")) for n, x in ((1, asked), (2, new), (4, there))])
        terms = joined.where(~F.col("declined")).select("answer_id", F.inline(parts)).select("answer_id", "part", F.explode("terms").alias("term"))
        function_words = F.array(*[F.lit(stem(w)) for w in tx.FUNCTION_WORDS])
        placed = terms.join(stems, "term", "left").groupBy("answer_id", F.coalesce("stem", "term").alias("s")).agg(F.bit_or("part").alias("where"))
        fresh = (F.col("where").bitwiseAND(3) == 2) & ~F.array_contains(function_words, F.col("s"))
        counted = placed.groupBy("answer_id").agg(F.count_if(fresh).alias("fresh"), F.count_if(fresh & (F.col("where") == 6)).alias("met"))
        share_met = F.when(F.col("fresh") > 0, F.col("met") / F.col("fresh")).otherwise(F.lit(1.0))
        joined = joined.join(counted.select("answer_id", share_met.alias("lexical")), "answer_id", "left").withColumn("lexical", F.coalesce("lexical", F.lit(1.0)))
    out = joined.select(
        "answer_id", "setup", "question_id", "declined",
        F.when(F.col("declined"), False).otherwise(tx.contains_reference(F.col("text"), F.col("short_answers"))).alias("contains"),
        F.when(~F.col("declined"), F.round("lexical", 9)).alias("lexical"),
    )
    if verdicts is None:
        return out
    told = out.join(verdicts.select("answer_id", "correctness", "groundedness", "nli", "cost"), "answer_id", "left")
    judged = {c: F.when(~F.col("declined"), F.col(c)) for c in ("correctness", "groundedness", "nli")}
    return told.withColumns(judged | {"cost": F.when(F.col("declined"), F.lit(0.0)).otherwise(F.coalesce("cost", F.lit(0.0)))})


def check_agreement(rows: DataFrame, truth: str, checks: dict[str, tuple[Column, Column | None]], keys: list[str] | None = None) -> DataFrame:
    """(check, items, observed, expected, kappa, auc, flagged, caught) of each check against labels.

    A check is (label, score): labels are compared with ``truth`` as they are where the check gives
    the same three levels, and as supported or not where it gives those two. ``flagged`` are items
    that the truth doesn't call supported, ``caught`` those of them that the check doesn't either.
    Rows where truth or check is null are left out; kappa is null where chance is certain, auc where
    a class is missing or the check has no score.
    """
    told = F.array(*[
        F.struct(F.lit(name).alias("check"), label.alias("said"), (score if score is not None else F.lit(None)).cast("double").alias("score"))
        for name, (label, score) in checks.items()
    ])
    long = rows.select(F.col(truth).alias("truth"), F.inline(told)).where("truth IS NOT NULL AND said IS NOT NULL")
    binary = F.col("said").isin("yes", "no")
    long = long.withColumn("meant", F.when(binary, F.when(F.col("truth") == "supported", "yes").otherwise("no")).otherwise(F.col("truth")))
    wrong = F.col("truth") != "supported"
    counts = long.groupBy("check").agg(F.count_if(wrong).alias("flagged"), F.count_if(wrong & ~F.col("said").isin("yes", "supported")).alias("caught"))
    auc = stats.roc_auc(long.withColumn("ok", ~wrong), "score", "ok", ["check"])
    return stats.kappa(long, "meant", "said", ["check"]).join(counts, "check").join(auc.select("check", "auc"), "check", "left")


def _support(score: str, cutoff: float) -> Column:
    return F.when(F.col(score).isNotNull(), F.when(F.col(score) >= cutoff, "yes").otherwise("no"))


def baseline_agreement(rows: DataFrame) -> DataFrame:
    """Entailment and word overlap against the judge's groundedness, on answered questions."""
    return check_agreement(rows.where(~F.col("declined")), "groundedness", {
        "nli": (_support("nli", NLI_CUTOFF), F.col("nli")), "lexical": (_support("lexical", LEXICAL_CUTOFF), F.col("lexical")),
    })


def human_agreement(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Judge, entailment and word overlap against labels by hand (setup, question_id, label); a label
    without a scored row raises."""
    keys = ["setup", "question_id"]
    missing = labels.join(rows.select(*keys), keys, "left_anti").take(1)
    if missing:
        raise ValueError(f"label without a scored row: {missing[0].setup}, {missing[0].question_id}")
    return check_agreement(labels.join(rows, keys), "label", {
        "judge": (F.col("groundedness"), None), "nli": (_support("nli", NLI_CUTOFF), F.col("nli")), "lexical": (_support("lexical", LEXICAL_CUTOFF), F.col("lexical")),
    })


class OverBudget(RuntimeError):
    """The calls so far cost more than the budget allows."""


def guarded(calls: DataFrame, run, blocks: int, expected: int, budget: float, after: int = 50, factor: float = 1.5) -> list[DataFrame]:
    """Run the model calls of a setup in blocks by hash and stop the run as soon as the spending
    projected from the blocks done exceeds ``factor`` times the budget. ``run`` takes a block and
    returns its rows, written, with ``cost``."""
    done, n, spent = [], 0, 0.0
    for block in range(blocks):
        rows = run(calls.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block))
        told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent")).first()
        done, n, spent = [*done, rows], n + told.n, spent + told.spent
        if n >= after and spent / n * expected > factor * budget:
            raise OverBudget(f"{spent:.4f} spent on {n} calls; {expected} calls would cost {spent / n * expected:.4f} of {budget:.4f}")
    return done


def setup_summary(rows: DataFrame) -> DataFrame:
    """Shares of each setup: correct and declined of all answers, supported of the answered."""
    answered = F.count_if(~F.col("declined"))
    return rows.groupBy("setup").agg(
        F.count("*").alias("answers"), share(F.count_if(F.col("contains")), F.count("*")).alias("correct"), share(F.count_if(F.col("declined")), F.count("*")).alias("declined"),
        share(F.count_if(F.col("lexical") >= LEXICAL_CUTOFF), answered).alias("supported"), F.avg("lexical").alias("lexical_mean"),
    )


def strongest_entailment(probabilities: Column) -> Column:
    """Greatest entailment over the passages; 0 of none."""
    return F.coalesce(F.array_max(probabilities), F.lit(0.0))


def cost_guard(calls: DataFrame, order: list[str], expected: int, budget: float, after: int = 50, factor: float = 1.5) -> DataFrame:
    """Each call with what all are going to cost at the spending so far, and whether to stop.

    ``calls`` have ``setup`` and ``cost``; a budget holds for each setup. From call ``after`` on a
    projection of more than ``factor`` times the budget stops.
    """
    told = running(calls.withColumn("_one", F.lit(1)), ["setup"], order, call="_one", spent="cost").drop("_one")
    told = told.withColumn("projected", F.col("spent") / F.col("call") * expected)
    return told.withColumn("stop", (F.col("call") >= after) & (F.col("projected") > factor * budget))


def last_label(labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of labels of the same keys the last one."""
    rest = [c for c in labels.columns if c not in keys]
    return labels.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def disagreements(labels: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Labels by hand whose verdict differs or is missing."""
    joined = labels.join(rows, keys, "left")
    return joined.where(~F.col("label").eqNullSafe(F.col("verdict")))


def timings(rows: DataFrame) -> DataFrame:
    """Latency, tokens and changed texts of each setup's repeated runs; each timing counts once,
    null, NaN and negative seconds are no measurement."""
    once = rows.dropDuplicates(["timing_id"]).where("seconds >= 0 AND NOT isnan(seconds)")
    once = cut_lineage(once)
    found = once.groupBy("setup").agg(
        F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.avg("output_tokens").alias("tokens"), F.count_if(~F.col("same_text")).alias("changed")
    )
    return with_percentiles(found, once, ["setup"], "seconds")
