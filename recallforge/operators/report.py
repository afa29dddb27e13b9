"""Tables of a report: setups, selection, gate, grid, browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.functions import text as tx

# The grid.
CHUNKERS, RETRIEVERS = ("fixed", "sentence", "section"), ("bm25", "minilm", "qwen3", "hybrid-minilm", "hybrid-qwen3")
BASELINE = "fixed-bm25"


def grid(spark: SparkSession) -> DataFrame:
    """(position, setup, chunker, retriever, rerank) of the 30 setups, in fixed order."""
    rows = [(c, r, k) for c in CHUNKERS for r in RETRIEVERS for k in (False, True)]
    setups = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "position int, chunker string, retriever string, rerank boolean")
    return setups.withColumn("setup", tx.setup_name(F.col("chunker"), F.col("retriever"), F.col("rerank"), F.lit(False)))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Of each setup the run with the greatest id; a run delivered twice counts once."""
    rest = [c for c in runs.columns if c not in ("setup", "recall_at_10_by_type")]
    return runs.groupBy("setup").agg(F.max_by(F.struct(*rest), F.struct("run_at", "run_id")).alias("x")).select("setup", "x.*")


def setup_table(runs: DataFrame, primary: str) -> DataFrame:
    """Setups by the primary metric, best first; equal ones by name; without a value last."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(primary).desc_nulls_last(), "setup")
    return runs.withColumn("place", F.row_number().over(order))


def select_setups(table: DataFrame, primary: str, baseline: str = BASELINE, top: int = 3) -> DataFrame:
    """(choice, setup): the baseline, the weakest other, then the best until there are top + 2."""
    ranked = table.where(F.col(primary).isNotNull())
    if not ranked.where(F.col("setup") == baseline).take(1):
        raise ValueError(f"the baseline {baseline} has no run")
    others = ranked.where(F.col("setup") != baseline)
    weakest = others.withColumn("w", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("place")))).withColumn("order", F.when(F.col("w") == 1, -1).otherwise(F.col("place")))
    first = ranked.where(F.col("setup") == baseline).select("setup", F.lit(-2).alias("order"))
    chosen = first.unionByName(weakest.select("setup", "order"))
    return chosen.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order")).alias("choice"), "setup").where(F.col("choice") <= top + 2)


def gate(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each metric of the baseline with what was measured: passed at baseline - tolerance or more.
    A metric that was not measured fails."""
    joined = baseline.join(measured, ["setup", "metric"], "left")
    return joined.withColumn("passed", F.coalesce(F.col("value") >= F.col("expected") - F.col("tolerance"), F.lit(False)))


def trec_rows(ranking: DataFrame, tag: str) -> DataFrame:
    """(question_id, rank, line): run lines, scored by n - rank + 1 and not by the retriever."""
    n = F.count("*").over(Window.partitionBy("question_id"))
    line = F.concat_ws(" ", "question_id", F.lit("Q0"), "chunk_id", F.col("rank").cast("string"), (n - F.col("rank") + 1).cast("string"), F.lit(tag))
    return ranking.select("question_id", "rank", line.alias("line"))


def text_ranks(ranking: DataFrame, chunks: DataFrame, references: DataFrame, questions: DataFrame, depth: int = 10) -> DataFrame:
    """(question_id, rank): the first rank whose body contains a reference; null of none."""
    # bodies and references are normalised once each, not for each pair, and no text is shuffled after it has met its questions
    spaced = F.transform("short_answers", lambda r: F.concat(F.lit(" "), tx.normalise_answer(r), F.lit(" ")))
    sought = references.select("question_id", F.filter(spaced, lambda r: r != "  ").alias("sought")).where(F.size("sought") > 0)
    bodies = chunks.select("chunk_id", F.concat(F.lit(" "), tx.normalise_answer(tx.body(F.col("text"))), F.lit(" ")).alias("body"))
    read = ranking.where(F.col("rank") <= depth).select("question_id", "rank", "chunk_id").join(sought, "question_id").join(bodies, "chunk_id")
    found = read.where(F.exists("sought", lambda r: F.col("body").contains(r))).groupBy("question_id").agg(F.min("rank").alias("rank"))
    return questions.select("question_id").join(found, "question_id", "left")


def markdown_lines(table: DataFrame, columns: list[str]) -> DataFrame:
    """(place, line) of a table in Markdown, numbers with three decimals."""
    cells = [F.format_string("%.3f", F.round(c, 9)) if table.schema[c].dataType.simpleString() == "double" else F.col(c).cast("string") for c in columns]
    return table.select("place", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |")).alias("line"))


def markdown(rows: list[dict], columns: list[str]) -> list[str]:
    """Lines of a small table; numbers with three decimals, null as nothing."""
    def cell(x: object) -> str:
        return "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)

    return [f"| {' | '.join(columns)} |", "|" + "---|" * len(columns), *(f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows)]


def browse(rows: DataFrame, contains: str = "", answer_type: str | None = None, found: bool | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """One page of questions by substring whatever the case, type and whether they were found."""
    if contains:
        rows = rows.where(F.lower("question").contains(contains.lower()))
    if answer_type is not None:
        rows = rows.where(F.col("answer_type") == answer_type)
    if found is not None:
        rows = rows.where((F.col("recall") > 0) == found)
    return rows.orderBy("question_id").offset(page * size).limit(size)


def families(setups: DataFrame, winner: str) -> DataFrame:
    """(family, a, b): the winner against each other setup, and each reranked setup against the
    same without."""
    names = setups.select("setup").distinct()
    others = names.where(F.col("setup") != winner).select(F.lit("winner").alias("family"), F.lit(winner).alias("a"), F.col("setup").alias("b"))
    plain = names.where(F.col("setup").endswith("-rerank")).select(F.lit("rerank").alias("family"), F.col("setup").alias("a"), F.regexp_replace("setup", "-rerank$", "").alias("b"))
    return others.unionByName(plain.join(names.select(F.col("setup").alias("b")), "b", "left_semi").select("family", "a", "b"))


def headline(compared: DataFrame) -> DataFrame:
    """How many comparisons there are, and in how many the first setup is surely better."""
    return compared.agg(F.count("*").alias("compared"), F.count_if((F.col("difference") > 0) & (F.col("p_holm") < 0.05)).alias("helped"))


def ablation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Questions that both runs rank (question_id, rank of the first passage with an answer, null of
    none): share found and mean reciprocal rank of each."""
    both = first.select("question_id", F.col("rank").alias("ra")).join(second.select("question_id", F.col("rank").alias("rb")), "question_id")
    def of(r: str) -> list:
        return [F.avg(F.col(r).isNotNull().cast("int")).alias(f"hit_{r[1]}"), F.avg(F.coalesce(1 / F.col(r), F.lit(0.0))).alias(f"rr_{r[1]}")]

    return both.agg(F.count("*").alias("n"), *of("ra"), *of("rb"))


def writer_comparison(first: DataFrame, second: DataFrame, questions: DataFrame, answer_type: str = "table") -> DataFrame:
    """(measure, question_id, a, b, diff): two writers' verdicts on the questions of a type that both
    answered: contains, declined, correct and supported, each 0 or 1. ``first`` and ``second`` have
    question_id, contains, declined, correctness and groundedness. Aggregate with ``stats.compare``."""
    def measures(rows: DataFrame, name: str) -> DataFrame:
        told = {
            "contains": F.col("contains"), "declined": F.col("declined"),
            "correct": F.coalesce(F.col("correctness") == "correct", F.lit(False)), "supported": F.coalesce(F.col("groundedness") == "supported", F.lit(False)),
        }
        listed = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("int").alias(name)) for m, v in told.items()])
        return rows.select("question_id", F.inline(listed))

    chosen = questions.where(F.col("answer_type") == answer_type).select("question_id")
    both = measures(first, "a").join(measures(second, "b"), ["question_id", "measure"]).join(chosen, "question_id", "left_semi")
    return both.select("measure", "question_id", "a", "b", (F.col("a") - F.col("b")).alias("diff"))
