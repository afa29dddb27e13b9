"""Command line: ``python -m recallforge COMMAND``. The session is the one that spark-submit brings."""

from __future__ import annotations

import argparse
import logging
import subprocess
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from recallforge.operators import report, retrieval
from recallforge.plans import artefacts, config, grid, queries
from recallforge.sources.tables import table


def _commit() -> str:
    found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return found.stdout.strip() or "unknown"


def _experiment(spark: SparkSession, args: argparse.Namespace) -> None:
    chosen, started = config.load(args.config), datetime.now(UTC)
    asked = queries._asked(spark, args.tables)
    pages = queries._pages(spark, args.tables)
    vectors = questions = None
    if chosen.retrieval.dense:
        encoder = retrieval.named(retrieval.ENCODERS, chosen.retrieval.dense.model)
        chunks = config.chunk(chosen.chunking, pages)
        vectors, questions = (retrieval.encoded(rows, text, encoder) for rows, text in ((chunks, "text"), (asked, "question")))
    scorer = retrieval.named(retrieval.SCORERS, chosen.rerank.model) if chosen.rerank else None
    found = config.run_experiment(chosen, pages, asked, queries._spans(asked), vectors, questions, scorer)
    made = artefacts.document(
        "experiment", chosen, started, datetime.now(UTC), _commit(), chosen.digest, averages=found["averages"],
        questions=found["questions"].count(), excluded=found["excluded"].count(), chunks=found["chunks"].count(),
    )
    path = artefacts.publish(args.results, made, {"metrics": found["metrics"], "excluded": found["excluded"].select("question_id")})
    print(path)


def _gate(spark: SparkSession, args: argparse.Namespace) -> None:
    measured = artefacts.load_runs(spark, args.results).where("answer_type = 'all'").select("setup", F.concat_ws(".", "level", "metric").alias("metric"), "value")
    if args.record:
        artefacts.record_baseline(args.baseline, measured)
        return
    told = report.gate(measured, artefacts.read_baseline(spark, args.baseline)).orderBy("setup", "metric").collect()
    for r in told:
        print(f"{'ok' if r.passed else 'FAILED'} {r.setup} {r.metric}: {r.value} against {r.expected} - {r.tolerance}")
    if not all(r.passed for r in told):
        raise SystemExit(1)


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    queries.QUERIES[args.name](spark, args.tables).show(args.rows, truncate=100)


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    runs = artefacts.load_runs(spark, args.results).where("answer_type = 'all'")
    means = runs.groupBy("setup").pivot("metric", ["recall@10", "ndcg@10", "mrr@10", "recall@100"]).agg(F.max(F.when(F.col("level") == "passage", F.col("value"))))
    print(artefacts.assemble("Retrieval", {"Setups": means})[1])


def _search(spark: SparkSession, args: argparse.Namespace) -> None:
    chunks = queries._chunks(spark, args.tables)
    retrieval.LiveSearch({"fixed-bm25": retrieval.postings(chunks)}, chunks)("fixed-bm25", args.question).show(truncate=100)


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("recallforge")
    commands = parser.add_subparsers(required=True)

    def command(name: str, run, *arguments: str) -> argparse.ArgumentParser:
        part = commands.add_parser(name)
        for a in arguments:
            part.add_argument(a)
        part.set_defaults(run=run)
        return part

    command("grid", lambda spark, args: print("\n".join(grid.write(args.folder))), "folder")
    command("experiment", _experiment, "config", "tables", "results")
    command("gate", _gate, "results", "baseline").add_argument("--record", action="store_true")
    command("report", _report, "results")
    command("query", _query, "name", "tables").add_argument("--rows", type=int, default=20)
    command("search", _search, "tables", "question")
    args = parser.parse_args(given)
    handler = logging.StreamHandler()
    handler.setFormatter(artefacts.JsonLines())
    logging.basicConfig(handlers=[handler], level=logging.INFO)
    args.run(SparkSession.builder.appName("recallforge").getOrCreate(), args)


if __name__ == "__main__":
    main()
