"""Experiment configurations, checked strictly, and the plans they stand for."""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from functools import reduce
from pathlib import Path
from types import UnionType
from typing import get_args, get_type_hints

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.functions.stem import stem, stem_terms
from recallforge.operators import evaluation as ev
from recallforge.operators import retrieval, sampling
from recallforge.operators.chunking import ChunkSettings, block_chunks, fixed_chunks
from recallforge.session import cut_lineage
from recallforge.sources.files import canonical_digest


class ConfigError(ValueError):
    """One line for each problem."""


@dataclass(frozen=True)
class Corpus:
    name: str
    split: str = "validation"
    query_limit: int | None = None


@dataclass(frozen=True)
class Bm25:
    k1: float = 0.9
    b: float = 0.4
    stem: bool = True


@dataclass(frozen=True)
class Dense:
    model: str


@dataclass(frozen=True)
class Fusion:
    k: int = 60
    candidates: int = 100


@dataclass(frozen=True)
class Retrieval:
    method: str
    depth: int = 100
    bm25: Bm25 | None = None
    dense: Dense | None = None
    fusion: Fusion | None = None


@dataclass(frozen=True)
class Rerank:
    model: str
    depth: int = 50


@dataclass(frozen=True)
class Evaluation:
    cutoffs: tuple = (1, 5, 10, 100)


@dataclass(frozen=True)
class Experiment:
    name: str
    corpus: Corpus
    retrieval: Retrieval
    description: str = ""
    seed: int = 1
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    rerank: Rerank | None = None
    evaluation: Evaluation = field(default_factory=Evaluation)

    @property
    def digest(self) -> str:
        return canonical_digest(asdict(self))


# The sections that each method takes.
SECTIONS = {"bm25": {"bm25"}, "dense": {"dense"}, "hybrid": {"bm25", "dense", "fusion"}}


def _build(kind: type, values: object, where: str, problems: list[str]):
    if not isinstance(values, dict):
        problems.append(f"{where or 'file'}: a table is needed")
        return None
    known, hints, out = {f.name: f for f in fields(kind)}, get_type_hints(kind), {}
    problems += [f"{where}{k}: unknown key" for k in values.keys() - known.keys()]
    for name, value in values.items():
        if name not in known:
            continue
        options = get_args(hints[name]) if isinstance(hints[name], UnionType) else (hints[name],)
        nested = next((o for o in options if is_dataclass(o)), None)
        if nested:
            out[name] = _build(nested, value, f"{where}{name}.", problems)
        elif tuple in options and isinstance(value, list):
            out[name] = tuple(value)
        elif type(value) in options or (float in options and type(value) is int):
            out[name] = value
        else:
            problems.append(f"{where}{name}: {type(value).__name__} is not {' or '.join(o.__name__ for o in options)}")
    try:
        return kind(**out)
    except (TypeError, ValueError) as error:
        problems.append(f"{where or 'file'}: {error}")
        return None


def parse(text: str) -> Experiment:
    """A configuration from TOML. Unknown or missing keys, other types and values out of range
    raise, all at once."""
    problems: list[str] = []
    found = _build(Experiment, tomllib.loads(text), "", problems)
    if not problems and found:
        r, cutoffs = found.retrieval, found.evaluation.cutoffs
        given = {s for s in ("bm25", "dense", "fusion") if getattr(r, s) is not None}
        rules = [
            (re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", found.name), "name: lower-case words joined by hyphens are needed"),
            (found.seed >= 0, "seed: below 0"),
            (found.corpus.query_limit is None or found.corpus.query_limit >= 1, "corpus.query_limit: below 1"),
            (r.method in SECTIONS, f"retrieval.method: one of {', '.join(SECTIONS)}"),
            (r.method not in SECTIONS or given == SECTIONS[r.method], f"retrieval: {r.method} takes {', '.join(sorted(SECTIONS.get(r.method, ())))}"),
            (r.depth >= 1, "retrieval.depth: below 1"),
            (r.bm25 is None or (r.bm25.k1 >= 0 and 0 <= r.bm25.b <= 1), "retrieval.bm25: k1 is at least 0 and b from 0 to 1"),
            (r.fusion is None or (r.fusion.k >= 1 and r.fusion.candidates >= 1), "retrieval.fusion: k and candidates are at least 1"),
            (found.rerank is None or 1 <= found.rerank.depth <= r.depth, "rerank.depth: from 1 to retrieval.depth"),
            (len(cutoffs) > 0 and len(set(cutoffs)) == len(cutoffs) and all(type(k) is int and k >= 1 for k in cutoffs), "evaluation.cutoffs: unique and at least 1"),
            (not cutoffs or max(cutoffs) <= r.depth, "evaluation.cutoffs: above retrieval.depth"),
        ]
        problems += [message for ok, message in rules if not ok]
    if problems:
        raise ConfigError("\n".join(problems))
    return found


@dataclass(frozen=True)
class Writer:
    model: str
    max_tokens: int = 256


@dataclass(frozen=True)
class Judge:
    model: str
    budget: float
    workers: int = 8


@dataclass(frozen=True)
class StageTwo:
    """Written answers: the setups and questions that are answered, and who writes and judges."""

    name: str
    setups: tuple
    questions: int
    writer: Writer
    judge: Judge | None = None
    passages: int = 10
    seed: int = 1
    answer_type: str | None = None


def parse_stage_two(text: str) -> StageTwo:
    """A configuration of written answers from TOML, as strict as ``parse``."""
    problems: list[str] = []
    found = _build(StageTwo, tomllib.loads(text), "", problems)
    if not problems and found:
        setups = found.setups
        rules = [
            (bool(setups) and all(isinstance(x, str) and x for x in setups) and len(set(setups)) == len(setups), "setups: different names are needed"),
            (found.questions >= 1, "questions: below 1"),
            (found.passages >= 1, "passages: below 1"),
            (found.seed >= 0, "seed: below 0"),
            (found.answer_type in (None, "paragraph", "table", "list"), "answer_type: paragraph, table or list"),
            (found.writer is None or found.writer.max_tokens >= 1, "writer.max_tokens: below 1"),
            (found.judge is None or (found.judge.budget > 0 and found.judge.workers >= 1), "judge: budget above 0 and workers at least 1"),
        ]
        problems += [message for ok, message in rules if not ok]
    if problems:
        raise ConfigError("\n".join(problems))
    return found


def stage_two_questions(config: StageTwo, questions: DataFrame) -> DataFrame:
    """The sample of the configuration by answer type; ``answer_type`` filters after the draw, so that
    the questions of a type are the same with and without it."""
    drawn = sampling.stratified(questions, "answer_type", "question_id", config.questions, config.seed)
    return drawn if config.answer_type is None else drawn.where(F.col("answer_type") == config.answer_type)


def load(path: str) -> Experiment:
    return parse(Path(path).read_text())


def stems_of(*texts: DataFrame) -> DataFrame:
    """(term, stem) of every term of the texts (text), written once."""
    terms = [t.select(F.explode(F.array_distinct(tx.tokenize(F.col("text")))).alias("term")).distinct() for t in texts]
    return cut_lineage(stem_terms(reduce(DataFrame.unionByName, terms)))


def first_stage(config: Retrieval, chunks: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, queries: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """The ranking of the configured method, as one plan over all questions; ``only`` as in ``bm25_search``,
    for that method alone."""
    if config.method != "bm25" and (vectors is None or queries is None):
        raise ValueError(f"{config.method} needs vectors of chunks and of questions")

    def lexical(depth: int) -> DataFrame:
        return retrieval.bm25_search(chunks, questions, depth, config.bm25.k1, config.bm25.b, stem if config.bm25.stem else None, only)

    if config.method == "bm25":
        return lexical(config.depth)
    if config.method == "dense":
        return retrieval.dense_search(vectors, queries, config.depth)
    return retrieval.fuse([lexical(config.fusion.candidates), retrieval.dense_search(vectors, queries, config.fusion.candidates)], config.depth, config.fusion.k, config.fusion.candidates)


def chunk(settings: ChunkSettings, pages: DataFrame) -> DataFrame:
    """The chunks that the settings ask for, of pages (page_id, title, text[, blocks]). Without blocks
    a page is one block of prose, which fixed windows cut natively."""
    if "blocks" not in pages.columns:
        if settings.strategy == "fixed_words":
            return fixed_chunks(pages, settings)
        one = F.struct(
            F.lit("paragraph").alias("kind"), F.lit("").alias("section"), "text", F.lit(0).alias("start"), F.length("text").alias("end"),
            F.lit("").alias("caption"), F.lit(None).cast("array<array<string>>").alias("rows"),
        )
        pages = pages.withColumn("blocks", F.when(F.col("text").isNotNull(), F.array(one)))
    return block_chunks(pages, settings)


def select_questions(config: Experiment, questions: DataFrame, passages: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions to evaluate and those left out: a question needs a relevant passage and a relevant
    page. ``corpus.query_limit`` then draws so many by the seed; no question, or fewer than the
    limit, raises."""
    kept, excluded = ev.split_evaluable(questions, passages)
    kept, without_page = ev.split_evaluable(kept, pages)
    count, limit = kept.count(), config.corpus.query_limit
    if count == 0 or (limit or 0) > count:
        raise ValueError("no question can be evaluated" if count == 0 else f"query_limit {limit} is above the {count} questions")
    drawn = kept if limit is None else sampling.first_by_hash(kept, "question_id", limit, config.seed)
    return drawn, excluded.unionByName(without_page)


def run_experiment(
    config: Experiment, pages: DataFrame, questions: DataFrame, spans: DataFrame, vectors=None, queries=None, scorer=None, grades: DataFrame | None = None, whole: bool = True
) -> dict[str, DataFrame]:
    """All of one experiment as its configuration says: chunks, judgements, questions, rankings of
    passages and pages, metrics of both levels and their means by type.

    pages are (page_id, title, text[, blocks]), questions (question_id, question, answer_type), spans
    (question_id, page_id, start, end). ``grades`` (question_id, page_id, grade) judge pages; without
    them the pages of the spans are relevant. A configured reranker needs ``scorer``. Without ``whole`` a
    plain BM25 ranking comes out as its judged rows (see ``bm25_search``), which the metrics need.
    """
    if config.rerank and scorer is None:
        raise ValueError("a reranker is configured: a scorer is needed")
    chunks = cut_lineage(chunk(config.chunking, pages))
    passages = ev.span_judgements(spans, chunks)
    of_pages = grades if grades is not None else spans.select("question_id", "page_id", F.lit(1).alias("grade")).distinct()
    of_pages = of_pages.join(pages.select("page_id").distinct(), "page_id", "left_semi").select("question_id", F.col("page_id").alias("doc_id"), "grade")
    kept, excluded = select_questions(config, questions, passages, of_pages)
    kept = cut_lineage(kept)
    asked = queries.join(kept.select("question_id"), "question_id", "left_semi") if queries is not None else None
    ids = kept.select("question_id")
    passages_asked, pages_asked = (cut_lineage(x.join(ids, "question_id", "left_semi")) for x in (passages, of_pages))
    only = None
    if not whole and config.retrieval.method == "bm25" and not config.rerank:
        none = F.lit(None).cast("string")
        only = passages_asked.select("question_id", F.col("doc_id").alias("chunk_id"), none.alias("page_id")).unionByName(pages_asked.select("question_id", none.alias("chunk_id"), F.col("doc_id").alias("page_id")))
    ranking = first_stage(config.retrieval, chunks, kept, vectors, asked, only)
    if config.rerank:
        # only the head reaches the scorer
        ranking = cut_lineage(ranking)
        head = ranking.where(F.col("rank") <= config.rerank.depth).join(chunks.select("chunk_id", "text"), "chunk_id").join(kept.select("question_id", "question"), "question_id")
        scored = head.join(retrieval.score_pairs(head, scorer), ["question", "text"]).select("question_id", "chunk_id", "rescore")
        ranking = retrieval.rerank(ranking, scored, config.rerank.depth)
    ranking, cutoffs = cut_lineage(ranking), list(config.evaluation.cutoffs)
    by_page = retrieval.pages_of(ranking) if only is None else ranking.where("page_rank IS NOT NULL").select("question_id", F.col("page_rank").alias("rank"), "page_id")
    levels = {
        "passage": ev.question_metrics(ranking.withColumnRenamed("chunk_id", "doc_id"), passages_asked, cutoffs),
        "page": ev.question_metrics(by_page.withColumnRenamed("page_id", "doc_id"), pages_asked, cutoffs),
    }
    metrics = reduce(DataFrame.unionByName, [m.select(F.lit(level).alias("level"), "*") for level, m in levels.items()])
    averages = reduce(DataFrame.unionByName, [ev.average(m, kept).select(F.lit(level).alias("level"), "*") for level, m in levels.items()])
    return {"chunks": chunks, "questions": kept, "excluded": excluded, "ranking": ranking, "judgements": passages, "metrics": metrics, "averages": averages}
