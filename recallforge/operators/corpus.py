"""Pages and questions from records: revisions, agreed answers, spans, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions import text as tx

# Sections of citations and link lists.
BOILERPLATE_SECTIONS = (
    "References", "References and notes", "Notes", "Notes and references", "Footnotes", "Citations", "External links",
    "External link", "See also", "Further reading", "Bibliography", "Sources", "Works cited",
)


def key_of(page_id: Column) -> Column:
    """The page's id whatever its case and outer spaces."""
    return F.lower(F.regexp_replace(page_id, f"^[{tx.SPACES}]+|[{tx.SPACES}]+$", ""))


def best_revision(records: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Of each key the record with the most words, of equals the first in ``order``.

    Null keys and texts without words have none. One aggregation, combined before the shuffle.
    """
    counted = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).withColumn("words", F.size(tx.words(F.col(text))))
    best = F.max_by(F.struct(*[F.col(c) for c in counted.columns if c != key]), F.struct("words", -F.col(order)))
    return counted.groupBy(key).agg(best.alias("x")).select(key, "x.*").where("words > 0")


def pages(records: DataFrame) -> DataFrame:
    """(page_id, title, text, words, record_id): the best revision of each page."""
    rows = records.select(key_of(F.col("page_id")).alias("page_id"), "record_id", F.coalesce("title", F.lit("")).alias("title"), "text")
    return best_revision(rows, "page_id", "text", "record_id").select("page_id", "title", "text", "words", "record_id")


def built_questions(questions: DataFrame) -> DataFrame:
    """Questions, each id once: of several builds the latest, then the whole row decides."""
    rows = questions.withColumn("page_id", key_of(F.col("page_id")))
    rest = [c for c in rows.columns if c != "question_id"]
    latest = F.max(F.struct("built_at", *[c for c in rest if c != "built_at"]))
    return rows.groupBy("question_id").agg(latest.alias("x")).select("question_id", "x.*")


def agreed_answers(rows: DataFrame) -> DataFrame:
    """(id, start_token, end_token, candidate_index, answers, agreed) of each annotated row.

    Agreed are rows where at least two annotators gave a long and two a short answer; the answer
    is that of the first annotator with both.
    """
    both = F.arrays_zip(F.col("annotations.long_answer").alias("long"), F.col("annotations.short_answers").alias("short"))
    listed = rows.select("id", "received_at", both.alias("all")).where("all IS NOT NULL")
    # an id delivered again counts once: the latest delivery with annotations
    listed = listed.groupBy("id").agg(F.max_by("all", "received_at").alias("all"))
    has_long, has_short = (lambda x: x["long"]["start_token"] != -1), (lambda x: F.size(x["short"]["text"]) > 0)
    counted = listed.select(
        "id",
        F.size(F.filter("all", has_long)).alias("longs"),
        F.size(F.filter("all", has_short)).alias("shorts"),
        F.try_element_at(F.filter("all", lambda x: has_long(x) & has_short(x)), F.lit(1)).alias("first"),
    )
    agreed = (F.col("longs") >= 2) & (F.col("shorts") >= 2) & F.col("first").isNotNull()
    return counted.select(
        "id", "longs", "shorts", agreed.alias("agreed"),
        F.when(agreed, F.col("first.long.candidate_index")).alias("candidate_index"),
        F.when(agreed, F.col("first.long.start_token")).alias("start_token"),
        F.when(agreed, F.col("first.long.end_token")).alias("end_token"),
        F.when(agreed, F.col("first.short.text")).alias("answers"),
    )


def relocate(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """Spans of another revision (key, passage) found again in the kept text (key, text).

    ``start`` counts from 0 and is null where the passage is not there: such questions are dropped.
    """
    at = F.instr("text", F.col("passage"))
    joined = spans.join(kept, "key", "left")
    return joined.withColumn("start", F.when(at > 0, at - 1)).withColumn("end", F.col("start") + F.length("passage")).drop("text")


def char_span(token_spans: Column, start: Column, end: Column) -> Column:
    """Character span of tokens start..end (end excluded); null where all were dropped."""
    part = F.filter(F.slice(token_spans, start + 1, end - start), lambda s: s.isNotNull())
    return F.when(F.size(part) > 0, F.struct(F.array_min(F.transform(part, lambda s: s["start"])).alias("start"), F.array_max(F.transform(part, lambda s: s["end"])).alias("end")))


def serialise_table(header: Column, rows: Column) -> Column:
    """A table as text: ``label: value`` cells joined by `` | ``, one line a row. Cells past the
    header or under an empty label stand alone."""
    def cell(value: Column, i: Column) -> Column:
        label = F.coalesce(F.get(header, i), F.lit(""))
        return F.when(label != "", F.concat(label, F.lit(": "), value)).otherwise(value)

    return F.array_join(F.transform(rows, lambda row: F.array_join(F.transform(row, cell), " | ")), "\n")


def flatten_table(rows: Column) -> Column:
    """Values only, joined by spaces."""
    return F.array_join(F.flatten(rows), " ")


def keep_section(section: Column) -> Column:
    return ~F.lower(F.coalesce(section, F.lit(""))).isin(*[s.lower() for s in BOILERPLATE_SECTIONS])


def page_blocks(blocks: Column) -> Column:
    """Blocks outside boilerplate sections with text, placed as in the joined page text."""
    kept = F.filter(blocks, lambda b: keep_section(b["section"]) & (F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
    placed = F.aggregate(
        kept,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,section:string,text:string,start:int,end:int>>").alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + F.length(b["text"]) + 2).alias("at"),
            F.concat(acc["out"], F.array(F.struct(b["kind"].alias("kind"), b["section"].alias("section"), b["text"].alias("text"), acc["at"].alias("start"), (acc["at"] + F.length(b["text"])).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return placed


def build_report(records: DataFrame, kept: DataFrame, questions: DataFrame) -> DataFrame:
    """One row of counters of a build: pages, words, records, questions with and without a page."""
    with_page = questions.join(kept.select("page_id"), "page_id", "left_semi")
    return (
        kept.agg(F.count("*").alias("pages"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        .join(records.agg(F.count("*").alias("records")))
        .join(questions.agg(F.count("*").alias("questions")))
        .join(with_page.agg(F.count("*").alias("questions_with_page")))
    )
