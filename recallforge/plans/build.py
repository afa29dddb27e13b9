"""From dataset rows with token streams to pages and questions, in two passes.

The first pass reads no token, only how many are words; the second rebuilds the pages that are
kept or that carry a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.operators import corpus, page_build
from recallforge.session import cut_lineage


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Rows of Parquet files, narrowed, with the key (file, row_index) that any later pass finds again."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def light(rows: DataFrame) -> DataFrame:
    """(file, row_index, title, url, words, agreed, answer) of each row, without its tokens.

    rows have document (title, url, tokens (token, is_html, ...)), question and annotations.
    ``answer`` is null unless annotators agree.
    """
    words = F.size(F.filter("document.tokens.is_html", lambda h: ~h))
    both = F.arrays_zip(F.col("annotations.long_answer").alias("long"), F.col("annotations.short_answers").alias("short"))
    has_long, has_short = (lambda x: x["long"]["start_token"] != -1), (lambda x: F.size(x["short"]["text"]) > 0)
    first = F.try_element_at(F.filter(both, lambda x: has_long(x) & has_short(x)), F.lit(1))
    agreed = (F.size(F.filter(both, has_long)) >= 2) & (F.size(F.filter(both, has_short)) >= 2) & first.isNotNull()
    answer = F.struct(first["long"]["start_token"].alias("start_token"), first["long"]["end_token"].alias("end_token"), first["short"]["text"].alias("short_answers"))
    return rows.select(
        "file", "row_index", F.col("document.title").alias("title"), F.col("document.url").alias("url"), F.coalesce(words, F.lit(0)).alias("words"),
        F.coalesce(agreed, F.lit(False)).alias("agreed"), F.when(agreed, answer).alias("answer"), F.col("question.text").alias("question"),
    )


def build_corpus(rows: DataFrame) -> dict[str, DataFrame]:
    """pages, questions and counters of ``scan``ned rows.

    Of the revisions of a title the one with the most words is kept, of equals the first by file and
    row. A question's answer is that of its annotators in its own revision; in another one it is
    looked for by its text and dropped where it is not found. Null titles have no page.
    """
    known = cut_lineage(light(rows))
    best = known.where("title IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("words"), "file", "row_index")))
    best = best.where("place = 1").select("title", F.col("file").alias("kept_file"), F.col("row_index").alias("kept_row"))
    placed = known.join(best, "title").withColumn("kept", (F.col("file") == F.col("kept_file")) & (F.col("row_index") == F.col("kept_row")))
    needed = placed.where("kept OR agreed").select("file", "row_index", "kept", "agreed", "answer", F.col("question").alias("asked"))
    second = rows.select("file", "row_index", "document").join(needed, ["file", "row_index"])
    stream = second.select(
        tx.page_id(F.col("document.url")).alias("page_id"), F.col("document.title").alias("title"), F.col("document.url").alias("url"),
        *[F.col(f"document.tokens.{c}").alias(c) for c in ("token", "is_html", "start_byte", "end_byte")],
        F.struct("file", "row_index", "kept", "agreed", "answer", F.col("asked").alias("question")).alias("of"),
    ).withColumn("stream", page_build.stream_of("token", "is_html", "start_byte", "end_byte"))
    # a tag at the answer's start tells its kind
    start = F.get("stream", F.col("of.answer.start_token"))
    tagged = stream.withColumn("tag", F.when(start["is_html"], tx.tag_name(start["token"])).otherwise(F.lit("")))
    built = page_build.build_pages(tagged.withColumn("page_id", F.to_json(F.struct("page_id", "of", "tag"))))
    of = F.from_json("page_id", "page_id string, of struct<file:string,row_index:bigint,kept:boolean,agreed:boolean,answer:struct<start_token:int,end_token:int,short_answers:array<string>>,question:string>, tag string")
    built = built.withColumn("x", of).withColumn("span", corpus.char_span(F.col("token_spans"), F.col("x.of.answer.start_token"), F.col("x.of.answer.end_token")))
    # pages are built again where they are asked for: what is written has a page's text once, and neither blocks nor spans of tokens
    pages = built.where("x.of.kept").select("x.page_id", "title", "url", "text", "blocks", "token_spans", "content_tokens")
    told = cut_lineage(
        built.select(
            "x", "title", "span", "content_tokens", F.when(F.col("x.of.kept"), F.col("text")).alias("text"), F.when(F.col("x.of.kept"), F.size(tx.words(F.col("text")))).alias("words"),
            F.size(F.filter("token_spans", lambda s: s.isNotNull())).alias("mapped"),
            F.when(F.col("span").isNotNull(), F.expr("substring(text, span.start + 1, span.end - span.start)")).alias("passage"),
        )
    )
    kept = told.where("x.of.kept")
    asked = told.where("x.of.agreed").select(
        F.concat("x.of.file", F.lit("#"), "x.of.row_index").alias("question_id"), F.col("x.of.question").alias("question"), "title", "x.of.kept",
        F.col("x.of.answer.short_answers").alias("short_answers"), tx.answer_type(F.col("x.tag")).alias("answer_type"), "span", "passage",
    )
    found = F.instr("page_text", F.col("passage"))
    joined = asked.join(kept.select("title", "x.page_id", F.col("text").alias("page_text")), "title")
    moved = joined.withColumn("answer_start", F.when(F.col("kept"), F.col("span.start")).when(found > 0, found - 1))
    moved = moved.withColumn("state", F.when(F.col("span").isNull(), "dropped_span").when(F.col("answer_start").isNull(), "not_relocatable").when(F.col("kept"), "own").otherwise("relocated"))
    questions = moved.where("answer_start IS NOT NULL").select(
        "question_id", "question", "page_id", "answer_start", (F.col("answer_start") + F.length("passage")).alias("answer_end"), "short_answers", "answer_type"
    )
    counters = (
        known.agg(F.count("*").alias("rows"), F.count_if(~F.col("agreed")).alias("without_agreed_answer"))
        .join(kept.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("words", "words"), ("content_tokens", "content_tokens"), ("mapped", "mapped_tokens"))]))
        .join(moved.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("own", "relocated", "not_relocatable", "dropped_span")]))
    )
    return {"pages": pages, "questions": questions, "counters": counters}
