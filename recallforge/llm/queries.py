"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.llm import chunk, consensus, encode, garbled, language, pack, pairs, sketch, survivors
from recallforge.plans.sql import key_of, words
from recallforge.session import cut_lineage
from recallforge.sources.tables import table


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.cut_texts(table(spark, sf_dir, "page_records", "record_id", "text"), table(spark, sf_dir, "chunking_configs"), "record_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable configs and the records that they cut."""
    return _cuts(spark, sf_dir).where(F.size("starts") > 1).select("config_id", "record_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized record, as a span of its text."""
    return chunk.pieces(_cuts(spark, sf_dir))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per setup and per setup and day, with the error of each rank."""
    timings = table(spark, sf_dir, "timings", "timing_id", "setup", "seconds", "timed_at")
    runs = table(spark, sf_dir, "retrieval_rows", "run_id", "setup", "retrieval_p50_ms", "rerank_p50_ms", "run_at")

    def of(df: DataFrame, key: str, column: str, at: str) -> DataFrame:
        return sketch.measurements(df, key, F.col(column), F.lit(column).alias("metric"), F.col("setup"), F.to_date(at).alias("day"))

    values = (
        of(timings, "timing_id", "seconds", "timed_at")
        .unionByName(of(runs, "run_id", "retrieval_p50_ms", "run_at"))
        .unionByName(of(runs, "run_id", "rerank_p50_ms", "run_at"))
    )
    return sketch.percentiles_by_day(values, ["metric", "setup"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that do not fit their question, with the defect."""
    model = language.fit(table(spark, sf_dir, "documents", "text", "lang"))
    return pairs.find_defects(table(spark, sf_dir, "answers", "answer_id", "question", "text"), model)


_PAGE = ("record_id", "page_id", "title", "url", "text", "blocks", "feed", "captured_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record whose text survives, of every page with several records."""
    return survivors.survivors(table(spark, sf_dir, "page_records", *_PAGE)).select("page_key", "record_id")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivor of every page with several records, field by field."""
    records = table(spark, sf_dir, "page_records", *_PAGE)
    return survivors.survivor_fields(records, survivors.survivors(records))


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that have a survivor, and of how many records."""
    return survivors.survivors(table(spark, sf_dir, "page_records", *_PAGE)).select("page_key", "records")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dataset_rows", "id", "annotations").select(
        "id", F.explode(F.arrays_zip("annotations.id", "annotations.long_answer.candidate_index")).alias("x")
    )
    flat = rows.select("id", F.col("x").getField("id").alias("annotator"), F.col("x").getField("candidate_index").alias("label"))
    return cut_lineage(consensus.votes(flat, "id", "annotator", "label"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long-answer candidate of every id on which its annotators agree."""
    return p5_consensus(spark, sf_dir).select("id", "candidate_index")


def p5_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of every id, with the support of the weights and the agreement."""
    voted = _votes(spark, sf_dir)
    found = consensus.consensus(voted, consensus.reliabilities(voted))
    return found.select(F.col("item").alias("id"), F.col("label").cast("int").alias("candidate_index"), "support", "agreement", "votes")


def p5_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability of every annotator, over all rows."""
    return consensus.annotators(consensus.reliabilities(_votes(spark, sf_dir)))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's text as its ids decode to."""
    return p6_ids(spark, sf_dir).select("doc_id", F.md5(encode.decode_ids(F.col("ids"))).alias("text_md5"))


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each window the documents in its loads and the loads with more than its capacity."""
    loads = cut_lineage(p7_loads(spark, sf_dir))
    over = loads.groupBy("window_id", "load_id", "capacity").agg(F.sum("tokens").alias("tokens"))
    over = over.groupBy("window_id", "capacity").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"))
    return loads.where("part = 0").groupBy("window_id").agg(F.count("*").alias("documents")).join(over, "window_id").select("window_id", "capacity", "documents", "overfull")


def p7_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load of every document, or of each part of one larger than the capacity."""
    boxes = table(spark, sf_dir, "context_windows").select(F.col("window_id").alias("box"), "capacity")
    sizes = pack.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pack.pack_items(sizes, boxes).select(
        F.col("box").alias("window_id"), "capacity", F.col("bin").alias("load_id"), F.col("item").alias("doc_id"), "part", F.col("size").alias("tokens")
    )


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read in a wrong encoding, with their text as far as it could be restored."""
    cost = garbled.fit(table(spark, sf_dir, "documents", "text", "lang"))
    return garbled.find_garbled(table(spark, sf_dir, "documents", "doc_id", "text"), cost)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read in a wrong encoding."""
    return p8_repaired(spark, sf_dir).select("doc_id")


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_percentiles": p2_percentiles,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_survivors": p4_survivors,
        "p4_pages": p4_pages,
        "p5_found": p5_found,
        "p5_consensus": p5_consensus,
        "p5_annotators": p5_annotators,
        "p6_ids": p6_ids,
        "p6_round_trip": p6_round_trip,
        "p7_loads": p7_loads,
        "p7_filled": p7_filled,
        "p8_found": p8_found,
        "p8_repaired": p8_repaired,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of what can be told without the operator: which records are cut, which pages have a
    survivor, that ids decode to their texts, and that every document is in loads that are not overfull."""
    return {
        "p1_found": f"SELECT config_id, record_id FROM chunking_configs JOIN page_records ON len({words('text')}) > size WHERE size >= 1 AND overlap >= 0 AND overlap < size",
        "p4_pages": f"""WITH k AS (SELECT nullif({key_of('page_id')}, '') AS key, lower(trim(split_part(split_part(url, '?', 1), '#', 1))) AS base FROM page_records),
u AS (SELECT base, min(key) AS of_url FROM k WHERE key IS NOT NULL AND base <> '' GROUP BY base), r AS (SELECT coalesce(key, of_url) AS key FROM k LEFT JOIN u ON k.key IS NULL AND k.base = u.base)
SELECT key AS page_key, count(*) AS records FROM r WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1""",
        "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "p7_filled": "SELECT window_id, CAST(capacity AS BIGINT) AS capacity, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS overfull FROM context_windows WHERE capacity >= 1",
    }
