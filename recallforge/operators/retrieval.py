"""First-stage retrieval, fusion, ranking of pages and reranking, for all questions at once.

Questions are (question_id, question), chunks (chunk_id, page_id, text), rankings
(question_id, rank, chunk_id, page_id, score). Order is score descending, then chunk_id as a
string. Scores are rounded to nine decimals before they are ranked, so that sums in another
order rank alike.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from functools import reduce
from itertools import accumulate, groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.session import cut_lineage

#: Questions ranked in one pass over the index, and hash buckets that blocks of them are made of.
QUESTION_BLOCK, BUCKETS = 20_000, 4_096
#: Chunks in a row of the packed index, and postings that a task holds at once.
SEGMENT, PART_POSTINGS = 4_000, 8_000_000
#: A term is common if more than one of so many chunks has it.
COMMON = 40
#: Query vectors scored in one pass.
VECTOR_BLOCK = 4_096
PACKED = "n bigint, known bigint, total bigint, ids array<string>, pages array<string>, lengths binary, codes binary, counts binary, rows binary, tf binary"
RANKED = "question_id string, rank int, chunk_id string, page_id string, score double"
CANDIDATES = "question_id string, chunk_id string, page_id string, score double"


def postings(chunks: DataFrame, k1: float = 0.9, b: float = 0.4, stems: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, page_id, weight): the BM25 weight of every term in every chunk.

    ``stems`` maps terms to stems. The whole text counts, its heading included; chunks without
    terms count for the number of chunks and the mean length.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be at least 0 and b between 0 and 1")
    # read three times below: terms are split once and written to the shared folder
    tokens = cut_lineage(chunks.select("chunk_id", "page_id", tx.tokenize(F.col("text")).alias("terms")))
    totals = tokens.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("mean"))
    counted = tokens.select("chunk_id", "page_id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    if stems is not None:
        counted = counted.join(stems, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")
    counted = counted.groupBy("term", "chunk_id", "page_id", "length").agg(F.count("*").alias("tf"))
    # terms of most chunks are hot: their counts are combined before the shuffle
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    tf, norm = F.col("tf"), k1 * (1 - b + b * F.col("length") / F.col("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.join(df, "term").join(F.broadcast(totals)).select("term", "chunk_id", "page_id", (idf * tf * (k1 + 1) / (tf + norm)).alias("weight"))


def query_terms(questions: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """(question_id, term, qtf): how often a question has a term."""
    terms = questions.select("question_id", F.explode(tx.tokenize(F.col("question"))).alias("term"))
    if stems is not None:
        terms = terms.join(stems, "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")
    return terms.groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(question_id, chunk_id, page_id, score) of every question and chunk that share a term."""
    joined = index.join(terms, "term")
    scored = joined.groupBy("question_id", "chunk_id", "page_id").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 9).alias("score"))
    return scored


def rank(scores: DataFrame, depth: int, positive_only: bool = False) -> DataFrame:
    """The first ``depth`` chunks of every question; Spark keeps ``depth`` of each task only."""
    if positive_only:
        scores = scores.where("score > 0")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("question_id", "rank", "chunk_id", "page_id", "score")


def bm25_search(
    chunks: DataFrame, questions: DataFrame, depth: int = 100, k1: float = 0.9, b: float = 0.4, stemmer: Callable[[str], str] | None = None, only: DataFrame | None = None
) -> DataFrame:
    """The BM25 ranking of every question, as ``rank(bm25_scores(...))`` gives it; ``stemmer`` is put to
    every term of chunks and questions.

    For many questions: the postings of the questions' terms are packed into arrays, some thousand
    chunks a row, and each task ranks a block of at most ``QUESTION_BLOCK`` questions over all of them,
    so neither postings nor candidates are shuffled. With ``only`` (question_id, chunk_id, page_id; one
    of them may be null) come out just the rows of the whole ranking that have such a chunk, or are the
    first of such a page, with ``page_rank``: the page's rank, null where it came before.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be at least 0 and b between 0 and 1")
    spark, schema = chunks.sparkSession, RANKED + (", page_rank int" if only is not None else "")
    terms = query_terms(questions).groupBy("question_id").agg(F.collect_list(F.struct("term", "qtf")).alias("terms"))
    if only is not None:
        wanted = only.groupBy(F.col("question_id").alias("_q")).agg(F.collect_set("chunk_id").alias("wanted"), F.collect_set("page_id").alias("wanted_pages"))
        terms = terms.join(wanted, F.col("question_id").eqNullSafe(F.col("_q"))).drop("_q")
    terms = cut_lineage(terms)
    words = [r.term for r in terms.select(F.explode("terms.term").alias("term")).distinct().collect()]
    stem = stemmer or (lambda word: word)
    names = sorted({stem(w) for w in words})
    place = {t: i for i, t in enumerate(names)}
    code_of = spark.sparkContext.broadcast({w: place[stem(w)] for w in words})
    index = cut_lineage(chunks.select("chunk_id", "page_id", tx.tokenize(F.col("text")).alias("terms")).mapInArrow(_packer(names, stemmer), PACKED))
    size, mean = index.agg(F.sum("n"), F.sum("total") / F.sum("known")).first()
    if not size or not words:
        return spark.createDataFrame([], schema)
    idf = F.log(1 + (F.lit(size) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = index.select("codes", "counts").mapInArrow(_frequencies, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df"))
    weights, often = np.zeros(len(names)), np.zeros(len(names), np.int64)
    for r in df.select("code", "df", idf.alias("idf")).collect():  # the words of the questions
        weights[r.code], often[r.code] = r.idf, r.df
    shared = spark.sparkContext.broadcast((weights, often * COMMON > size))
    common = F.udf(lambda words: str(sorted({code_of.value[w] for w in words if shared.value[1][code_of.value[w]]})), "string")
    # questions with the same common terms go to the same block: those are added up once for all
    hashed = terms.withColumn("bucket", F.pmod(F.xxhash64(common("terms.term")), F.lit(BUCKETS)))
    hashed = cut_lineage(hashed)
    counted = {r.bucket: r["count"] for r in hashed.groupBy("bucket").count().collect()}
    total = sum(counted.values())
    blocks = max(1 + total // QUESTION_BLOCK, min(24, 1 + total // 1_000))
    places = [(bucket, first, parts) for first, (held, parts) in _numbered(_blocks(counted, -(-total // blocks))) for bucket in held]
    placed = hashed.join(F.broadcast(spark.createDataFrame(places, "bucket int, first int, parts int")), "bucket")
    # equal questions stay in one part, where they are ranked once
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.array_sort("terms")), F.col("parts")).cast("int")).drop("bucket", "first", "parts")
    asked = placed.groupBy("block").applyInArrow(_pickled, "block int, asked binary").collect()  # the questions
    runs = [index.drop("n", "known", "total").coalesce(1).mapInArrow(_block_ranker(bytes(r.asked), code_of, shared, depth, k1, b, mean), schema) for r in sorted(asked)]
    # a union of single partitions alone would be one task: the last part, without rows, keeps them apart
    none = index.where("n < 0").select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))])
    return reduce(DataFrame.unionByName, [*runs, none])


def _blocks(counted: dict[int, int], most: int) -> list[tuple[list[int], int]]:
    """Buckets put together to blocks of about ``most`` questions; a bucket of more stands alone, with
    the number of parts it is cut into."""
    out, open_, used = [], [], 0
    for bucket, n in sorted(counted.items(), key=lambda x: (-x[1], x[0])):
        if n > most:
            out.append(([bucket], -(-n // most)))
            continue
        if used + n > most:
            out.append((open_, 1))
            open_, used = [], 0
        open_.append(bucket)
        used += n
    return out + ([(open_, 1)] if open_ else [])


def _numbered(blocks: list[tuple[list[int], int]]) -> list[tuple[int, tuple[list[int], int]]]:
    """Each block with the number of its first part."""
    return list(zip(accumulate((parts for _, parts in blocks), initial=0), blocks))


def _pickled(rows: pa.Table) -> pa.Table:
    """The questions of one block as (question, terms, wanted), in one value: a driver holds them all."""
    rows = rows.combine_chunks()
    of = {c: rows[c].to_pylist() for c in rows.column_names}
    wanted = zip(map(set, of["wanted"]), map(set, of["wanted_pages"])) if "wanted" in of else repeat(None)
    asked = [(q, [(x["term"], x["qtf"]) for x in terms], w) for q, terms, w in zip(of["question_id"], of["terms"], wanted)]
    return pa.table({"block": rows["block"].slice(0, 1), "asked": pa.array([pickle.dumps(asked)], pa.binary())})


def _block_ranker(asked: bytes, *of) -> Callable:
    """``_ranker`` of the questions of ``_pickled``, which become objects only in the task."""
    return lambda batches: _ranker(pickle.loads(asked), *of)(batches)


def _packer(names: list[str], stemmer: Callable[[str], str] | None) -> Callable:
    """(chunk_id, page_id, terms) -> rows of ``PACKED``: the postings of ``names``, by term then chunk."""

    def run(batches):
        known, memo = pa.array(names, pa.string()), {}
        for batch in batches:
            for start in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(start, SEGMENT)
                n, terms = part.num_rows, part.column("terms")
                lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = terms.flatten().dictionary_encode()
                words = coded.dictionary
                if stemmer is not None:
                    for w in words.to_pylist():
                        if w not in memo:
                            memo[w] = stemmer(w)
                    words = pa.array([memo[w] for w in words.to_pylist()], pa.string())
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
                key = (code * n + np.repeat(np.arange(n), lengths))[code >= 0]
                key, tf = np.unique(key, return_counts=True)
                codes, counts = np.unique(key // max(n, 1), return_counts=True)
                blob = [x.astype(np.int32).tobytes() for x in (lengths, codes, counts, key % max(n, 1), tf)]
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([n], pa.int64()), "known": pa.array([n - terms.null_count], pa.int64()), "total": pa.array([int(lengths.sum())], pa.int64()),
                    "ids": pa.array([part.column("chunk_id").to_pylist()], pa.list_(pa.string())), "pages": pa.array([part.column("page_id").to_pylist()], pa.list_(pa.string())),
                    **{k: pa.array([v], pa.binary()) for k, v in zip(("lengths", "codes", "counts", "rows", "tf"), blob)},
                })

    return run


def _frequencies(batches):
    for batch in batches:
        for codes, counts in zip(batch.column("codes"), batch.column("counts")):
            yield pa.RecordBatch.from_pydict({"code": np.frombuffer(codes.as_py(), np.int32), "df": np.frombuffer(counts.as_py(), np.int32).astype(np.int64)})


def _best(score: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ``depth`` greatest scores, of equals those of the smaller ids."""
    at = np.arange(len(score))
    if len(score) > depth:
        at = np.flatnonzero(score >= np.partition(score, -depth)[-depth])
    return at[np.lexsort((ids[at], -score[at]))][:depth]


def _ranker(asked: list, code_of, shared, depth: int, k1: float, b: float, mean: float) -> Callable:
    """Ranks a block of questions over the whole index, in parts of about ``PART_POSTINGS`` postings.

    The weights of a question's common terms are the same vector for all questions that have the same
    ones: it is added up once, with its best chunks in order. A question then adds its rare terms to
    the chunks that have one, and the others can only be the best of the common order.
    """

    def run(batches):
        idf, is_common = shared.value
        bags: dict[tuple, list] = {}
        for question, terms, wanted in asked:
            bag: dict[int, int] = {}
            for term, times in terms:
                bag[code_of.value[term]] = bag.get(code_of.value[term], 0) + times
            common = tuple(sorted((c, n) for c, n in bag.items() if is_common[c]))
            rare = tuple(sorted((c, n) for c, n in bag.items() if not is_common[c]))
            bags.setdefault((common, rare), []).append((question, wanted))
        order = sorted(bags)
        needed = np.zeros(len(idf), bool)
        for pair in order:
            needed[[c for x in pair for c, _ in x]] = True
        ids, pages, best = pa.array([], pa.string()), pa.array([], pa.string()), {}
        for segments in _parts(batches, needed):
            # the best so far and this part's chunks, numbered in the order of their ids
            kept = len(ids)
            ids = pa.concat_arrays([ids, *[s[0] for s in segments]])
            pages = pa.concat_arrays([pages, *[s[1] for s in segments]])
            sort = pc.sort_indices(ids).to_numpy()
            number = np.empty(len(ids), np.int32)
            number[sort] = np.arange(len(ids), dtype=np.int32)
            ids, pages = ids.take(pa.array(sort)), pages.take(pa.array(sort))
            best = {k: (value, number[at]) for k, (value, at) in best.items()}
            at, weight, ends = _columns(segments, idf, number[kept:], k1, b, mean)
            _rank_part(order, best, at, weight, ends, len(ids), depth)
            used = np.unique(np.concatenate([at for _, at in best.values()])) if best else np.zeros(0, np.int32)
            best = {k: (value, np.searchsorted(used, at)) for k, (value, at) in best.items()}
            ids, pages = ids.take(pa.array(used)), pages.take(pa.array(used))
        out, rows = [], 0
        for k in order:
            if k not in best:
                continue
            for question, wanted in bags[k]:
                value, at = best[k]
                rank, of_page = np.arange(1, len(at) + 1, dtype=np.int32), None
                if wanted is not None:
                    met: dict = {}
                    named = [(i, met.setdefault(p, len(met) + 1) if p not in met else None, p) for i, p in zip(ids.take(pa.array(at)).to_pylist(), pages.take(pa.array(at)).to_pylist())]
                    hit = [j for j, (i, r, p) in enumerate(named) if i in wanted[0] or (r is not None and p in wanted[1])]
                    of_page = [named[j][1] for j in hit]
                    rank, at, value = rank[hit], at[hit], value[hit]
                out.append((question, rank, at, value, of_page))
                rows += len(rank)
                if rows >= 50_000:
                    yield _ranked(out, ids, pages)
                    out, rows = [], 0
        if rows:
            yield _ranked(out, ids, pages)

    return run


def _parts(batches, needed: np.ndarray):
    """Lists of (ids, pages, lengths, codes, counts, rows, tf), of the needed terms only."""
    held, postings_held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            lengths, codes, counts, rows, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("lengths", "codes", "counts", "rows", "tf"))
            keep = needed[codes]
            at = np.repeat(keep, counts)
            held.append((batch.column("ids")[i].values, batch.column("pages")[i].values, lengths.copy(), codes[keep], counts[keep], rows[at], tf[at]))
            postings_held += int(at.sum())
            if postings_held >= PART_POSTINGS:
                yield held
                held, postings_held = [], 0
    if held:
        yield held


def _columns(segments: list, idf: np.ndarray, number: np.ndarray, k1: float, b: float, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, weights, ends): the postings of term t are those from ``ends[t]`` to ``ends[t + 1]``."""
    times = np.zeros(len(idf), np.int64)
    for _, _, _, codes, counts, _, _ in segments:
        times[codes] += counts
    ends = np.concatenate([[0], np.cumsum(times)])
    free, first = ends[:-1].copy(), 0
    at, weight = np.empty(ends[-1], np.int32), np.empty(ends[-1])
    for ids, _, lengths, codes, counts, rows, tf in segments:
        to = np.repeat(free[codes] - (np.cumsum(counts) - counts), counts) + np.arange(len(rows))
        norm = k1 * (1 - b + b * lengths[rows] / mean) if mean else k1 * (1 - b)
        at[to], weight[to] = number[first + rows], np.repeat(idf[codes], counts) * tf * (k1 + 1) / (tf + norm)
        free[codes] += counts
        first += len(ids)
    return at, weight, ends


def _rank_part(order: list, best: dict, at: np.ndarray, weight: np.ndarray, ends: np.ndarray, size: int, depth: int) -> None:
    """Put the best ``depth`` (values, chunks) of every bag of terms into ``best``, of those there and of this part."""
    seen, mark = np.full(size, -1, np.int64), 0
    for common, members in groupby(order, key=lambda k: k[0]):
        score = np.zeros(size)
        for c, times in common:
            place = slice(ends[c], ends[c + 1])
            score[at[place]] += times * weight[place]
        rounded = np.round(score, 9)
        first, whole = _first(rounded, 2 * depth) if common else (np.zeros(0, np.int64), True)
        for key in members:
            places = [(slice(ends[c], ends[c + 1]), times) for c, times in key[1] if ends[c + 1] > ends[c]]
            hit, value = np.zeros(0, np.int64), np.zeros(0)
            if places:
                hit = np.concatenate([at[p] for p, _ in places]) if len(places) > 1 else at[places[0][0]]
                if len(places) > 1:
                    seen[hit] = np.arange(mark, mark + len(hit))
                    hit = hit[seen[hit] == np.arange(mark, mark + len(hit))]
                    mark += sum(p.stop - p.start for p, _ in places)
                before = score[hit]
                for p, times in places:
                    score[at[p]] += times * weight[p]  # a chunk has a term once
                value = np.round(score[hit], 9)
                score[hit] = before
                others, all_of = first, whole
                seen[hit] = mark
                others = others[seen[others] != mark]
                if len(others) < depth and not all_of:
                    others, _ = _first(rounded, depth + len(hit))
                    others = others[seen[others] != mark]
                mark += 1
            else:
                others = first
            others = others[:depth]
            if len(others) == depth and len(hit):
                above = value >= rounded[others[-1]]
                hit, value = hit[above], value[above]
            held = [(value, hit), (rounded[others], others), *([best[key]] if key in best else [])]
            values, chunks = np.concatenate([v for v, _ in held]), np.concatenate([c for _, c in held])
            if not (values > 0).all():
                values, chunks = values[values > 0], chunks[values > 0]
            if len(values):
                top = _best(values, chunks, depth)
                best[key] = values[top], chunks[top].astype(np.int32)


def _first(value: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """The places of the greatest values above 0 in order, of equals the smaller place: at least ``n``
    of them, or all, and whether it is all."""
    at = np.flatnonzero(value > 0)
    whole = len(at) <= n
    if not whole:
        at = at[value[at] >= np.partition(value[at], -n)[-n]]
    at = at[np.argsort(-value[at], kind="stable")]
    return at, whole


def _ranked(found: list, ids: pa.Array, pages: pa.Array) -> pa.RecordBatch:
    questions = pa.array([q for q, *_ in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(x[1]) for x in found])))
    at = pa.array(np.concatenate([x[2] for x in found]))
    columns = {
        "question_id": questions, "rank": pa.array(np.concatenate([x[1] for x in found])), "chunk_id": ids.take(at), "page_id": pages.take(at),
        "score": pa.array(np.concatenate([x[3] for x in found])),
    }
    if found[0][4] is not None:
        columns["page_rank"] = pa.array([r for x in found for r in x[4]], pa.int32())
    return pa.RecordBatch.from_pydict(columns)


def _candidates(found: list) -> pd.DataFrame:
    names, ids, pages, scores = zip(*found, strict=True)
    return pd.DataFrame({
        "question_id": np.repeat(np.array(names, object), [len(x) for x in ids]), "chunk_id": np.concatenate(ids), "page_id": np.concatenate(pages), "score": np.concatenate(scores)
    })


def dense_scores(vectors: DataFrame, queries: DataFrame, depth: int | None = None) -> DataFrame:
    """(question_id, chunk_id, page_id, score): the dot product of every vector with every query.

    vectors are (chunk_id, page_id, vector), queries (question_id, vector): the stated query set,
    taken in blocks of at most ``VECTOR_BLOCK``. Exact: every vector is scored. With ``depth`` only the
    best so many of each batch and query come out, which ranking needs at most.
    """
    blocks = 1 + queries.count() // VECTOR_BLOCK
    runs = []
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block).where("vector IS NOT NULL").select("question_id", "vector").collect()
        if asked:
            names, matrix = [r.question_id for r in asked], np.array([r.vector for r in asked], float).T

            def run(batches, names=names, matrix=matrix):
                for batch in batches:
                    if len(batch):
                        ids, pages = batch["chunk_id"].to_numpy(object), batch["page_id"].to_numpy(object)
                        scores = np.round(np.stack(batch["vector"].to_numpy()).astype(float) @ matrix, 9)
                        keep = [_best(scores[:, i], ids, depth) if depth else np.arange(len(ids)) for i in range(len(names))]
                        for i in range(0, len(names), 500):
                            yield _candidates([(names[j], ids[keep[j]], pages[keep[j]], scores[keep[j], j]) for j in range(i, min(i + 500, len(names)))])

            runs.append(vectors.select("chunk_id", "page_id", "vector").where("vector IS NOT NULL").mapInPandas(run, CANDIDATES))
    if not runs:
        return vectors.sparkSession.createDataFrame([], CANDIDATES)
    return reduce(DataFrame.unionByName, runs)


def dense_search(vectors: DataFrame, queries: DataFrame, depth: int = 100) -> DataFrame:
    return rank(dense_scores(vectors, queries, depth), depth)


def fuse(rankings: list[DataFrame], depth: int = 100, k: int = 60, candidates: int = 100) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (k + rank) over the lists' first ``candidates``."""
    if k < 1 or candidates < 1:
        raise ValueError("k and candidates must be at least 1")
    gain = (1 / (k + F.col("rank"))).alias("gain")
    lists = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= candidates).select("question_id", "chunk_id", "page_id", gain) for r in rankings])
    return rank(lists.groupBy("question_id", "chunk_id", "page_id").agg(F.round(F.sum("gain"), 9).alias("score")), depth, positive_only=True)


def rank_pages(scores: DataFrame, depth: int) -> DataFrame:
    """(question_id, rank, page_id, score, best_chunk_id): a page is as good as its best chunk, of
    equals the smaller chunk_id; equal pages go by page_id; ``depth`` counts pages."""
    best = scores.groupBy("question_id", "page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("x"))
    pages = best.select("question_id", "page_id", (-F.col("x.s")).alias("score"), F.col("x.chunk_id").alias("best_chunk_id"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "page_id")
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).select("question_id", "rank", "page_id", "score", "best_chunk_id")


def rerank(ranking: DataFrame, scored: DataFrame, depth: int) -> DataFrame:
    """Put the first ``depth`` in the order of new scores (question_id, chunk_id, rescore); ties
    and the tail keep their order. The new rank is authoritative: head and tail scores differ in scale."""
    joined = ranking.join(scored, ["question_id", "chunk_id"], "left")
    head = F.col("rank") <= depth
    order = Window.partitionBy("question_id").orderBy(~head, F.when(head, -F.col("rescore")).asc_nulls_last(), "rank")
    return joined.withColumn("new", F.row_number().over(order)).select(
        "question_id", F.col("new").alias("rank"), "chunk_id", "page_id", F.when(head, F.col("rescore")).otherwise(F.col("score")).alias("score"), F.col("rank").alias("first_rank")
    )


def pages_of(ranking: DataFrame) -> DataFrame:
    """Pages in the order in which they first appear among a question's chunks."""
    first = ranking.groupBy("question_id", "page_id").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("question_id").orderBy("first")
    return first.select("question_id", F.row_number().over(order).alias("rank"), "page_id")


def shared_words(question: str, passage: str) -> float:
    """Stand-in scorer: how many words of the question the passage has."""
    return float(len(set(question.lower().split()) & set(passage.lower().split())))


def score_pairs(pairs: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], known: DataFrame | None = None) -> DataFrame:
    """(question, text) -> (question, text, rescore), each distinct pair scored once.

    ``scorer`` takes a batch of questions and passages. Pairs in ``known`` are not scored again.
    """
    distinct = pairs.select("question", "text").distinct()
    new = distinct if known is None else distinct.join(known, ["question", "text"], "left_anti")

    def run(batches):
        for b in batches:
            yield b.assign(rescore=np.asarray(scorer(b["question"].tolist(), b["text"].tolist()), float))

    scored = new.mapInPandas(run, "question string, text string, rescore double")
    return scored if known is None else scored.unionByName(distinct.join(known, ["question", "text"]))


def hashing_encoder(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """Stand-in encoder: unit vectors of hashed words."""
    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % dimensions] += 1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def encode_missing(texts: DataFrame, known: DataFrame | None, encoder=hashing_encoder, text_col: str = "text") -> DataFrame:
    """(text_key, vector) of each distinct text that ``known`` lacks: what a cache appends."""
    distinct = texts.select(tx.digest(F.col(text_col), 32).alias("text_key"), F.col(text_col).alias("text")).dropDuplicates(["text_key"])
    misses = distinct if known is None else distinct.join(known, "text_key", "left_anti")

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"text_key": b["text_key"], "vector": list(encoder(b["text"].tolist()).astype("float16").astype("float32"))})

    return misses.where("text IS NOT NULL").mapInPandas(run, "text_key string, vector array<float>")


def encoded(rows: DataFrame, text_col: str, encoder: Callable[[list[str]], np.ndarray], prefix: str = "") -> DataFrame:
    """``rows`` with the ``vector`` of their text, each distinct text encoded once; ``prefix`` is the
    instruction that a model wants before questions."""
    texts = rows.withColumn("text", F.concat(F.lit(prefix), F.col(text_col)))
    vectors = cut_lineage(encode_missing(texts, None, encoder))
    return rows.withColumn("text_key", tx.digest(F.concat(F.lit(prefix), F.col(text_col)), 32)).join(vectors, "text_key").drop("text_key")


#: Encoders and scorers by name; callers register trained ones.
ENCODERS: dict[str, Callable] = {"hashing": hashing_encoder}
SCORERS: dict[str, Callable] = {"shared-words": lambda q, p: [shared_words(a, b) for a, b in zip(q, p, strict=True)]}


def named(registry: dict[str, Callable], name: str) -> Callable:
    """The model of a name; another name raises and lists those that are known."""
    if name not in registry:
        raise KeyError(f"unknown model {name!r}; known: {', '.join(sorted(registry))}")
    return registry[name]


class LiveSearch:
    """Answers one question at a time from indexes that were written once, one for each setup."""

    def __init__(self, indexes: dict[str, DataFrame], chunks: DataFrame):
        self.indexes, self.chunks = indexes, chunks

    def __call__(self, setup: str, question: str, depth: int = 10) -> DataFrame:
        """(rank, chunk_id, page_id, score, heading, body) of the best passages; an unknown setup raises.
        Only postings of the question's terms are read, and the texts of what is shown."""
        if setup not in self.indexes:
            raise KeyError(f"unknown setup {setup!r}; known: {', '.join(sorted(self.indexes))}")
        spark = self.chunks.sparkSession
        terms = query_terms(spark.createDataFrame([("q", question)], "question_id string, question string"))
        asked = [(r.term, r.qtf) for r in terms.collect()]  # the words of one question
        index = self.indexes[setup].where(F.col("term").isin([t for t, _ in asked]))
        known = spark.createDataFrame([("q", *t) for t in asked], "question_id string, term string, qtf bigint")
        best = rank(bm25_scores(index, F.broadcast(known)), depth, positive_only=True)
        shown = self.chunks.join(F.broadcast(best), ["chunk_id", "page_id"])
        return shown.select("rank", "chunk_id", "page_id", "score", tx.heading(F.col("text")).alias("heading"), tx.body(F.col("text")).alias("body")).orderBy("rank")
