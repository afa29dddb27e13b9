"""Values worked by hand."""

import datetime as dt
import json
import logging
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallforge.functions import sentences, stem
from recallforge.functions import text as tx
from recallforge.operators import answers, chunking, corpus, models, ordered, page_build, report, retrieval, sampling, stats
from recallforge.operators import evaluation as ev
from recallforge.plans import artefacts, build, config, grid, queries
from recallforge.sources import files
from recallforge.streaming import caches


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first().x


def test_bm25_of_three_chunks(spark):
    chunks = spark.createDataFrame([("c1", "p1", "tea tea leaves"), ("c2", "p2", "black tea"), ("c3", "p3", "river water")], "chunk_id string, page_id string, text string")
    asked = spark.createDataFrame([("a", "tea"), ("b", "river black"), ("c", "tea tea"), ("d", "nothing")], "question_id string, question string")
    by_join = retrieval.rank(retrieval.bm25_scores(retrieval.postings(chunks, 1.2, 0.75), retrieval.query_terms(asked)), 10)
    by_block = retrieval.bm25_search(chunks, asked, 10, 1.2, 0.75)
    found = {(r.question_id, r.chunk_id): round(r.score, 6) for r in by_join.collect()}
    assert found == {(r.question_id, r.chunk_id): round(r.score, 6) for r in by_block.collect()}
    assert found[("a", "c1")] == 0.598186 and found[("a", "c2")] == 0.499176
    assert found[("b", "c2")] == found[("b", "c3")] == 1.041708 and found[("c", "c1")] == 1.196373
    assert [r.chunk_id for r in by_join.where("question_id = 'b'").orderBy("rank").collect()] == ["c2", "c3"]
    with pytest.raises(ValueError):
        retrieval.postings(chunks, -1)


def some_texts(spark):
    """Chunks of common and rare words, many of equal scores, and questions of both."""
    words = [f"w{i}" for i in range(90)]
    chunks = [(f"p{i % 90}#{i}", f"p{i % 90}", f"the {'of ' * (i % 3)}{words[i * 7 % 90]} {words[i * i % 90]} flows") for i in range(600)]
    asked = [(f"q{i}", f"{('the of', 'the the', 'of', '')[i % 4]} {words[i % 90] if i % 5 else ''} {words[i * 3 % 90]} flowing") for i in range(60)]
    return spark.createDataFrame(chunks, "chunk_id string, page_id string, text string"), spark.createDataFrame([*asked, ("none", "zzz"), ("null", None)], "question_id string, question string")


def test_search_by_blocks_equals_the_join(spark):
    chunks, asked = some_texts(spark)
    by_block, joined = retrieval.bm25_search(chunks, asked, 7), retrieval.rank(retrieval.bm25_scores(retrieval.postings(chunks), retrieval.query_terms(asked)), 7, positive_only=True)
    assert sorted(by_block.collect()) == sorted(joined.select(by_block.columns).collect()) and by_block.count() > 400
    plan = by_block._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan  # neither candidates nor postings are shuffled


def test_blocks_run_side_by_side(spark, monkeypatch):
    chunks, asked = some_texts(spark)
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 15)
    found = retrieval.bm25_search(chunks, asked, 7)
    assert found.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= 3
    monkeypatch.undo()
    assert sorted(found.collect()) == sorted(retrieval.bm25_search(chunks, asked, 7).collect())


def test_parts_of_the_index_are_merged(spark, monkeypatch):
    chunks, asked = some_texts(spark)
    expected = sorted(tuple(r) for r in retrieval.bm25_search(chunks, asked, 7).collect())
    monkeypatch.setattr(retrieval, "SEGMENT", 50)
    monkeypatch.setattr(retrieval, "PART_POSTINGS", 300)
    rows = chunks.select("chunk_id", "page_id", tx.tokenize(F.col("text")).alias("terms")).toArrow()
    terms = [(r.question_id, [(t, 1) for t in r.terms or []], None) for r in asked.select("question_id", tx.tokenize(F.col("question")).alias("terms")).collect()]
    names = sorted({t for _, found, _ in terms for t, _ in found})
    packed = list(retrieval._packer(names, None)(rows.to_batches()))
    df = np.zeros(len(names))
    for batch in retrieval._frequencies(packed):
        df[batch.column("code").to_numpy()] += batch.column("df").to_numpy()
    n, mean = len(rows), sum(map(len, rows["terms"].to_pylist())) / len(rows)

    class Held:
        def __init__(self, value):
            self.value = value

    shared = Held((np.log(1 + (n - df + 0.5) / (df + 0.5)), df * retrieval.COMMON > n))
    found = retrieval._ranker(terms, Held({t: i for i, t in enumerate(names)}), shared, 7, 0.9, 0.4, mean)(packed)
    assert len(packed) >= 12 and sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == expected


def test_stemmed_search_equals_the_join(spark):
    chunks, asked = some_texts(spark)
    stems = config.stems_of(chunks.select("text"), asked.select(F.col("question").alias("text")))
    joined = retrieval.rank(retrieval.bm25_scores(retrieval.postings(chunks, stems=stems), retrieval.query_terms(asked, stems)), 9, positive_only=True)
    found = retrieval.bm25_search(chunks, asked, 9, stemmer=stem.stem)
    assert sorted(found.collect()) == sorted(joined.select(found.columns).collect())
    assert found.where("question_id = 'q4'").count() == 9  # flowing finds flows


def test_questions_are_collected_once(spark, monkeypatch):
    chunks, asked = some_texts(spark)
    asked = asked.unionByName(asked.select(F.concat("question_id", F.lit("-again")).alias("question_id"), "question"))
    tracker, jobs, found = spark.sparkContext.statusTracker(), {}, {}
    for most in (200, 3):
        monkeypatch.setattr(retrieval, "QUESTION_BLOCK", most)
        spark.sparkContext.setJobGroup(f"search{most}", "search")
        ranking = retrieval.bm25_search(chunks, asked, 7, stemmer=stem.stem)
        jobs[most] = len(tracker.getJobIdsForGroup(f"search{most}"))
        spark.sparkContext.setJobGroup("rest", "rest")
        found[most] = sorted(ranking.collect())
        in_parts = {}
        for r in ranking.withColumn("p", F.spark_partition_id()).collect():
            in_parts.setdefault(r.question_id.removesuffix("-again"), set()).add(r.p)
        # a question asked twice is ranked once: both stay in one part, however many parts there are
        assert all(len(p) == 1 for p in in_parts.values())
    assert len({p for ps in in_parts.values() for p in ps}) >= 10
    assert found[200] == found[3] and jobs[3] <= jobs[200] + 3


def test_windows_are_cut_with_plain_classes(spark):
    text = "\u2003one two\u3000\u0085three\x0bfour\u00a0\n five six\x1cseven 𝒳 eight\u2028"
    pages = spark.createDataFrame([("p", "T", text)], "page_id string, title string, text string")
    found = chunking.fixed_chunks(pages, chunking.ChunkSettings("fixed_words", 3, 1))
    rows = sorted((r.start, r.end, r.text) for r in found.collect())
    assert [r[2] for r in rows] == ["T\none two\u3000\u0085three", "T\nthree\x0bfour\u00a0\n five", "T\nfive six\x1cseven 𝒳", "T\n𝒳 eight"]
    assert all(text[a:b] == body[2:] for a, b, body in rows)
    # rare spaces in a class of every word make the expression several times slower
    assert r"\x{2028}" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_resampling_holds_few_draws_at_once():
    import tracemalloc

    diffs = np.random.default_rng(3).choice([0.0, 0.5, -1.0, 1 / 3], 20_001)
    tracemalloc.start()
    p, interval = stats.randomisation(diffs, 700), stats.bootstrap(diffs, 700)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    signs, drawn = np.random.default_rng(1).choice([-1.0, 1.0], (700, len(diffs))), np.random.default_rng(1).integers(0, len(diffs), (700, len(diffs)))
    assert p == ((np.abs((signs * diffs).mean(axis=1)) >= abs(diffs.mean()) - 1e-12).sum() + 1) / 701
    assert interval == tuple(np.quantile(diffs[drawn].mean(axis=1), [0.025, 0.975]))
    assert peak < 20e6


def test_metrics_of_one_ranking(spark):
    ranking = spark.createDataFrame([("q", i + 1, f"d{i + 1}") for i in range(5)], "question_id string, rank int, doc_id string")
    judged = spark.createDataFrame([("q", d, 1) for d in ("d2", "d4", "d9")] + [("z", "d1", 1)], "question_id string, doc_id string, grade int")
    found = {(r.question_id, r.metric): r.value for r in ev.question_metrics(ranking, judged, [3, 5, 10]).collect()}
    assert found["q", "recall@3"] == pytest.approx(1 / 3) and found["q", "recall@5"] == pytest.approx(2 / 3)
    assert found["q", "ndcg@5"] == pytest.approx(0.498189, abs=1e-6) and found["q", "ndcg@3"] == pytest.approx(0.296082, abs=1e-6)
    assert found["q", "precision@10"] == pytest.approx(0.2) and found["q", "rr@5"] == 0.5
    assert found["z", "ndcg@5"] == 0.0
    with pytest.raises(ValueError):
        ev.check_inputs(ranking, judged, [0])


def test_fusion_and_pages(spark):
    lists = [spark.createDataFrame([("q", i + 1, c, c[0]) for i, c in enumerate(x)], "question_id string, rank int, chunk_id string, page_id string") for x in (["a1", "b1"], ["b1", "a2"])]
    fused = retrieval.fuse(lists)
    assert {r.chunk_id: r.score for r in fused.collect()} == {"b1": pytest.approx(1 / 62 + 1 / 61, abs=1e-9), "a1": pytest.approx(1 / 61, abs=1e-9), "a2": pytest.approx(1 / 62, abs=1e-9)}
    assert [r.page_id for r in retrieval.rank_pages(fused, 10).orderBy("rank").collect()] == ["b", "a"]


def test_rerank_moves_the_head_only(spark):
    ranking = spark.createDataFrame([("q", i + 1, c, c, 5.0 - i) for i, c in enumerate("abcde")], "question_id string, rank int, chunk_id string, page_id string, score double")
    scored = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0), ("q", "c", 2.0), ("q", "d", 0.0)], "question_id string, chunk_id string, rescore double")
    assert [r.chunk_id for r in retrieval.rerank(ranking, scored, 4).orderBy("rank").collect()] == list("cabde")


def test_statistics(spark):
    tested = stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double"), "p", ["k"])
    assert {r.k: round(r.p_holm, 9) for r in tested.collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    rated = spark.createDataFrame(rows, "a string, b string")
    assert stats.kappa(rated, "a", "b").first().kappa == pytest.approx(0.4)
    low, high = stats.kappa_bootstrap(stats.confusion(rated, "a", "b"), 500).first()
    assert low < 0.4 < high
    scores = spark.createDataFrame([(0.1, False), (0.4, False), (0.35, True), (0.8, True)], "s double, y boolean")
    assert stats.roc_auc(scores, "s", "y").first().auc == 0.75
    assert stats.kappa(rated.where("a = 'y' AND b = 'y'"), "a", "b").first().kappa is None
    assert stats.randomisation(np.array([1.0] * 8), 2000) < 0.05 and stats.bootstrap(np.array([2.0, 2.0]))[0] == 2.0


def test_text(spark):
    assert one(spark, tx.normalise_answer(F.col("t")), t="The  Quick, a an Fox!") == "quick fox"
    assert one(spark, tx.contains_reference(F.col("t"), F.array(F.lit("The fox"), F.lit("!"))), t="a quick fox") is True
    assert one(spark, tx.contains_reference(F.col("t"), F.array(F.lit("fo"))), t="a quick fox") is False
    assert one(spark, tx.is_declined(F.col("t")), t=' "I don’t know." ') is True
    assert one(spark, tx.tag_name(F.col("t")), t='<Td colspan="6">') == "TD" and one(spark, tx.is_closing(F.col("t")), t="</p>") is True
    assert one(spark, tx.answer_type(F.lit("LI"))) == "list" and one(spark, tx.body(F.col("t")), t="head") == ""
    assert one(spark, tx.cost(F.lit(1000), F.lit(20), F.lit(100), 0.1, 0.5)) == pytest.approx(0.00016)
    assert [stem.stem(w) for w in ("rings", "flows", "relational", "happy", "skies", "agreed", "hopping")] == ["ring", "flow", "relat", "happi", "sky", "agre", "hop"]
    text = "Dr. Ada wrote it. It ran!  Did it? Yes"
    assert [text[a:b] for a, b in sentences.sentence_spans(text)] == ["Dr. Ada wrote it.", "It ran!", "Did it?", "Yes"]
    assert sentences.sentence_spans(" \n") == []


def test_fixed_windows(spark):
    pages = spark.createDataFrame([("p", "T", " w1 w2 w3\n\nw4 w5 w6 w7 w8 w9 w10 w11 w12 "), ("e", None, ""), ("n", "x", None)], "page_id string, title string, text string")
    found = chunking.fixed_chunks(pages, chunking.ChunkSettings(size=6, overlap=2)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in found] == ["p#0", "p#1", "p#2"]
    assert found[0].text == "T\nw1 w2 w3\n\nw4 w5 w6" and found[0].start == 1 and found[2].text.endswith("w9 w10 w11 w12")
    with pytest.raises(ValueError):
        chunking.ChunkSettings(size=3, overlap=3)


def test_packing_and_tables():
    assert chunking.pack([3, 3, 3, 3], 7, 3) == [(0, 2), (1, 3), (2, 4)]
    assert chunking.pack([9, 2], 5, 0) == [(0, 1), (1, 2)]
    block = {"kind": "table", "section": "S", "caption": "C", "text": "a b\nc d\ne f", "start": 10, "end": 21, "rows": [["a", "b"], ["c", "d"], ["e", "f"]]}
    found = chunking.chunk_page("p", "T", [block], chunking.ChunkSettings("section_aware", 4, 0))
    assert [(c[3], c[4], c[5], c[6]) for c in found] == [("T > S > C\na b\nc d", 10, 17, "table"), ("T > S > C\ne f", 18, 21, "table")]
    assert chunking.chunk_page("p", "T", [block], chunking.ChunkSettings("fixed_words", 9, 0, True))[0][3] == "T > S\na b c d e f"


def stream(text):
    at, out = 0, []
    for t in text.split():
        glued, t = t.startswith("~"), t.removeprefix("~")
        at += 0 if glued else 1
        out.append((t, t.startswith("<"), at, at + len(t)))
        at += len(t)
    return out


def test_page_from_tokens(spark):
    tokens = stream("<H1> Dublin </H1> <P> It is in Ireland ~. </P> <H2> History </H2> <P> Founded 841 <H2> References </H2> <LI> gone <H2> Facts </H2> "
                    "<TABLE> <CAPTION> Census </CAPTION> <TR> <TH> Year </TH> <TH> People </TH> </TR> <TR> <TD> 1841 </TD> <TD> 232,726 </TD> </TR> </TABLE>")
    rows = spark.createDataFrame([("p", "Dublin", "u", tokens), ("e", None, None, None)], "page_id string, title string, url string, stream array<struct<token:string,is_html:boolean,start_byte:int,end_byte:int>>")
    found = {r.page_id: r for r in page_build.build_pages(rows).collect()}
    page = found["p"]
    assert [(b.kind, b.section, b.text) for b in page.blocks] == [
        ("heading", "", "Dublin"), ("paragraph", "", "It is in Ireland."), ("heading", "History", "History"), ("paragraph", "History", "Founded 841"),
        ("heading", "Facts", "Facts"), ("table", "Facts", "Year: 1841 | People: 232,726"),
    ]
    assert all(page.text[b.start : b.end] == b.text for b in page.blocks) and page.blocks[-1].caption == "Census"
    at = next(i for i, t in enumerate(tokens) if t[0] == "232,726")
    assert page.text[page.token_spans[at].start : page.token_spans[at].end] == "232,726"
    assert page.token_spans[next(i for i, t in enumerate(tokens) if t[0] == "gone")] is None
    assert found["e"].text == "" and found["e"].blocks == []
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.lit(None), F.struct(F.lit(5).alias("start"), F.lit(9).alias("end")))
    assert tuple(one(spark, corpus.char_span(spans, F.lit(0), F.lit(3)))) == (1, 9) and one(spark, corpus.char_span(spans, F.lit(1), F.lit(2))) is None


def test_pages_are_built_a_few_tokens_at_a_time():
    words = [{"token": f"w{i % 50}", "is_html": False, "start_byte": 10 * i, "end_byte": 10 * i + 5} for i in range(400)]
    page = [{"token": "<P>", "is_html": True, "start_byte": -9, "end_byte": -6}, *words]
    kind = pa.list_(pa.struct([("token", pa.string()), ("is_html", pa.bool_()), ("start_byte", pa.int32()), ("end_byte", pa.int32())]))
    streams = pa.concat_arrays([pa.array([page, None, []], kind)] * 400)
    ids = pa.array([str(i) for i in range(len(streams))])
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, streams], ["page_id", "title", "url", "stream"])
    seen = []
    for out in page_build.built_batches([batch]):
        assert sum(out.column("content_tokens").to_pylist()) <= page_build.TOKENS
        seen += out.select(["page_id", "text", "content_tokens"]).to_pylist()
    text = " ".join(w["token"] for w in words)
    assert seen == [{"page_id": str(i), "text": "" if i % 3 else text, "content_tokens": 0 if i % 3 else 400} for i in range(1200)]


def test_corpus_writes_neither_blocks_nor_token_spans(spark, monkeypatch):
    written = []
    monkeypatch.setattr(build, "cut_lineage", lambda df: (written.append(df.columns), df)[1])
    build.build_corpus(queries._token_rows(spark, "/root/testdata/sf0.001"))
    assert written and not {"blocks", "token_spans", "stream"} & {c for columns in written for c in columns}


def test_references_are_looked_for_in_bodies(spark):
    ranking = spark.createDataFrame([("a", 1, "c1"), ("a", 2, "c2"), ("a", 3, "c3"), ("b", 1, "c3"), ("c", 1, "c1")], "question_id string, rank int, chunk_id string")
    chunks = spark.createDataFrame([("c1", "Lake\nNo the towns."), ("c2", "Head\nBy a Lake, old"), ("c3", "Head\nlake")], "chunk_id string, text string")
    told = spark.createDataFrame([("a", ["", "The lake!", None]), ("b", ["the"]), ("c", None)], "question_id string, short_answers array<string>")
    found = report.text_ranks(ranking, chunks, told, told)
    assert {r.question_id: r["rank"] for r in found.collect()} == {"a": 2, "b": None, "c": None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # before the joins: once for a chunk and once for a question
    assert plan.index("Join Inner") < plan.index("regexp_replace")


def test_judged_rows_of_the_whole_ranking(spark):
    chunks, asked = some_texts(spark)
    whole = retrieval.bm25_search(chunks, asked, 50)
    only = spark.createDataFrame([("q1", "p1#1", None), ("q2", "none", None), ("q3", None, "p3"), ("q8", "p9#99", "p9")], "question_id string, chunk_id string, page_id string")
    found = {(r.question_id, r.chunk_id): (r.rank, r.page_rank) for r in retrieval.bm25_search(chunks, asked, 50, only=only).collect()}
    ranks = {(r.question_id, r.chunk_id): (r.rank, r.page_id) for r in whole.collect()}
    pages = {(r.question_id, r.page_id): r["rank"] for r in retrieval.pages_of(whole).collect()}
    firsts = {}
    for (q, c), (rank, p) in sorted(ranks.items(), key=lambda x: x[1][0]):
        firsts.setdefault((q, p), c)
    wanted = {(q, c) for q, c in ranks if (q, c) in (("q1", "p1#1"), ("q8", "p9#99"))} | {(q, c) for (q, p), c in firsts.items() if (q, p) in (("q3", "p3"), ("q8", "p9"))}
    assert wanted and found == {(q, c): (ranks[q, c][0], pages[q, ranks[q, c][1]] if firsts[q, ranks[q, c][1]] == c else None) for q, c in wanted}


@pytest.mark.parametrize("stemmed", ["false", "true"])
def test_experiment_by_judged_rows(spark, stemmed):
    text = grid.to_toml(grid.setup("fixed", "bm25", False)).replace("stem = true", f"stem = {stemmed}")
    sf = "/root/testdata/sf0.001"
    given = (config.parse(text), queries._pages(spark, sf), queries._asked(spark, sf), queries._spans(queries._asked(spark, sf)))
    part, whole = config.run_experiment(*given, whole=False), config.run_experiment(*given)
    assert part["ranking"].count() < whole["ranking"].count() / 5
    assert sorted(part["metrics"].collect()) == sorted(whole["metrics"].collect())


def test_top_rows_of_the_join_need_no_joined_rows(spark):
    found = queries.bm25_join_topk(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_samples_and_selection(spark):
    rows = spark.createDataFrame([(f"q{i}", "a" if i < 6 else "b" if i < 9 else None) for i in range(10)], "question_id string, t string")
    assert {r.t: r.quota for r in sampling.quotas(rows, "t", 5).collect()} == {"a": 3, "b": 1, None: 1}
    assert sampling.stratified(rows, "t", "question_id", 5).count() == 5
    assert sampling.draw_like_python(["b", "a", "c"], 5, 1) == ["a", "b", "c"]
    table = report.setup_table(spark.createDataFrame([("fixed-bm25", 0.1), ("x", 0.9), ("y", 0.8), ("z", 0.7), ("w", 0.05), ("v", 0.6)], "setup string, m double"), "m")
    assert [r.setup for r in report.select_setups(table, "m").orderBy("choice").collect()] == ["fixed-bm25", "w", "x", "y", "z"]
    with pytest.raises(ValueError):
        report.select_setups(table, "m", "missing")


def test_experiment(spark):
    toml = 'name = "fixed-bm25"\n[corpus]\nname = "c"\n[retrieval]\nmethod = "bm25"\ndepth = 10\n[retrieval.bm25]\n[rerank]\nmodel = "m"\ndepth = 2\n[evaluation]\ncutoffs = [1, 5]\n'
    experiment = config.parse(toml)
    pages = spark.createDataFrame([("t", "Tea", "green tea leaves"), ("r", "River", "the long rivers")], "page_id string, title string, text string")
    asked = spark.createDataFrame([("q1", "tea", "paragraph"), ("q2", "river", "list"), ("q9", "tea", "list")], "question_id string, question string, answer_type string")
    spans = spark.createDataFrame([("q1", "t", 0, 5), ("q2", "r", 4, 8), ("q9", "gone", 0, 1)], "question_id string, page_id string, start int, end int")
    found = config.run_experiment(experiment, pages, asked, spans, scorer=lambda q, p: [retrieval.shared_words(a, b) for a, b in zip(q, p)])
    with pytest.raises(ValueError):
        config.run_experiment(experiment, pages, asked, spans)
    assert [r.question_id for r in found["excluded"].collect()] == ["q9"]
    averages = {(r.level, r.answer_type, r.metric): r.value for r in found["averages"].collect()}
    assert averages["passage", "all", "ndcg@5"] == 1.0 and averages["page", "list", "mrr@1"] == 1.0
    plain = toml[: toml.index("[rerank]")] + toml[toml.index("[evaluation]") :]
    # only stems find the page of rivers
    asked = asked.withColumn("question", F.when(F.col("question_id") == "q2", F.lit("Rivering")).otherwise(F.col("question")))
    for text, best in ((plain, 1.0), (plain.replace("[retrieval.bm25]", "[retrieval.bm25]\nstem = false"), 0.5)):
        averages = {(r.level, r.answer_type, r.metric): r.value for r in config.run_experiment(config.parse(text), pages, asked, spans)["averages"].collect()}
        assert averages["passage", "all", "recall@5"] == best
    with pytest.raises(ValueError):
        config.run_experiment(config.parse(plain.replace('name = "c"', 'name = "c"\nquery_limit = 3')), pages, asked, spans)
    limited = config.run_experiment(config.parse(plain.replace('name = "c"', 'name = "c"\nquery_limit = 1')), pages, asked, spans)
    assert limited["questions"].count() == 1
    sections = config.parse(plain.replace("[retrieval]", '[chunking]\nstrategy = "sentence_aware"\nsize = 2\noverlap = 0\n[retrieval]'))
    assert config.run_experiment(sections, pages, asked, spans)["chunks"].count() == 2
    for wrong in (toml.replace("depth = 10", 'depth = "10"'), toml + "extra = 1\n", toml.replace("bm25]", "dense]"), toml.replace("[1, 5]", "[1, 50]")):
        with pytest.raises(config.ConfigError):
            config.parse(wrong)


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("q", 1, "q Q0 c 1 2 t"), ("q", 2, "q Q0 d 2 1 t")], "question_id string, rank int, line string")
    files.write_trec(rows, str(tmp_path / "run"))
    assert [r.chunk_id for r in files.read_trec(spark, str(tmp_path / "run"), 1).collect()] == ["c"]
    cache = files.Cache(spark, str(tmp_path / "cache"))
    cache.put(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"))
    cache.put(spark.createDataFrame([("a", "3")], "key string, value string"))
    assert {r.key: r.value for r in cache.get().collect()} == {"a": "3", "b": "2"}
    source = spark.createDataFrame([("b", "9"), ("c", "4")], "key string, value string")
    source.write.parquet(str(tmp_path / "new"))
    caches.append_new(spark.readStream.schema("key string, value string").parquet(str(tmp_path / "new")), cache, str(tmp_path / "state")).awaitTermination()
    assert {r.key: r.value for r in cache.get().collect()} == {"a": "3", "b": "2", "c": "4"}
    files.publish(str(tmp_path), "r1", {"result.json": {"a": 1}})
    assert files.latest_run(str(tmp_path)).name == "r1"
    with pytest.raises(FileExistsError):
        files.publish(str(tmp_path), "r1", {})
    questions = spark.createDataFrame([("q", "what", "p", 0, 1, ["x"], "list")], files.SCHEMAS["questions"])
    files.write_jsonl(questions, str(tmp_path / "questions"), ["question_id"], True)
    assert files.read_jsonl(spark, str(tmp_path / "questions"), "questions").collect() == questions.collect()
    (tmp_path / "bad.json").write_text('{"question_id": "q", "answer_start": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.read_jsonl(spark, str(tmp_path / "bad.json"), "questions").collect()


def test_answers(spark):
    rows = spark.createDataFrame([("s", 1.0, i) for i in range(60)], "setup string, cost double, n int")
    guarded = answers.cost_guard(rows, ["n"], 100, 50.0)
    assert guarded.where("stop").agg(F.min("call")).first()[0] == 50
    assert math.isclose(one(spark, answers.strongest_entailment(F.array(F.lit(0.2), F.lit(0.7)))), 0.7)
    empty = answers.setup_summary(spark.createDataFrame([("s", True, False, None)], "setup string, declined boolean, contains boolean, lexical double")).first()
    assert empty.supported == 0.0 and empty.declined == 1.0


def test_grid_files_are_valid(tmp_path):
    (tmp_path / "old.toml").write_text("")
    names = grid.write(str(tmp_path))
    assert len(names) == 30 and not (tmp_path / "old.toml").exists()
    assert {config.load(str(tmp_path / n)).name + ".toml" for n in names} == set(names)


def test_grid_files_say_what_their_cells_are():
    for cell in (("fixed", "bm25", False), ("section", "hybrid-qwen3", True, True), ("sentence", "minilm", False)):
        assert config.parse(grid.to_toml(grid.setup(*cell))) == grid.setup(*cell)
    found = config.parse_stage_two('name = "x"\nsetups = ["a", "b"]\nquestions = 10\n[writer]\nmodel = "w"\n')
    assert found.setups == ("a", "b") and found.passages == 10
    for wrong in ('name = "x"\nsetups = []\nquestions = 10\n[writer]\nmodel = "w"\n', 'name = "x"\nsetups = ["a"]\nquestions = 1\n'):
        with pytest.raises(config.ConfigError):
            config.parse_stage_two(wrong)


def test_models_are_asked_once(spark, tmp_path):
    asked = spark.createDataFrame([("s", "q1", "where is it", ["T\nIt is here. Not", "T\nElse"]), ("t", "q1", "where is it", ["T\nIt is here. Not", "T\nElse"])], "setup string, question_id string, question string, passages array<string>")
    cache = files.Cache(spark, str(tmp_path / "replies"))
    written = models.write_answers(asked, models.extractive_writer, "w", cache)
    assert {r.text for r in written.collect()} == {"It is here. Not"} and cache.get().count() == 1
    judged = models.judge_answers(written, models.overlap_judge, "j")
    assert {r.verdict for r in judged.collect()} == {"supported"}
    with pytest.raises(Exception, match="rubric"):
        models.judge_answers(written, lambda p: ["?"] * len(p), "j").collect()


@pytest.fixture(scope="module")
def improved(spark, tmp_path_factory):
    """Retrieval rows in which each of 15 rerankers is better on every day."""
    folder = tmp_path_factory.mktemp("improved")
    rows = [(f"{s}{r}-{d}", f"s{s}{r}", f"2025-01-{d:02d}", 0.5 + 0.01 * (d % 3) + (0.1 if r else 0.0)) for s in range(15) for r in ("", "-rerank") for d in range(1, 21)]
    spark.createDataFrame(rows, "run_id string, setup string, at string, passage_ndcg_at_10 double").select(
        "run_id", "setup", F.to_timestamp("at").alias("run_at"), "passage_ndcg_at_10"
    ).write.parquet(str(folder / "retrieval_rows.parquet"))
    return str(folder)


def test_headline_can_count_an_improvement(spark, improved):
    assert tuple(queries.QUERIES["headline_counts"](spark, improved).first()) == (15, 15)


def test_setups_are_compared_by_all_trials(spark, improved):
    found = queries.QUERIES["compare_setups"](spark, improved).collect()
    assert len(found) == 15 and all(r.p_value < 1 / 2_001 for r in found)


def test_corpus_of_dataset_rows(spark):
    """Two revisions of Dublin, the longer one kept; an answer that moved, one that is gone, a table."""
    def row(n, title, source, answer, spare=False):
        tokens, at = [], 0
        for word in source.split():
            glued = word.startswith("~")
            word = word.removeprefix("~")
            at += 0 if glued else 1
            tokens.append((word, word.startswith("<"), at, at + len(word)))
            at += len(word)
        first = tokens.index(next(t for t in tokens if t[0] == answer[0])) - 1
        long = [{"start_token": first, "end_token": first + answer[1], "candidate_index": 0}] * 2 + [{"start_token": -1, "end_token": -1, "candidate_index": -1}]
        short = [{"text": [answer[0]]}] * 2 + [{"text": []}]
        if spare:
            long, short = long[2:], short[2:]
        columns = [list(x) for x in zip(*tokens)]
        return ("f", n, {"title": title, "url": f"u{n}", "tokens": dict(zip(("token", "is_html", "start_byte", "end_byte"), columns))}, {"text": f"q{n}?"}, {"long_answer": long, "short_answers": short})

    long = "<H1> Dublin </H1> <P> Dublin is in Ireland ~. </P> <H2> History </H2> <P> Founded in 841 ~. </P> <H2> References </H2> <P> gone </P>"
    rows = [
        row(0, "Dublin", long, ("Founded", 6)),
        row(1, "Dublin", "<P> Founded in 841 ~. </P>", ("Founded", 6)),
        row(2, "Dublin", "<P> Another town ~. </P>", ("Another", 5)),
        row(3, "Dublin", "<H2> Notes </H2> <P> lost words </P>", ("lost", 4)),
        row(4, "Paris", "<TABLE> <TR> <TD> Paris </TD> </TR> </TABLE>", ("Paris", 3)),
        row(5, "Rome", "<P> Rome </P>", ("Rome", 3), True),
    ]
    schema = """file string, row_index bigint, document struct<title:string,url:string,tokens:struct<token:array<string>,is_html:array<boolean>,start_byte:array<int>,end_byte:array<int>>>,
        question struct<text:string>, annotations struct<long_answer:array<struct<start_token:int,end_token:int,candidate_index:int>>,short_answers:array<struct<text:array<string>>>>"""
    found = build.build_corpus(spark.createDataFrame(rows, schema))
    counters = found["counters"].first().asDict()
    assert {k: counters[k] for k in ("rows", "without_agreed_answer", "pages", "own", "relocated", "not_relocatable", "dropped_span")} == {
        "rows": 6, "without_agreed_answer": 1, "pages": 3, "own": 2, "relocated": 1, "not_relocatable": 1, "dropped_span": 1,
    }
    text = {r.title: r.text for r in found["pages"].collect()}
    assert text == {"Dublin": "Dublin\n\nDublin is in Ireland.\n\nHistory\n\nFounded in 841.", "Paris": "Paris", "Rome": "Rome"}
    asked = {r.question_id: r for r in found["questions"].collect()}
    assert set(asked) == {"f#0", "f#1", "f#4"} and text["Dublin"][asked["f#1"].answer_start : asked["f#1"].answer_end] == "Founded in 841."


def test_ordered_sums_and_percentiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v), i) for i, (k, v) in enumerate(zip(rng.choice(["a", "b", None], 500), rng.integers(0, 40, 500)))] + [("c", None, 500)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    told = {r.i: r.s for r in ordered.running(df.where("v IS NOT NULL"), ["k"], ["i"], s="v").collect()}
    sums = {}
    for k, v, i in rows[:-1]:
        sums[k] = sums.get(k, 0) + v
        assert told[i] == sums[k]
    found = {r.k: r for r in ordered.percentiles(df, ["k"], "v", mid=(0.5, True), high=(0.95, False)).collect()}
    for key in ("a", "b", None):
        values = sorted(v for k, v, _ in rows[:-1] if k == key)
        assert found[key].mid == np.quantile(values, 0.5) and found[key].high == values[math.ceil(0.95 * len(values)) - 1]
    assert "c" not in found and ordered.running(df.where("false"), ["k"], ["i"], s="v").count() == 0


def test_runs_are_published_and_read(spark, tmp_path):
    averages = spark.createDataFrame([("passage", "all", "ndcg@10", 0.5)], "level string, answer_type string, metric string, value double")
    start = dt.datetime(2025, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    for day, commit in ((0, "c1"), (1, "c1")):
        made = artefacts.document("experiment", grid.setup("fixed", "bm25", False), start + dt.timedelta(days=day), start, commit, "d" * 64, averages=averages)
        path = artefacts.publish(str(tmp_path / "runs"), made, {"rows": averages})
    assert path.name == "20250103T030405Z-dddddddddddd" and spark.read.json(str(path / "rows")).count() == 1
    with pytest.raises(FileExistsError):
        artefacts.publish(str(tmp_path / "runs"), made)
    runs = artefacts.load_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r.setup, r.value, r.started[:10]) for r in runs] == [("fixed-bm25", 0.5, "2025-01-03")]
    other = artefacts.document("experiment", grid.setup("fixed", "minilm", False), start, start, "c2", "e" * 64, averages=averages)
    artefacts.publish(str(tmp_path / "runs"), other)
    with pytest.raises(ValueError):
        artefacts.load_runs(spark, str(tmp_path / "runs"))
    base = str(tmp_path / "baseline.json")
    measured = spark.createDataFrame([("s", "m", 0.5)], "setup string, metric string, value double")
    artefacts.record_baseline(base, measured, 0.1)
    artefacts.record_baseline(base, measured.withColumn("value", F.lit(0.7)))
    assert artefacts.read_baseline(spark, base).collect()[0][2:] == (0.7, 0.1)
    made, text = artefacts.assemble("Report", {"Means": averages, "Absent": None, "Empty": averages.where("false")}, {"Means": "Higher is better."})
    assert "Absent" not in made and "| passage | all | ndcg@10 | 0.500 |" in text and "No rows." in text
    labels, known = str(tmp_path / "labels.jsonl"), {}
    assert artefacts.append_label(labels, "shown", {"setup": "s", "question_id": "q", "label": "supported"}, known)
    assert not artefacts.append_label(labels, "shown", {"setup": "s", "question_id": "q", "label": "partial"}, known)
    with pytest.raises(ValueError):
        artefacts.append_label(labels, "other", {"setup": "s", "question_id": "q", "label": "partial"}, known)
    record = logging.makeLogRecord({"msg": "done %s", "args": ("x",), "setup": "s", "levelname": "INFO"})
    assert json.loads(artefacts.JsonLines().format(record))["setup"] == "s"


def test_agreement_and_scoring(spark):
    rows = spark.createDataFrame(
        [("s", "q1", "supported", 0.9, 1.0, False), ("s", "q2", "partial", 0.2, 0.5, False), ("s", "q3", "supported", 0.8, 0.4, False), ("s", "q4", None, None, None, True)],
        "setup string, question_id string, groundedness string, nli double, lexical double, declined boolean",
    )
    found = {r.check: r for r in answers.baseline_agreement(rows).collect()}
    assert found["nli"].kappa == 1.0 and found["nli"].auc == 1.0 and (found["lexical"].flagged, found["lexical"].caught) == (1, 1)
    labels = spark.createDataFrame([("s", "q1", "supported"), ("s", "q2", "unsupported"), ("s", "q3", "supported")], "setup string, question_id string, label string")
    found = {r.check: r for r in answers.human_agreement(labels, rows).collect()}
    assert found["judge"].observed == pytest.approx(2 / 3) and found["judge"].auc is None and found["nli"].kappa == 1.0
    with pytest.raises(ValueError):
        answers.human_agreement(labels.withColumn("setup", F.lit("t")), rows)
    said = spark.createDataFrame(
        [("a1", "s", "q", "Where do rivers run?", "The rivers were running to lakes, flooding towns.", None, ["A river runs to a lake."]), ("a2", "s", "q", "x", "I don't know", None, None)],
        "answer_id string, setup string, question_id string, question string, text string, declined boolean, passages array<string>",
    )
    references = spark.createDataFrame([("q", ["lakes"])], "question_id string, short_answers array<string>")
    stems = config.stems_of(said.select("text"), said.select(F.col("question").alias("text")), said.select(F.explode("passages").alias("text")))
    verdicts = spark.createDataFrame([("a1", "correct", "partial", 0.4, 0.01), ("a2", "correct", "supported", 0.9, 0.02)], "answer_id string, correctness string, groundedness string, nli double, cost double")
    found = {r.answer_id: r for r in answers.scored(said, references, stems, verdicts).collect()}
    # new stems: lake, flood, town, of which passages have lake
    assert found["a1"].lexical == pytest.approx(1 / 3) and found["a1"].contains and found["a1"].correctness == "correct"
    assert (found["a2"].lexical, found["a2"].groundedness, found["a2"].cost, found["a2"].contains) == (None, None, 0.0, False)
    questions = spark.createDataFrame([("q1", "table"), ("q2", "list")], "question_id string, answer_type string")
    judged = spark.createDataFrame([("q1", True, False, "correct", "supported"), ("q2", True, False, None, None)], "question_id string, contains boolean, declined boolean, correctness string, groundedness string")
    compared = report.writer_comparison(judged, judged.withColumn("correctness", F.lit("incorrect")), questions).collect()
    assert {r.measure: r["diff"] for r in compared} == {"contains": 0, "declined": 0, "correct": 1, "supported": 0}
    calls = spark.createDataFrame([(str(i), 1.0) for i in range(40)], "key string, cost double")
    assert len(answers.guarded(calls, lambda b: b, 4, 40, 100.0, after=5)) == 4
    with pytest.raises(answers.OverBudget):
        answers.guarded(calls, lambda b: b, 4, 40, 1.0, after=5)


def test_live_search(spark):
    chunks = spark.createDataFrame([("c1", "p", "Tea\ngreen tea"), ("c2", "p", "River\nthe river")], "chunk_id string, page_id string, text string")
    search = retrieval.LiveSearch({"bm25": retrieval.postings(chunks)}, chunks)
    assert [(r.rank, r.chunk_id, r.heading, r.body) for r in search("bm25", "where is tea").collect()] == [(1, "c1", "Tea", "green tea")]
    for wrong in (lambda: search("none", "tea"), lambda: retrieval.named(retrieval.ENCODERS, "none")):
        with pytest.raises(KeyError, match="known"):
            wrong()
