"""Operators for training data: brute force, round trips and rows that are not as they should be."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
import tiktoken
from oracle import duck, rows_of
from pyspark.sql import functions as F

from recallforge.llm import chunk, consensus, encode, garbled, language, pack, pairs, sketch, survivors
from recallforge.llm.queries import oracle_sql, queries
from recallforge.llm.vocabulary import SPLIT_PATTERN, rank_file, read_ranks

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", None, "the old mill", "the old mill", "Überraschung für 50 € 🙂", "<|endoftext|>", "x" * 400, "a b 　c\n\n d", "灯台は約40年間村の住民に似ている。", "1234567 don't we'll"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_run(spark, name):
    found = queries()[name](spark, FOLDER)
    assert found.count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_rows_equal_sql(spark, name):
    found = queries()[name](spark, FOLDER)
    columns, rows = duck(FOLDER, oracle_sql()[name])
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, rows)


# 6 and 7


def test_encoding_equals_the_tokenizer_and_decodes(spark):
    docs = frame(spark, [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string")
    found = encode.encode_documents(docs)
    coder = tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=read_ranks(rank_file()), special_tokens={})
    expected = sorted((i if i != 3 else -1, coder.encode_ordinary(t or "")) for i, t in enumerate(ODD))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in found.collect()) == expected
    texts = Counter(r.t for r in found.select(encode.decode_ids(F.col("ids")).alias("t")).collect())
    assert texts == Counter(t or "" for t in ODD)
    assert encode.encode_documents(docs.where("false")).count() == 0


def coder_of(ranks):
    return tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_split_as_the_pattern_does(spark):
    rng = random.Random(6)
    white = r"\x09-\x0d \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|[{white}]+(?![^{white}])|[{white}]+")
    some = [" ", "  ", "\n", "'", "s", "t", "re", "ve", "ll", "d", "a", "B", "é", "漢", "1", "٣", "-", "\u00a0", "🙂", "\u0301", "ж", "m"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 12))) for _ in range(5_000)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    bounds = encode.word_bounds(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])] == [w for t in texts for w in pattern.findall(t)]


def test_long_words_and_another_vocabulary(spark, tmp_path):
    ranks = read_ranks(rank_file())
    coder, rng = coder_of(ranks), random.Random(7)
    texts = ["".join(rng.choices("abcdefgh", k=1_000_000)), "灯台" * 3_000, "x" * 65, "y" * 64, "", None, "a b"]
    docs = frame(spark, list(enumerate(texts)), "doc_id bigint, text string")
    for chunk_bytes in (encode.CHUNK_BYTES, 50):
        found = {r.doc_id: r.ids for r in encode.encode_documents(docs, chunk_bytes=chunk_bytes).collect()}
        assert found == {i: coder.encode_ordinary(t or "") for i, t in enumerate(texts)}
    # the same tokens under ids beyond 65,536
    path = tmp_path / "other.tiktoken"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r + 100_000}\n" for t, r in ranks.items()))
    few = docs.where("doc_id > 1")
    found = {r.doc_id: r.ids for r in encode.encode_documents(few, path=str(path)).collect()}
    assert found == {i: [x + 100_000 for x in coder.encode_ordinary(t or "")] for i, t in enumerate(texts) if i > 1}


def best_fit(capacity, sizes):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return len(free)


def test_packing_equals_best_fit_decreasing(spark):
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        counts = Counter(sizes)
        assert pack.pack_counts(capacity, list(counts), list(counts.values()))[1] == best_fit(capacity, sizes)
    sizes = [rng.randint(0, 130) for _ in range(400)] + [None, 0, -3]
    items = frame(spark, [(i, s, 1) for i, s in enumerate(sizes)], "item bigint, size bigint, bin int")
    boxes = frame(spark, [(1, 50), (1, 50), (2, None), (3, 0), (4, 130)], "box int, capacity int")
    found = pack.pack_items(items, boxes).collect()
    assert {r.box for r in found} == {1, 4}
    for box, capacity in ((1, 50), (4, 130)):
        mine = [r for r in found if r.box == box]
        load = Counter()
        for r in mine:
            load[r.bin] += r.size
        assert max(load.values()) <= capacity
        parts = [p for s in sizes if s and s > 0 for p in [capacity] * (s // capacity) + [s % capacity] if p > 0]
        assert len({r.bin for r in mine}) == best_fit(capacity, parts)
        whole = Counter()
        for r in mine:
            whole[r.item] += r.size
        assert whole == Counter({i: max(s or 0, 0) for i, s in enumerate(sizes)})
        assert all(r.size == capacity for r in mine if (sizes[r.item] or 0) > (r.part + 1) * capacity)
    assert pack.pack_items(items.where("false"), boxes).count() == 0


# 1


def test_pieces_overlap_fit_and_survive_edits(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["river ", "lake ", "hill ", "Then it ended. ", "the mill, ", "town\n\n", "no break "]) for _ in range(3000))
    configs = [(1, 40, 0), (2, 100, 20), (3, 80, 79), (4, 25, 5), (5, None, 1), (6, 10, 10), (7, 0, 0), (8, 10, -1), (9, 10, None)]
    pages = frame(spark, [(1, text, 0), (2, text[:9000] + " one two three " + text[9000:], 0), (3, None, 0), (4, "", 0), (5, "few words", 0), (5, "few words", 0)], "id bigint, text string, words int")
    cuts = chunk.cut_texts(pages, frame(spark, configs, "config_id int, size int, overlap int"), "id", only_cut=False)
    spans = {}
    for r in chunk.pieces(cuts).orderBy("config_id", "id", "piece").collect():
        spans.setdefault((r.config_id, r.id), []).append((r.start, r.end))
    assert {c for c, _ in spans} == {1, 2, 3, 4} and (1, 3) not in spans and spans[1, 5] == [(0, 9), (0, 9)]
    word = re.compile("[^" + "".join(map(chr, chunk.SPACES)) + "]+")
    for config, size, overlap in configs[:4]:
        mine = [word.findall(text[a:b]) for a, b in spans[config, 1]]
        assert max(map(len, mine)) <= size
        assert all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(mine, mine[1:]))
        assert mine[0] + [w for m in mine[1:] for w in m[overlap:]] == word.findall(text)
    kept = chunk.pieces(chunk.cut_texts(pages, frame(spark, configs, "config_id int, size int, overlap int"), "id", keep_text=True))
    assert {(r.config_id, r.text) for r in kept.where("id = 1").collect()} == {(c, text[a:b]) for c in (1, 2, 3, 4) for a, b in spans[c, 1]}
    mine, edited = ({(t[a:b]) for a, b in spans[1, i]} for i, t in ((1, text), (2, text[:9000] + " one two three " + text[9000:])))
    assert len(edited - mine) <= 5 < len(mine)


# 2


def test_sketch_keeps_its_error_through_merges():
    rng = np.random.default_rng(0)
    for values in (rng.lognormal(size=60_000), np.arange(60_000.0), np.repeat([1.0, 2.0], 30_000)):
        whole = sketch.Sketch()
        for part in np.array_split(rng.permutation(values), 9):
            piece = sketch.Sketch()
            for some in np.array_split(part, 4):
                piece.add(some)
            whole.merge(sketch.Sketch(*piece.row()))
        ordered = np.sort(values)
        for q, x in zip(sketch.PERCENTILES, whole.quantiles(sketch.PERCENTILES)):
            low, high = np.searchsorted(ordered, x, "left") / len(values), np.searchsorted(ordered, x, "right") / len(values)
            assert low - sketch.error_of(q) - 1e-4 <= q <= high + sketch.error_of(q) + 1e-4
        assert sum(map(len, whole.levels)) < 6_000


def test_error_of_many_merged_sketches():
    """The stated error is three standard deviations: sketches built apart must not err alike."""
    rng, over, trials = np.random.default_rng(3), 0, 0
    for trial in range(12):
        values = rng.lognormal(size=40_000)
        whole = sketch.Sketch(seed=trial)
        for i, part in enumerate(np.array_split(values, 60)):
            piece = sketch.Sketch(seed=(trial * 60 + i) << 32)
            piece.add(part)
            whole.merge(sketch.Sketch(*piece.row()))
        ordered = np.sort(values)
        for q, x in zip(sketch.PERCENTILES, whole.quantiles(sketch.PERCENTILES)):
            trials += 1
            over += abs(np.searchsorted(ordered, x, "right") / len(values) - q) > sketch.error_of(q) + 1e-4
    assert over <= trials * 0.02


def test_percentiles_of_days_and_of_all(spark):
    rows = [(i, "a", i % 3, float(i)) for i in range(100)] + [(5, "a", 2, 5.0), (200, "a", 0, None), (201, "a", 0, float("nan")), (202, "a", 0, -1.0), (None, "b", 1, 7.0), (None, "b", 1, 7.0), (300, None, 1, 1.0)]
    df = frame(spark, rows, "id bigint, setup string, d int, v double").withColumn("day", F.date_add(F.lit("2025-01-01").cast("date"), F.col("d")))
    values = sketch.measurements(df, "id", F.col("v"), F.col("setup"), F.col("day"))
    found = {(r.setup, r.all_days, r.day.day if r.day else None): r for r in sketch.percentiles_by_day(values, ["setup"]).collect()}
    assert found["a", True, None].n == 100 and found["a", True, None].p50 == 49.0 and found["a", True, None].exact and found["a", True, None].p50_error == 0
    assert found["b", True, None].n == 2 and found[None, True, None].n == 1
    assert sum(r.n for k, r in found.items() if k[0] == "a" and not k[1]) == 100
    assert sketch.percentiles_by_day(values.where("false"), ["setup"]).count() == 0


# 3


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_defects(model):
    templates = pairs.RefusalTemplates()
    q = "Who founded Ostra Mill?"
    cases = [
        (None, "empty"), ("", "empty"), ("…", "empty"), ("“”", "empty"), ("[1]", "empty"), ("​", "empty"),
        ("I don’t know.", "refusal"), ("Sorry, I cannot determine this from the text given.", "refusal"), ("Es tut mir leid, dazu kann ich nichts sagen.", "refusal"),
        ("I'm afraid none of the numbered passages mentions Ostra Mill", "refusal"), ("WHO FOUNDED OSTRA MILL", "copy"), ("Q: who founded Ostra Mill\nA:", "copy"),
        ("Who founded Ostra Mill? Who founded Ostra Mill?", "copy"), ("Ostra Mill was founded by Kin Vel in 1301. The old brid", "truncated"),
        ("Ostra Mill fue fundado por Kin Vel en el año 1301.", "language"), ("Kin Vel", None), ("1301", None), ("5231 km; 12 km", None),
        ("Who founded Ostra Mill? Ostra Mill was founded by Kin Vel.", None), ("It was Kin Vel, who said “I don't know” when asked for a second name.", None),
        ("No one knows who drew the first plan, but Ostra Mill opened in 1301 under Kin Vel.", None), ("The founder was Kin Vel [1] – “Le château rappelle le château” – as the old plaque says.", None),
    ]
    assert [(t, pairs.defect_of(q, t, model, templates)) for t, _ in cases] == cases
    assert pairs.defect_of(None, "Kin Vel.", model, templates) is None


def test_long_refusals(model):
    templates = pairs.RefusalTemplates()
    q = "Who founded Ostra Mill?"
    refusal = "I am sorry. Unfortunately, I don't know. I do not have access to this information. I cannot determine this from the text given. I don't know the answer. Apologies."
    assert pairs.defect_of(q, refusal, model, templates) == "refusal"
    assert pairs.defect_of(q, refusal + " Ostra Mill was founded by Kin Vel.", model, templates) is None


def test_common_subsequence_equals_the_table():
    rng = random.Random(11)
    for _ in range(500):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for p in a:
            corner = 0
            for j, q in enumerate(b, 1):
                corner, row[j] = row[j], corner + 1 if p == q else max(row[j], row[j - 1])
        assert pairs.common(a, b) == row[-1]
    words = [str(rng.randint(0, 3_000)) for _ in range(30_000)]
    assert pairs.is_copy(words, words) and not pairs.is_copy(words, words[::-1])


def test_find_defects_keeps_rows(spark, model):
    df = frame(spark, [(1, None, None, 1), (1, None, None, 1), (None, "Who?", "I don't know", 1), (3, "Who?", "Kin Vel", 1)], "answer_id bigint, question string, text string, defect int")
    assert sorted((r.answer_id or 0, r.defect) for r in pairs.find_defects(df, model).collect()) == [(0, "refusal"), (1, "empty"), (1, "empty")]
    assert pairs.find_defects(df.where("false"), model).count() == 0


# 4


BLOCKS = "array<struct<kind:string,section:string,text:string,start:int,end:int,caption:string,header:array<string>,rows:array<array<string>>>>"


def test_survivors(spark):
    rng, rows, expected = random.Random(3), [], {}
    words = "river mill bridge old stone valley museum tower canal harvest winter market".split()
    at = spark.sql("SELECT timestamp_ntz '2025-01-01' AS t").first().t
    import datetime as dt

    for p in range(120):
        paragraphs = [f"Place{p} is a {' '.join(rng.choices(words, k=8))}."] + [" ".join(rng.choices(words, k=9)).capitalize() + f" {p}." for _ in range(3)]
        sound, n = "\n\n".join(paragraphs), p * 10
        blocks = [("paragraph", "", t, 0, 0, "", None, None) for t in paragraphs]
        broken = rng.choice(["Loading…", None, " ", sound[: len(sound) - 25], f"<p>{paragraphs[0]}</p><p>{paragraphs[1]}</p>", f"Place{p}", f"{paragraphs[0]} {paragraphs[1][:20]} (continued on the next page)"])
        rows += [
            (n, f" PAGE-{p}", sound, blocks, "crawl", None, f"u{p}?old=1"),
            (n + 1, f"page-{p}", sound, blocks if p % 2 else None, "dump", at + dt.timedelta(days=1), f"u{p}"),
            (n + 2, f"page-{p}", sound, blocks, "mirror", at + dt.timedelta(days=1), f"u{p}"),
            (n + 3, None, broken, blocks, "dump", at + dt.timedelta(days=9), f"U{p}?old=2"),
        ]
        expected[f"page-{p}"] = n + 1
    rows += [(5000, "single", "A single page is not a group of copies.", None, None, None, None), (5001, None, "No one knows this page.", None, None, None, None)]
    df = frame(spark, [(*r, "x", "t") for r in rows], f"record_id bigint, page_id string, text string, blocks {BLOCKS}, feed string, captured_at timestamp_ntz, url string, key string, title string").drop("key").withColumn("sound", F.lit(1)).withColumn("key_", F.lit(1))
    chosen = survivors.survivors(df)
    assert {r.page_key: r.record_id for r in chosen.collect()} == expected
    fields = survivors.survivor_fields(df, chosen).where("page_key = 'page-7'").first()
    assert fields.title == "t" and fields.url == "u7" and fields.text.startswith("Place7 is")
    assert survivors.survivors(df.where("false")).count() == 0


def test_values_keep_all_that_are_true(spark):
    rng, rows = random.Random(12), []
    for p in range(300):
        # two sound feeds give one or both true values, the third a false one half of the time
        for feed in ("a", "b", "c"):
            for v in ("x", "y"):
                if rng.random() < 0.9:
                    rows.append((f"p{p}", feed, f"{v}{p}" if feed != "c" or rng.random() < 0.5 else f"wrong{p}{v}"))
    found = survivors.true_values(frame(spark, rows, "key string, feed string, value string")).collect()
    right = [(r.truth >= 0.5) == (not r.value.startswith("wrong")) for r in found]
    assert sum(right) / len(right) > 0.95
    assert survivors.true_values(frame(spark, [], "key string, feed string, value string")).count() == 0


def test_empty_urls_tell_no_page(spark):
    rows = [(1, "page-1", ""), (2, None, ""), (3, None, None), (4, "page-4", "u"), (5, " ", "U?x=1")]
    keyed = survivors.keyed(frame(spark, rows, "record_id bigint, page_id string, url string"))
    assert {r.record_id: r.key for r in keyed.collect()} == {1: "page-1", 4: "page-4", 5: "page-4"}


def test_usual_ends_are_a_rate(spark):
    within = [f"Near the mill, town {chr(97 + i)} has a harbour." for i in range(20)]
    ends = [f"Town {chr(97 + i)} is by the mill." for i in range(4)] + [f"Town {chr(97 + i)} has an old bridge." for i in range(6)]
    cut = ["Town z is by the mill", "Town z has an old bridge"]
    rows = [(i, f"page-{i}", t, None, "crawl", None, None) for i, t in enumerate(within + ends + cut)]
    df = frame(spark, rows, f"record_id bigint, page_id string, text string, blocks {BLOCKS}, feed string, captured_at timestamp_ntz, url string")
    found = {r.record_id: r.ending for r in survivors.reports(survivors.feed_of(survivors.keyed(df))).collect()}
    assert [found[30], found[31]] == ["open", "stop"]


# 5


def crowd(skill, items, labels, per_item, seed):
    rng, rows, truth = random.Random(seed), [], {}
    for i in range(items):
        truth[f"i{i}"] = t = rng.choice(labels)
        for a in rng.sample(sorted(skill), per_item(i)):
            rows.append((f"i{i}", a, t if rng.random() < skill[a] else rng.choice([x for x in labels if x != t])))
    return rows, truth


def test_consensus_beats_the_majority(spark):
    skill = {f"good{i}": 0.95 for i in range(3)} | {f"bad{i}": 0.3 for i in range(8)}
    rows, truth = crowd(skill, 1500, [*range(-1, 9)], lambda i: 5, 4)
    df = frame(spark, rows + rows[:200] + [("i0", "good0", None), (None, "good0", 1)], "id string, annotator string, label int")
    voted = consensus.votes(df, "id", "annotator", "label").persist()
    assert voted.count() == len(rows)
    reliability = consensus.reliabilities(voted)
    known = {r.annotator: r.reliability for r in consensus.annotators(reliability).collect()}
    assert min(v for k, v in known.items() if k.startswith("good")) > 0.8 > 0.5 > max(v for k, v in known.items() if k.startswith("bad"))
    found = {r.item: r.label for r in consensus.consensus(voted, reliability).collect()}
    right = sum(found[i] == t for i, t in truth.items())
    votes = {}
    for i, _, label in rows:
        votes.setdefault(i, Counter())[label] += 1
    majority = sum(v.most_common(1)[0][0] == truth[i] for i, v in votes.items())
    assert right > majority and right / len(truth) > 0.8
    single = voted.where("item = 'i0' AND annotator LIKE 'good%'").limit(1)
    assert consensus.consensus(single, consensus.reliabilities(single)).first().agreement is None
    assert consensus.consensus(voted.where("false"), consensus.reliabilities(voted.where("false"))).count() == 0
    # items without pairs give the same vector
    wide = {(r.annotator, r.block): r.g for r in consensus.reliabilities(voted, wide=2).collect()}
    assert wide == pytest.approx({(r.annotator, r.block): r.g for r in reliability.collect()}, abs=1e-4)


def test_a_contrary_annotator_is_not_reliable(spark):
    skill = {f"good{i}": 0.9 for i in range(5)} | {"contrary": 0.05}
    rows, truth = crowd(skill, 800, ["no", "yes"], lambda i: 6 if i % 2 else 4, 8)
    voted = consensus.votes(frame(spark, rows, "id string, annotator string, label string"), "id", "annotator", "label").persist()
    reliability = consensus.reliabilities(voted)
    known = {r.annotator: r.reliability for r in consensus.annotators(reliability).collect()}
    assert known.pop("contrary") == consensus.EDGE and min(known.values()) > 0.6
    found = {r.item: r.label for r in consensus.consensus(voted, reliability).collect()}
    assert sum(found[i] == t for i, t in truth.items()) / len(truth) > 0.97


def test_eigenvectors_equal_dense_ones(spark):
    skill = {f"a{i}": 0.3 + 0.06 * i for i in range(10)}
    rows, _ = crowd(skill, 300, [0, 1, 2], lambda i: 4, 9)
    voted = consensus.votes(frame(spark, rows, "id string, annotator string, label int"), "id", "annotator", "label").persist()
    names, items = sorted(skill), {}
    for i, a, label in rows:
        items.setdefault(i, {})[names.index(a)] = label
    p = np.zeros((10, 3))
    both, shared = np.zeros((10, 10, 3)), np.zeros((10, 10))
    for given in items.values():
        for a, x in given.items():
            p[a, x] += 1
            for b, y in given.items():
                if a != b:
                    shared[a, b] += 1
                    both[a, b, x] += x == y
    p /= p.sum(axis=1, keepdims=True)
    overlap = shared.sum(axis=1)
    found = {(r.annotator, r.block): r.g for r in consensus.reliabilities(voted).collect()}
    for block, share, excess in [("*", np.ones(10), both.sum(axis=2) - shared * (p @ p.T)), *((f"={x}", p[:, x], both[:, :, x] - shared * np.outer(p[:, x], p[:, x])) for x in range(3))]:
        scale = np.sqrt(overlap * share)
        values, vectors = np.linalg.eigh(excess / np.outer(scale, scale))
        top = vectors[:, -1] * np.sign(vectors[:, -1] @ scale) * np.sqrt(values[-1] * overlap.sum() / overlap)
        assert [found[a, block] for a in names] == pytest.approx(top.tolist(), abs=1e-3)


# 8


def test_repair_of_wrong_readings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cost = garbled.fit(docs)
    clean = {
        "de": "Die Bürger von Hollo schützt die Königin im Frühjahr und das Gemälde zerstörte die Höhle nach 1963.",
        "fr": "La vallée a détruit l’hôpital près de Vendel. Le château a hérité de la forêt à Noël.",
        "ru": "Монастырь упоминает театр согласно летописи, потому что рынок снабжает архив.",
        "ja": "灯台は約44年間村の住民に似ている、そして運河は図書館に似ている。",
    }
    for text in clean.values():
        assert cost.repair(text) == (False, text)
        once = text.encode().decode("latin-1")
        assert cost.repair(once) == (True, text)
        assert cost.repair(once.encode().decode("latin-1"))[0]
    assert cost.repair(clean["ru"].encode("cp1251").decode("cp1252")) == (True, clean["ru"])
    assert cost.repair("L\x92église a remplacé l\x92hôpital.")[0] and cost.repair("Universit�t")[0]
    for sound in ("If you see Ã¶ instead of ö, the corpus was read with the wrong code page.", "It is 34 °C – “here”, 🙂 é.", "plain", "", "MAÑANA, ¿NO?", "a b c"):
        assert cost.repair(sound) == (False, sound)
    rows = frame(spark, [(1, clean["de"].encode().decode("cp1252"), 0), (1, clean["de"].encode().decode("cp1252"), 0), (None, "Universit�t", 0), (3, None, 0), (4, "", 0)], "doc_id bigint, text string, id int")
    found = sorted((r.doc_id or 0, r.text) for r in garbled.find_garbled(rows, cost).collect())
    assert found == [(0, "Universit�t"), (1, clean["de"]), (1, clean["de"])]
    assert garbled.find_garbled(rows.where("false"), cost).count() == 0


def test_common_garblings_are_found(spark):
    words = "Straße Höhle Mühle Brücke König Gemälde Fähre Küste".split()
    sound = [f"Die {a} und die {b} von Ort {chr(97 + i)}{chr(97 + j)}." for i, a in enumerate(words) for j, b in enumerate(words)]
    wrong = [t.replace("Ort", "Dorf").encode().decode("cp1252") for t in sound if "ß" in t][:8]
    for some in (sound[:30], sound):
        # a fifth of the texts have the same garbling, so that its neighbours are not rare
        rows = [(i, t, "de") for i, t in enumerate(some + wrong)]
        docs = frame(spark, rows, "doc_id bigint, text string, lang string")
        cost = garbled.fit(docs)
        assert {r.doc_id for r in garbled.find_garbled(docs, cost).collect()} == set(range(len(some), len(rows)))
        assert cost.repair(wrong[0]) == (True, wrong[0].encode("cp1252").decode())


def test_clean_batches_and_nested_readings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cost = garbled.fit(docs)
    clean = frame(spark, [(i, t) for i, t in enumerate(["café olé", "naïve café", "", None, "plain"])], "doc_id bigint, text string")
    assert garbled.find_garbled(clean, cost).count() == 0
    text = "Die Bürger von Hollo schützt die Königin im Frühjahr."
    deep = text
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    assert cost.repair(deep) == (True, text)
    # a citation is seen however long its sentence is
    cited = "If you see Ã¶ where " + "the page has a long sentence that goes on and " * 40 + "ö is meant, it is a wrong code page."
    assert cost.repair(cited) == (False, cited)


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\u00f6ßж漢Ã¼") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [""]
    counted = garbled._count(texts, set())
    singles, pairs = Counter(), Counter()
    for t in texts:
        hidden = "".join(garbled._unsuspected(r, set()) if not r.isascii() else r for r in re.findall(r"[\x00-\x7f]+|[^\x00-\x7f]+", t))
        singles.update(set(hidden) - {"\0"})
        pairs.update({x + y for x, y in zip(hidden, hidden[1:]) if not (x + y).isascii() and "\0" not in x + y})
    assert {k: n for (w, k), n in counted.items() if w == "single"} == singles
    assert {k: n for (w, k), n in counted.items() if w == "pair"} == pairs


def test_cost_is_counted_over_whole_texts(spark):
    rows = [(i, "The mill stands. " * 100 + f"It is in Žďár, No. {i}.", "en") for i in range(1200)]
    cost = garbled.fit(frame(spark, rows, "doc_id bigint, text string, lang string"))
    assert cost.singles["ď"] == pytest.approx(garbled.WEIGHT) and cost.pairs["Žď"] == pytest.approx(garbled.WEIGHT)
    assert cost.texts == pytest.approx(garbled.WEIGHT + 1)


def test_single_bytes_are_tried_unless_utf8_explains_all(spark):
    cost = garbled.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    tried = []
    cost.single_byte = lambda text, runs: tried.append(runs) or ("other", 1e6)
    text = "GrÃ¼Ã¼Ìîe"
    # one run, two spans of it explained, the rest not
    runs = [(2, 8)]
    assert cost.utf8(text, runs)[1] > 0
    assert cost.best_layer(text, runs) == ("other", True) and tried
    tried.clear()
    assert cost.best_layer("GrÃ¼nde", [(2, 4)]) == ("Gründe", True) and not tried
