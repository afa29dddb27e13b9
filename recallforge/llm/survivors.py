"""One surviving record for each group of records of the same page.

Whether a record's text is sound is latent. What is seen are the reports of sources: the feed
that delivered it and witnesses that look at one side of the text each (its blocks, its end,
other records of the page, other pages). Damage comes in kinds, and every source has a
specificity and for each kind a sensitivity of its own; expectation-maximisation infers them all
together with the soundness of the texts. All rows of one pattern of reports are alike, so it
runs over counted patterns.

Titles and urls have several true values: whether a page has a value is latent too, and a feed
has a sensitivity (it gives a true value) and a specificity (it gives no false one).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.session import cut_lineage

#: Rounds of expectation-maximisation; those over values.
ROUNDS, VALUE_ROUNDS = 300, 12
#: Reports of damage: where one speaks, the first round looks for a kind of damage of its own.
DAMAGE = {"elsewhere": "true", "says": "false", "markup": "true", "tail": "true", "extended": "true", "ending": "open"}
#: Records are judged sound from this probability on: one taken wrongly costs a page its text.
SURE = 0.9
#: Feeds of a smaller share of the records share one entry, so that at most 1,000 others have their own.
FEED_SHARE = 0.001
OTHER_FEED = "other"
#: Two words are a usual end if they end complete paragraphs in this share of their places, those
#: within sentences of complete paragraphs and SELDOM more that may be to come being the others.
USUAL, SELDOM = 0.5, 3
WITNESSES = ["feed", "blocks", "elsewhere", "says", "markup", "own", "tail", "extended", "ending"]

# Unicode white space, characters without width, ends of sentences, marks that
# a text goes on elsewhere.
_SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
_NO_WIDTH = "".join(map(chr, [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]))
# every space but line ends, which become plain; characters without width go
_ALIKE = "".join(map(chr, [9, 11, 12, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + _NO_WIDTH
_COMPLETE = r"[.!?。！？][\"'”’»)\]）」]*$"
_CONTINUED = r"(?i)(…|\.\.\.|(…|\.\.\.)?\s*(\[?(more|read on|read more|continue reading|continued)\]?|\((continued|more|read on)[^)]*\)))$"


def page_key(page_id: Column) -> Column:
    """Lower case without outer spaces; empty is null."""
    key = F.lower(F.regexp_replace(page_id, f"^{_SPACE}|{_SPACE}$", ""))
    return F.when(key != "", key)


def _base(url: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.substring_index(url, "?", 1), "#", 1)))


def keyed(df: DataFrame) -> DataFrame:
    """page_records with ``key``. A record without page_id has the key of the records with its
    url, of several the smallest; one that no url tells has none and is left out."""
    rows = df.withColumn("key", page_key(F.col("page_id")))
    base = _base(F.col("url"))
    urls = rows.where(F.col("key").isNotNull() & (base != "")).groupBy(base.alias("base")).agg(F.min("key").alias("of_url"))
    missing = rows.where(F.col("key").isNull() & (base != "")).withColumn("base", base).drop("key")
    found = missing.join(urls, "base").withColumnRenamed("of_url", "key").drop("base")
    return rows.where("key IS NOT NULL").unionByName(found)


def _paragraphs(text: Column) -> Column:
    """Paragraphs in lower case, spaces alike, without those that have nothing to read."""
    even = F.replace(F.translate(F.lower(text), _ALIKE, " " * (len(_ALIKE) - len(_NO_WIDTH))), F.lit("\r\n"), F.lit("\n"))
    parts = F.transform(F.split(even, "\n\n+"), lambda p: F.trim(F.regexp_replace(p, "[ \n\r]+", " ")))
    return F.filter(parts, lambda p: p != "")


def _final(paragraph: Column) -> Column:
    """The last two words, numbers alike."""
    two = F.substring_index(F.regexp_replace(paragraph, r"[\p{P}\s]+$", ""), " ", -2)
    return F.regexp_replace(F.regexp_extract(two, r"^([^\s]+ [^\s\p{P}]+)$", 1), r"\d+([.,]\d+)*", "0")


def _within(paragraph: Column) -> Column:
    """Every two words that stand within a sentence, like ``_final``: not those before its end."""
    words = F.split(paragraph, " ")
    # the last has no next word: null; a word with marks inside is no end in ``_final`` either
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    inside = F.filter(pairs, lambda p: p.isNotNull() & ~p.rlike(_COMPLETE))
    found = F.transform(inside, lambda p: F.regexp_replace(F.regexp_extract(p, r"^([^\s]+ [^\s\p{P}]+)\p{P}*$", 1), r"\d+([.,]\d+)*", "0"))
    return F.filter(found, lambda p: p != "")


def usual_ends(complete: DataFrame) -> DataFrame:
    """(final, usual) of the two words that usually end a paragraph (``last``)."""
    ends = complete.groupBy(_final(F.col("last")).alias("final")).agg(F.count("*").alias("ends")).where((F.col("final") != "") & (F.col("ends") >= SELDOM))
    within = complete.select(F.explode(_within(F.col("last"))).alias("final")).groupBy("final").agg(F.count("*").alias("within"))
    counted = ends.join(within, "final", "left").withColumn("within", F.coalesce("within", F.lit(0)))
    return counted.where(F.col("ends") >= USUAL * (F.col("ends") + F.col("within") + SELDOM)).select("final", F.lit(True).alias("usual"))


def feed_of(rows: DataFrame) -> DataFrame:
    """``rows`` with small feeds as one; a null feed is a feed."""
    rows = rows.withColumn("feed", F.coalesce("feed", F.lit("?")))
    counted = rows.groupBy("feed").count()
    large = counted.join(F.broadcast(counted.agg(F.sum("count").alias("all")))).where(F.col("count") >= FEED_SHARE * F.col("all")).select("feed", F.lit(True).alias("large"))
    return rows.join(F.broadcast(large), "feed", "left").withColumn("feed", F.when(F.col("large"), F.col("feed")).otherwise(F.lit(OTHER_FEED))).drop("large")


def reports(rows: DataFrame) -> DataFrame:
    """(record_id, key, captured_at, WITNESSES) of each row of ``keyed``.

    Witnesses: blocks of the record give its text; the text is elsewhere, under another page,
    digits apart; it says more than a heading; it has markup; blocks of another record of the
    page give it; its tail says that it goes on; its last paragraph goes on in another record;
    how it ends. Null is no report.
    """
    joined = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
    base = rows.select(
        "record_id", "key", "captured_at", "feed", "text",
        F.when(F.size("blocks") > 0, joined).alias("joined"),
    ).withColumn("parts", _paragraphs(F.col("text"))).withColumn("plain", F.array_join("parts", "\n\n"))
    base = base.withColumns({
        "h": F.xxhash64("plain"),
        "hj": F.when(F.col("joined") != "", F.xxhash64(F.array_join(_paragraphs(F.col("joined")), "\n\n"))),
        "masked": F.xxhash64(F.regexp_replace("plain", r"\d+", "")),
        "last": F.try_element_at("parts", F.lit(-1)),
    })
    base = cut_lineage(base.select(
        "record_id", "key", "captured_at", "feed", "h", "hj", "masked", "last",
        F.coalesce(F.size("parts") > 0, F.lit(False)).alias("there"),
        F.when(F.col("hj").isNotNull(), (F.col("h") == F.col("hj")).cast("string")).alias("blocks"),
        F.exists("parts", lambda p: (F.size(F.split(p, " ")) >= 5) | ((F.length(p) >= 12) & p.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))).cast("string").alias("says"),
        F.col("text").rlike(r"</?[a-zA-Z][^<>]*>[\s\S]*<[a-zA-Z/]").cast("string").alias("markup"),
        F.col("last").rlike(_CONTINUED).cast("string").alias("tail"),
        _final(F.col("last")).alias("final"),
        F.when(F.col("last").rlike(_CONTINUED), "open").when(F.col("last").rlike(_COMPLETE), "end").when(F.col("last").contains(" | "), "row").otherwise("open").alias("ending"),
    ))
    there = base.where("there")
    elsewhere = there.groupBy("masked").agg((F.min("key") != F.max("key")).cast("string").alias("elsewhere"))
    own = there.where("hj IS NOT NULL").select("key", F.col("hj").alias("h"), "record_id").groupBy("key", "h").agg(F.min("record_id").alias("r1"), F.max("record_id").alias("r2"))
    # the strings that go on after a paragraph come next to it in order
    none = F.array().cast("array<string>")
    whole = F.array_join(F.transform("blocks", lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
    of_blocks = F.when(whole.eqNullSafe(F.col("text")), none).otherwise(F.flatten(F.transform("blocks", lambda b: F.coalesce(_paragraphs(b["text"]), none))))
    texts = rows.select("key", F.explode(F.concat(F.coalesce(_paragraphs(F.col("text")), none), F.coalesce(of_blocks, none))).alias("last")).distinct()
    after = F.lead("last").over(Window.partitionBy("key", F.substring("last", 1, 1)).orderBy("last"))
    goes_on = F.coalesce(F.startswith("next", "last") & (F.length(F.regexp_replace(F.expr("substring(next, length(last) + 1)"), r"[\p{P}\s]", "")) >= 1), F.lit(False))
    endings = texts.withColumn("next", after).select("key", "last", goes_on.cast("string").alias("extended"))
    complete = endings.where(F.col("last").rlike(_COMPLETE) & ~F.col("last").rlike(_CONTINUED) & (F.col("extended") == "false"))
    finals = usual_ends(complete)
    seen = (
        there.join(finals, "final", "left")
        .withColumn("ending", F.when((F.col("ending") == "open") & F.col("usual") & (F.col("tail") == "false"), "stop").otherwise(F.col("ending")))
        .join(elsewhere, "masked", "left")
        .join(own, ["key", "h"], "left")
        .withColumn("own", (F.col("r1").isNotNull() & ((F.col("r1") != F.col("record_id")) | (F.col("r2") != F.col("record_id")))).cast("string"))
        .join(endings, ["key", "last"], "left")
    )
    return seen.select("record_id", "key", "captured_at", *WITNESSES)


def learn(patterns: list[tuple], counts: list[int], rounds: int = ROUNDS) -> np.ndarray:
    """Probability of soundness of each pattern of reports.

    A text is sound or has one kind of damage. The start believes that it is sound unless a
    witness of damage speaks, and then that it has that witness's kind; rounds then infer how
    common each kind is and how often every source reports each level on it.
    """
    kinds = list(DAMAGE)
    of = np.zeros((len(patterns), 1 + len(kinds)))
    for i, p in enumerate(patterns):
        told = [k for k, w in enumerate(kinds, 1) if p[WITNESSES.index(w)] == DAMAGE[w]]
        of[i, 0] = 0.02 if told else 0.95
        some = told or list(range(1, 1 + len(kinds)))
        of[i, some] = (1 - of[i, 0]) / len(some)
    n, coded = np.asarray(counts, float), []
    for column in zip(*patterns, strict=True):
        levels = {x: k for k, x in enumerate(sorted({x for x in column if x is not None}))}
        coded.append((np.array([levels.get(x, -1) for x in column]), len(levels)))
    for _ in range(rounds):
        share = n[:, None] * of
        odds = np.log(share.sum(axis=0) + 1) * np.ones((len(n), 1))
        for level, size in coded:
            if size > 1:
                seen = level >= 0
                told = np.stack([np.bincount(level[seen], share[seen, k], size) for k in range(of.shape[1])], axis=1) + 0.5
                odds[seen] += np.log(told / told.sum(axis=0))[level[seen]]
        new = np.exp(odds - odds.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - of).max() < 1e-9:
            break
        of = new
    return of[:, 0]


def judge(seen: DataFrame) -> DataFrame:
    """``reports`` with the probability ``sound``. What is collected are counts of patterns, as many
    as levels of the witnesses and large feeds make."""
    counted = seen.groupBy(*WITNESSES).count().collect()
    if not counted:
        return seen.withColumn("sound", F.lit(0.0))
    patterns = [tuple(r[w] for w in WITNESSES) for r in counted]
    sound = learn(patterns, [r["count"] for r in counted])
    schema = ", ".join(f"{w} string" for w in WITNESSES) + ", sound double"
    known = seen.sparkSession.createDataFrame([(*p, float(s)) for p, s in zip(patterns, sound, strict=True)], schema)
    same = [seen[w].eqNullSafe(known[w]) for w in WITNESSES]
    return seen.join(F.broadcast(known), same).select(*[seen[c] for c in seen.columns], "sound")


def survivors(df: DataFrame) -> DataFrame:
    """(page_key, record_id, sound, records) of each page with two or more records.

    Of the records judged sound the latest captured one survives, null being earliest, of
    equals that with the smallest record_id. Where none is judged sound the likeliest does,
    then the same order. Pages whose texts all are null or blank have no survivor. Each row
    is a record; equal rows don't matter. Other columns are ignored.
    """
    rows = keyed(df.select("record_id", "page_id", "url", "text", "blocks", "feed", "captured_at"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("records")).where("records > 1")
    rows = rows.join(sizes.select("key"), "key", "left_semi")
    judged = judge(cut_lineage(reports(feed_of(rows))))
    sure = F.col("sound") >= SURE
    order = F.struct(
        sure, F.when(~sure, F.round("sound", 6)), F.coalesce(F.col("captured_at").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))), -F.col("record_id")
    )
    best = judged.groupBy("key").agg(F.max_by(F.struct("record_id", "sound"), order).alias("x"))
    return best.join(sizes, "key").select(F.col("key").alias("page_key"), "x.record_id", "x.sound", "records")


def true_values(claims: DataFrame) -> DataFrame:
    """(key, feed, value) -> (key, value, n, truth): how many rows give the value, and the probability
    that the page has it.

    A feed with rows of a page claims the values that they have and denies the page's others.
    Its sensitivity and specificity are inferred with the truth of the values: values claimed
    and denied by the same feeds are alike, so rounds run over counted patterns, in Spark; of feeds,
    at most 1,001, what they add up to is collected.
    """
    given = cut_lineage(claims.groupBy("key", "value", "feed").agg(F.count("*").alias("n")))
    feeds = [r.feed for r in given.select("feed").distinct().orderBy("feed").collect()]
    if not feeds:
        return given.select("key", "value", "n", F.lit(0.0).alias("truth"))
    of_page = given.groupBy("key").agg(F.collect_set("feed").alias("page_feeds"))
    values = given.groupBy("key", "value").agg(F.sum("n").alias("n"), F.collect_set("feed").alias("yes")).join(of_page, "key")

    def numbers(column: str) -> Column:
        listed = F.array(*map(F.lit, feeds))
        return F.array_sort(F.transform(column, lambda f: (F.array_position(listed, f) - 1).cast("int")))

    values = cut_lineage(values.select("key", "value", "n", numbers("yes").alias("yes"), numbers("page_feeds").alias("all")))
    patterns = cut_lineage(values.groupBy("yes", "all").agg(F.count("*").alias("times")))
    truth = F.size("yes") / F.size("all")
    for _ in range(VALUE_ROUNDS):
        told = patterns.withColumn("truth", truth).select("times", "truth", F.explode("all").alias("feed"), "yes")
        claimed = F.array_contains("yes", F.col("feed"))
        true, false = F.col("times") * F.col("truth"), F.col("times") * (1 - F.col("truth"))
        sums = {
            r.feed: r
            for r in told.groupBy("feed").agg(
                F.sum(true).alias("t"), F.sum(false).alias("f"), F.sum(F.when(claimed, true)).alias("yt"), F.sum(F.when(claimed, false)).alias("yf")
            ).collect()
        }
        whole = patterns.agg(F.sum(F.col("times") * truth).alias("t"), F.sum("times").alias("n")).first()
        hit = [((sums[i].yt or 0.0) + 1) / (sums[i].t + 2) for i in range(len(feeds))]
        false_hit = [((sums[i].yf or 0.0) + 0.5) / (sums[i].f + 2) for i in range(len(feeds))]
        yes = F.array(*[F.lit(math.log(h / x)) for h, x in zip(hit, false_hit)])
        no = F.array(*[F.lit(math.log((1 - h) / (1 - x))) for h, x in zip(hit, false_hit)])
        odds = F.aggregate("yes", F.lit(math.log((whole.t + 1) / (whole.n - whole.t + 1))), lambda acc, i: acc + F.get(yes, i))
        odds = F.aggregate(F.array_except("all", "yes"), odds, lambda acc, i: acc + F.get(no, i))
        truth = 1 / (1 + F.exp(-odds))
    return values.select("key", "value", "n", truth.alias("truth"))


def survivor_fields(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """The surviving record of each page, field by field.

    Text and feed are the survivor's, as is ``captured_at``. Titles and urls keep every value that is
    judged true, by falling probability, then by falling number of rows, then in order; ``title``
    and ``url`` are the first, and where none is judged true the likeliest stays. Null and blank
    values are none; a page without any has null.
    """
    rows = keyed(df.select("record_id", "page_id", "title", "url", "text", "feed", "captured_at"))
    text = chosen.join(rows.select("record_id", "text", "feed", "captured_at"), "record_id")
    rows = feed_of(rows.join(chosen.select(F.col("page_key").alias("key")), "key", "left_semi"))

    def values(column: str, value: Column) -> DataFrame:
        judged = true_values(rows.select("key", "feed", value.alias("value")).where("length(trim(value)) > 0"))
        order = F.struct((-F.round("truth", 6)).alias("t"), (-F.col("n")).alias("n"), "value")
        listed = judged.groupBy("key").agg(F.array_sort(F.collect_list(order)).alias("x"))
        kept = F.transform(F.filter("x", lambda v, i: (v["t"] <= -0.5) | (i == 0)), lambda v: v["value"])
        return listed.select(F.col("key").alias("page_key"), kept.alias(f"{column}s"))

    return (
        text.join(values("title", F.trim("title")), "page_key", "left")
        .join(values("url", F.substring_index("url", "?", 1)), "page_key", "left")
        .withColumn("title", F.try_element_at("titles", F.lit(1)))
        .withColumn("url", F.try_element_at("urls", F.lit(1)))
    )
