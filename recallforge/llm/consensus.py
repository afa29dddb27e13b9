"""Consensus of several annotators' labels by spectral reliability.

The agreement matrix is centred by chance: entry (a, b) is how often annotators a and b give the
same label on the items both labelled, less what their own shares of the labels let one expect,
and is divided by the geometric mean of all overlaps of each: the correction for unequal
volumes. Its leading eigenvector tells how far each annotator follows what the others have in
common. The same matrix counted for one label tells how far an annotator's votes for that label
do: some are reliable but for a label that they give out of habit. All these matrices are the
blocks of one, and one power iteration, whose steps are joins of the sparse matrix with the
vector, finds the leading eigenvector of every block. Reliabilities become weights of the votes.

The matrix has an entry for each pair of annotators who share an item of at most ``WIDE``
votes. Items that more annotators labelled enter a step without pairs, as sums over each
label's votes: the product with the vector is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.session import cut_lineage

#: The iteration is shifted, so that the leading eigenvalue is the greatest and not the one of greatest
#: size. Every LOOK steps blocks are normed; it ends where no block's growth over them, and no entry of the
#: block of all labels, changed by more than TOLERANCE, or after so many steps.
SHIFT, LOOK, TOLERANCE, STEPS = 0.2, 8, 5e-4, 320
#: Reliabilities are kept off 0 and 1 by this much when they become weights.
EDGE = 0.02
#: Votes that the annotator's reliability counts for beside that of their votes for a label.
PRIOR = 5
#: Share of the votes from which a label has a block of its own: at most 100 labels do. Rarer ones are
#: taken to agree by no chance, and their votes weigh by the reliability over all labels.
COMMON = 0.01
#: Votes of an item that is taken apart into pairs, at most.
WIDE = 50
#: The block of all labels.
ALL = "*"


def votes(df: DataFrame, item_col: str, annotator_col: str, label_col: str) -> DataFrame:
    """(item, annotator, label), one row for an item and annotator. Labels are of any type with an
    order.

    Null items, annotators and labels are no votes. An annotator who labelled an item more
    than once counts once, with the label given most often, of equals the smallest.
    """
    rows = df.select(F.col(item_col).alias("item"), F.col(annotator_col).alias("annotator"), F.col(label_col).alias("label")).na.drop()
    counted = rows.groupBy("item", "annotator", "label").count()
    return counted.groupBy("item", "annotator").agg(F.min(F.struct(-F.col("count"), "label")).getField("label").alias("label"))


def chance_of(voted: DataFrame) -> float:
    """The chance that two votes agree: the sum of squared shares of the labels."""
    counted = voted.groupBy("label").count()
    n, squares = counted.agg(F.sum(F.col("count").cast("double")), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    return squares / n / n if n else 0.0


def _block(label) -> Column:
    return F.concat(F.lit("="), F.col(label).cast("string"))


def shares(voted: DataFrame) -> DataFrame:
    """(annotator, block, n, p): votes for each common label and their share of the annotator's, and
    those of all labels."""
    by_label = voted.groupBy("annotator", _block("label").alias("block")).agg(F.count("*").alias("n"))
    total = by_label.groupBy("annotator").agg(F.sum("n").alias("n"))
    blocks = by_label.groupBy("block").agg(F.sum("n").alias("all")).join(F.broadcast(total.agg(F.sum("n").alias("votes"))))
    common = blocks.where(F.col("all") >= COMMON * F.col("votes")).select("block")
    labelled = by_label.join(common, "block").join(total.withColumnRenamed("n", "total"), "annotator").select("annotator", "block", "n", (F.col("n") / F.col("total")).alias("p"))
    return labelled.unionByName(total.select("annotator", F.lit(ALL).alias("block"), "n", F.lit(1.0).alias("p")))


class Agreement:
    """The agreement matrix of some votes: ``entries`` (a, b, block, e) of pairs, ``terms`` of items
    of more than ``wide`` votes, and the ``nodes`` (annotator, block, n, p, overlap, scale) of its
    rows."""

    def __init__(self, voted: DataFrame, wide: int = WIDE):
        self.chance = chance_of(voted)
        known = cut_lineage(shares(voted))
        sizes = voted.groupBy("item").agg(F.count("*").alias("size"))
        sized = voted.join(sizes.where("size > 1"), "item")
        overlap = sized.groupBy("annotator").agg(F.sum(F.col("size") - 1).cast("double").alias("overlap"))
        self.nodes = cut_lineage(known.join(overlap, "annotator").withColumn("scale", F.sqrt(F.col("overlap") * F.col("p"))))
        labelled = known.where(F.col("block") != ALL).select("annotator", "block", "p")
        narrow = sized.where(F.col("size") <= wide).groupBy("item").agg(F.collect_list(F.struct("annotator", _block("label").alias("block"))).alias("all"))
        pairs = (
            narrow.select("all", F.explode("all").alias("x"))
            .select("x", F.explode("all").alias("y"))
            .where("x.annotator <> y.annotator")
            .groupBy(F.col("x.annotator").alias("a"), F.col("y.annotator").alias("b"), F.col("x.block").alias("block"))
            .agg(F.count("*").alias("n"), F.count_if(F.col("x.block") == F.col("y.block")).alias("both"))
        )
        pairs = cut_lineage(pairs)
        totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"), F.sum("both").alias("both"))
        expected = (
            totals.select("a", "b", "shared")
            .join(labelled.select(F.col("annotator").alias("a"), "block", F.col("p").alias("pa")), "a")
            .join(labelled.select(F.col("annotator").alias("b"), "block", F.col("p").alias("pb")), ["b", "block"])
            .select("a", "b", "block", (F.col("shared") * F.col("pa") * F.col("pb")).alias("chance"))
        )
        by_label = expected.join(pairs.select("a", "b", "block", "both"), ["a", "b", "block"], "left").select(
            "a", "b", "block", (F.coalesce("both", F.lit(0)) - F.col("chance")).alias("e")
        )
        chances = expected.groupBy("a", "b").agg(F.sum("chance").alias("chance"))
        overall = totals.join(chances, ["a", "b"], "left").select("a", "b", F.lit(ALL).alias("block"), (F.col("both") - F.coalesce("chance", F.lit(0.0))).alias("e"))
        scales = self.nodes.select("annotator", "block", "scale")
        self.entries = cut_lineage(
            by_label.unionByName(overall)
            .join(scales.select(F.col("annotator").alias("a"), "block", F.col("scale").alias("sa")), ["a", "block"])
            .join(scales.select(F.col("annotator").alias("b"), "block", F.col("scale").alias("sb")), ["b", "block"])
            .select("a", "b", "block", (F.col("e") / (F.col("sa") * F.col("sb"))).alias("w"))
            .unionByName(scales.select(F.col("annotator").alias("a"), F.col("annotator").alias("b"), "block", F.lit(SHIFT).alias("w")))
        )
        self.terms = None
        broad = sized.where(F.col("size") > wide).select("item", "annotator", _block("label").alias("label"))
        if broad.take(1):
            chosen = broad.select("item", "annotator", "label", F.lit(1.0).alias("c"), F.lit(1).alias("sign"))
            by_chance = broad.select("item", "annotator").join(labelled, "annotator").select("item", "annotator", F.col("block").alias("label"), F.col("p").alias("c"), F.lit(-1).alias("sign"))
            both = chosen.unionByName(by_chance).withColumn("block", F.explode(F.array("label", F.lit(ALL))))
            self.terms = cut_lineage(both.join(scales, ["annotator", "block"]).withColumn("c", F.col("c") / F.col("scale")).drop("scale"))

    def times(self, vector: DataFrame) -> DataFrame:
        """Parts of the shifted matrix times (annotator, block, x): (annotator, block, x), to be summed."""
        one = vector.select(F.col("annotator").alias("b"), "block", "x")
        parts = self.entries.join(one, ["b", "block"]).select(F.col("a").alias("annotator"), "block", (F.col("w") * F.col("x")).alias("x"))
        if self.terms is None:
            return parts
        placed = self.terms.join(vector.select("annotator", "block", "x"), ["annotator", "block"])
        keys = ["item", "block", "label", "sign"]
        sums = placed.groupBy(*keys).agg(F.sum(F.col("c") * F.col("x")).alias("t"))
        wide = placed.join(sums, keys).select("annotator", "block", (F.col("sign") * F.col("c") * (F.col("t") - F.col("c") * F.col("x"))).alias("x"))
        return parts.unionByName(wide)

    def leading(self) -> DataFrame:
        """(annotator, block, g): the leading eigenvector of each block, so scaled that the product
        of two annotators' g is their agreement beyond chance, in shares of their overlap."""
        nodes = self.nodes.select("annotator", "block", "scale", "overlap")

        def normed(rows: DataFrame) -> DataFrame:
            norm = rows.groupBy("block").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            return cut_lineage(rows.join(norm, "block").withColumn("x", F.coalesce(F.try_divide("x", "norm"), F.lit(0.0))))

        vector = normed(nodes.select("annotator", "block", F.col("scale").alias("x")))
        for _ in range(0, STEPS, LOOK):
            moved = vector.select("annotator", "block", "x")
            for _ in range(LOOK):
                moved = self.times(moved).groupBy("annotator", "block").agg(F.sum("x").alias("x"))
                # a step with wide items reads the vector more than once
                moved = moved if self.terms is None else cut_lineage(moved)
            before, vector = vector, normed(moved)
            change = vector.join(before.select("annotator", "block", F.col("x").alias("x0"), F.col("norm").alias("norm0")), ["annotator", "block"]).agg(
                F.max(F.abs(F.col("norm") - F.col("norm0")) / F.col("norm")), F.max(F.when(F.col("block") == ALL, F.abs(F.col("x") - F.col("x0"))))
            ).first()
            if max(x or 0.0 for x in change) <= TOLERANCE:
                break
        # the eigenvalue; and one sign for a whole block: most of the votes are with it
        image = self.times(vector).groupBy("annotator", "block").agg(F.sum("x").alias("image"))
        rows = vector.join(image, ["annotator", "block"], "left").join(nodes, ["annotator", "block"])
        of_block = rows.groupBy("block").agg(
            (F.sum(F.col("x") * F.coalesce("image", F.lit(0.0))) - SHIFT * F.sum(F.col("x") * F.col("x"))).alias("value"),
            F.when(F.sum(F.col("x") * F.col("scale")) < 0, -1).otherwise(1).alias("turn"),
            F.sum("overlap").alias("all"),
        )
        root = F.sqrt(F.greatest("value", F.lit(0.0)) * F.col("all") / F.col("overlap"))
        return rows.join(of_block, "block").select("annotator", "block", (F.col("turn") * F.col("x") * root).alias("g"))


def reliabilities(voted: DataFrame, wide: int = WIDE) -> DataFrame:
    """(annotator, block, n, p, g, reliability) of every annotator, over all labels (block ``ALL``) and
    for each label.

    Over all labels, reliability is the share of labels that follow the consensus beyond chance,
    from EDGE to 1 - EDGE: one who contradicts it is at the lower edge. Annotators without shared
    items are not in the result; of a label's rows the reliability is null (``consensus`` needs the
    labels' shares first).
    """
    matrix = Agreement(voted, wide)
    left = max(1 - matrix.chance, 1e-12)
    bounded = F.greatest(F.lit(EDGE), F.least(1 - F.lit(EDGE), F.col("g") / left**0.5))
    return cut_lineage(
        matrix.leading().join(matrix.nodes.select("annotator", "block", "n", "p"), ["annotator", "block"])
        .withColumn("reliability", F.when(F.col("block") == ALL, bounded))
    )


def _elect(voted: DataFrame) -> DataFrame:
    """(item, annotator, label, w) -> (item, label, support, agreement, votes)."""
    by_label = voted.groupBy("item", "label").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    best = F.min(F.struct((-F.round("w", 9)).alias("w"), (-F.col("n")).alias("n"), "label"))
    found = by_label.groupBy("item").agg(
        best.alias("best"), F.sum(F.greatest("w", F.lit(0.0))).alias("all"), F.sum("n").alias("votes"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")
    )
    return found.select(
        "item",
        F.col("best.label").alias("label"),
        F.try_divide(-F.col("best.w"), F.col("all")).alias("support"),
        F.try_divide(F.col("same"), F.col("votes") * (F.col("votes") - 1)).alias("agreement"),
        "votes",
    )


def consensus(voted: DataFrame, reliability: DataFrame) -> DataFrame:
    """(item, label, support, agreement, votes): the label with the greatest sum of weights.

    A vote weighs the log of how much likelier it is right than any one of the other labels.
    How likely a vote for a label is right follows from the annotator's entry in that label's
    eigenvector and from how common the label is, by an election with the reliabilities over all
    labels; with few votes for it, it is drawn towards the annotator's reliability. ``support`` is
    the label's share of the weights, ``agreement`` the share of pairs of votes that agree (null of a
    single vote). Of equal labels the one with more votes wins, then the smallest. Annotators
    without an estimate count half.
    """
    chance = chance_of(voted)
    others = max(1 / chance if chance > 0 else 2.0, 2.0)

    def weight(p: Column) -> Column:
        p = F.greatest(F.lit(EDGE), F.least(1 - F.lit(EDGE), p))
        return F.log(p * others / (1 - p))

    overall = reliability.where(F.col("block") == ALL).select("annotator", (F.col("reliability") * (1 - chance) + chance).alias("right"))
    half = 0.5 * (1 - chance) + chance
    rated = voted.join(overall, "annotator", "left").withColumn("right", F.coalesce("right", F.lit(half)))
    won = _elect(rated.withColumn("w", weight(F.col("right")))).groupBy(_block("label").alias("block")).agg(F.count("*").alias("won"))
    common = won.join(F.broadcast(won.agg(F.sum("won").alias("items")))).select("block", (F.col("won") / F.col("items")).alias("pi"))
    pi = F.least("pi", F.lit(1 - 1e-9))
    right = F.greatest(F.lit(EDGE), F.least(1 - F.lit(EDGE), pi + (1 - pi) * F.col("g") * F.sqrt(pi / ((1 - pi) * F.col("p")))))
    of_label = (
        reliability.where(F.col("block") != ALL)
        .join(common, "block")
        .join(overall, "annotator")
        .select("annotator", "block", weight((F.col("n") * right + PRIOR * F.col("right")) / (F.col("n") + PRIOR)).alias("of_label"))
    )
    weighed = rated.withColumn("block", _block("label")).join(of_label, ["annotator", "block"], "left")
    return _elect(weighed.withColumn("w", F.coalesce("of_label", weight(F.col("right")))))


def annotators(reliability: DataFrame) -> DataFrame:
    """(annotator, reliability, votes) over all labels."""
    return reliability.where(F.col("block") == ALL).select("annotator", "reliability", F.col("n").alias("votes"))

