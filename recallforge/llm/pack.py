"""Packing of items into containers of fixed capacity: best-fit decreasing.

Best fit needs no item, only how many there are of each size, and there are at most
``capacity`` sizes. So the sizes are counted (a shuffle of counts), one task per container
kind packs the counts, bins of equal free space moving together as ranges, and each item
finds its bin by its number among the items of its size. The packing is that of best-fit
decreasing over all items at once, at any number of items; no partition keeps bins of
its own.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallforge.llm.vocabulary import SPLIT_PATTERN, rank_file, read_ranks
from recallforge.session import cut_lineage

#: Numbers within a size are given in independent parts of about so many items, so that a size
#: that most items share is not numbered by one task.
PART_ITEMS = 200_000
#: Kinds of container in one literal; more are taken in further literals.
KINDS = 1_000
#: Items of a size per join key when looking up bins.
BLOCK = 8_192


class SpaceTree:
    """Segment tree over free space 0..capacity, true where some open bin has that much."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, free: int, there: bool) -> None:
        i = free + self.base
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest free space of ``least`` or more that some bin has."""
        i = least + self.base
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.base:
                    i *= 2
                    i += not self.any[i]
                return i - self.base
            i >>= 1
        return None


def pack_counts(capacity: int, sizes: list[int], counts: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counted sizes.

    Returns runs (size, first item number, items, first bin, items per bin) and the number of
    bins. Item numbers count from 0 within a size; in a run each bin takes ``items per bin``
    consecutive items. Sizes must be 1..capacity.
    """
    tree, open_bins = SpaceTree(capacity), {}
    runs, bins = [], 0

    def put(free: int, first: int, count: int) -> None:
        if free > 0:
            if free not in open_bins:
                open_bins[free] = []
                tree.set(free, True)
            open_bins[free].append((first, count))

    for size, left in sorted(zip(sizes, counts, strict=True), reverse=True):
        at = 0
        while left:
            free = tree.tightest(size)
            if free is None:
                each = capacity // size
                first, count, free = bins, -(-left // each), capacity
                bins += count
            else:
                first, count = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                    tree.set(free, False)
                each = free // size
            # whole bins first, then one bin with what is left, then bins not needed
            whole = min(count, left // each)
            if whole:
                runs.append((size, at, whole * each, first, each))
                put(free - each * size, first, whole)
                at, left = at + whole * each, left - whole * each
            if left and whole < count:
                runs.append((size, at, left, first + whole, left))
                put(free - left * size, first + whole, 1)
                at, left, whole = at + left, 0, whole + 1
            if whole < count:
                put(free, first + whole, count - whole)
    return runs, bins


def _runs_of(key, group: pd.DataFrame) -> pd.DataFrame:
    box, capacity = key
    runs, _ = pack_counts(int(capacity), [int(x) for x in group["size"]], [int(x) for x in group["n"]])
    out = pd.DataFrame(runs, columns=["size", "from_item", "items", "first_bin", "per_bin"])
    out.insert(0, "box", box)
    return out


def pack_items(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """items (item, size) and boxes (box, capacity) -> (box, capacity, bin, item, part, size).

    Bins of a box are numbered from 0. An item larger than the capacity is cut into parts of
    exactly the capacity and a rest, numbered from 0; any other item is one part. Items of
    null, zero or negative size take no space and ride in bin 0. Boxes whose capacity is null
    or below 1 are not usable and give no rows; equal boxes count once. Repeated items are
    separate items. Of items of one size the order of ``item`` decides; other columns are
    ignored. Sizes are computed once: they are written to the shared folder.
    """
    boxes = boxes.select("box", F.col("capacity").cast("bigint").alias("capacity")).where("capacity >= 1").distinct()
    kinds = list(boxes.toLocalIterator())
    kind_type = f"array<struct<box:{boxes.schema['box'].dataType.simpleString()},capacity:bigint>>"
    sized = cut_lineage(items.select("item", F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("whole")))
    numbering = 1 + sized.count() // PART_ITEMS
    listed = [
        sized.select("*", F.inline(F.array(*(F.struct(F.lit(k["box"]), F.lit(k["capacity"])) for k in kinds[i : i + KINDS])).cast(kind_type)))
        for i in range(0, max(len(kinds), 1), KINDS)
    ]
    parted = (
        reduce(DataFrame.unionByName, listed)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / F.col("capacity")) - 1, F.lit(0)).cast("int"))))
        .withColumn("size", F.least(F.col("whole") - F.col("part") * F.col("capacity"), "capacity"))
        .drop("whole")
        .withColumn("share", F.pmod(F.xxhash64("item", "part"), F.lit(numbering)))
    )
    keys = ["box", "size", "share"]
    shares = parted.where("size > 0").groupBy("box", "capacity", "size", "share").count()
    runs = (
        shares.groupBy("box", "capacity", "size")
        .agg(F.sum("count").alias("n"))
        .groupBy("box", "capacity")
        .applyInPandas(_runs_of, f"box {boxes.schema['box'].dataType.simpleString()}, size bigint, from_item bigint, items bigint, first_bin bigint, per_bin bigint")
    )
    before = shares.withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("box", "size").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select(*keys, "before")
    numbered = (
        parted.where("size > 0")
        .withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("item", "part")) - 1)
        .join(before, keys)
        .withColumn("n", F.col("n") + F.col("before"))
        .withColumn("block", F.floor(F.col("n") / BLOCK))
    )
    blocks = runs.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("from_item") / BLOCK), F.floor((F.col("from_item") + F.col("items") - 1) / BLOCK)))
    )
    placed = (
        numbered.join(blocks, ["box", "size", "block"])
        .where((F.col("n") >= F.col("from_item")) & (F.col("n") < F.col("from_item") + F.col("items")))
        .withColumn("bin", F.col("first_bin") + F.floor((F.col("n") - F.col("from_item")) / F.col("per_bin")))
    )
    columns = ["box", "capacity", "bin", "item", "part", "size"]
    empty = parted.where("size = 0").withColumn("bin", F.lit(0).cast("bigint"))
    return placed.select(*columns).unionByName(empty.select(*columns))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(item, size): the number of tokens of each text; null and empty texts have 0."""
    ranks = read_ranks(path or rank_file())  # goes with the function: executors need no file

    def count(batches):
        coder = tiktoken.Encoding("sizes", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "size": np.fromiter((len(coder.encode_ordinary(t)) for t in batch["text"]), "int64", len(batch))})

    item = df.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return item.mapInPandas(count, f"item {item.schema['item'].dataType.simpleString()}, size bigint")
