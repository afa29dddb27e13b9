"""Running sums and exact percentiles over any number of rows of a key, without one task for a key.

Rows are range-partitioned in order, summed within partitions, and each partition adds what the
ones before it hold: as many totals as partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.session import cut_lineage


def running(rows: DataFrame, keys: list[str], order: list[str], **sums: str) -> DataFrame:
    """``rows`` with, for each ``name=column``, the sum of the column over the rows of the key up to and
    with this one, in ``order``, which has no ties within a key. Null keys are keys."""
    ranged = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    told = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(offsets, same)
    return told.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def percentiles(rows: DataFrame, keys: list[str], value: str, **at: tuple[float, bool]) -> DataFrame:
    """(keys, each name): exact percentiles of the values that are not null, ``name=(share,
    interpolated)``; else the nearest rank. Values are counted first, so repeated ones cost nothing."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_times"))
    summed = running(counted, keys, ["_v"], _upto="_times")
    size = counted.groupBy(*keys).agg(F.sum("_times").alias("_n"))
    same = F.lit(True)
    for k in keys:
        same &= summed[k].eqNullSafe(size[k])
    placed = (summed.join(size, same).select(*[summed[k] for k in keys], "_v", "_upto", "_n")) if keys else summed.join(F.broadcast(size))

    def reach(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v")))

    columns, names = [], []
    for name, (share, between) in at.items():
        if between:
            exact = F.lit(share) * (F.col("_n") - 1)
            columns += [reach(F.floor(exact) + 1).alias(f"_low_{name}"), reach(F.ceil(exact) + 1).alias(f"_high_{name}"), F.max(exact - F.floor(exact)).alias(f"_f_{name}")]
            names.append((F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_f_{name}")).alias(name))
        else:
            columns.append(reach(F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(1))).alias(name))
            names.append(F.col(name))
    return placed.groupBy(*keys).agg(*columns).select(*keys, *names)


def with_percentiles(summary: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``summary`` of each key with its median (interpolated) and p95 (nearest rank)."""
    found = percentiles(rows, keys, value, p50=(0.5, True), p95=(0.95, False)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "p50", "p95")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return summary.join(found, same, "left").drop(*[f"_k_{k}" for k in keys])
