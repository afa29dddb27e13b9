"""Incremental variants, beyond what a batch run needs: answers and timings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recallforge.sources.files import Cache


def append_new(stream: DataFrame, cache: Cache, checkpoint: str) -> StreamingQuery:
    """Put each new (key, value) of a stream into the cache; keys it has stay as they are.

    A batch that is run again after a failure finds its keys there and adds nothing.
    """

    def put(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["key"])
        cache.put(new.join(cache.misses(new), "key", "left_semi"))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_by_window(stream: DataFrame, at: str, value: str, key: str, width: str = "1 hour", late: str = "2 hours", id_col: str | None = None) -> DataFrame:
    """n, mean and max of each key and window; rows later than ``late`` are left out, an id that
    comes again within it counts once."""
    stream = stream.withWatermark(at, late)
    if id_col:
        stream = stream.dropDuplicatesWithinWatermark([id_col])
    return stream.where(F.col(value).isNotNull()).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
