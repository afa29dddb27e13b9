"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "recallforge") -> SparkSession:
    """A session for tests and benchmarks on one machine.

    A cluster brings its own session; nothing in the library builds one.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the context's, else the one that
    ``spark.checkpoint.dir`` names. Only where there is neither and the master is this machine
    (tests) is a temporary folder set; on a cluster that raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local($|\[)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="recallforge-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there.

    The copy outlives the executor that made it, so a lost executor costs its
    running tasks only.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
