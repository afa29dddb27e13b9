"""Files of the engine: JSON lines with fixed schemas, run files, published folders, caches."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Schemas of built corpora, answers, verdicts and labels.
SCHEMAS = {
    "pages": "page_id string, title string, url string, text string, blocks array<struct<kind:string,section:string,text:string,start:int,end:int,caption:string,header:array<string>,rows:array<array<string>>>>",
    "questions": "question_id string, question string, page_id string, answer_start int, answer_end int, short_answers array<string>, answer_type string",
    "answers": "setup string, question_id string, question string, answer_type string, chunk_ids array<string>, passages array<string>, text string, declined boolean, prompt_tokens int, output_tokens int, seconds double",
    "scored": "setup string, question_id string, declined boolean, correctness string, groundedness string, nli double, lexical double, contains boolean, cost double",
    "labels": "setup string, question_id string, label string, shown_sha256 string, position string, labelled_at string",
}


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines, gzipped or not, of a known kind; a line of another shape raises when read, as does
    one that lacks a key: the error names the file and the keys. Blank lines are skipped. Types are
    never inferred."""
    names = [f.name for f in StructType.fromDDL(SCHEMAS[kind]).fields]
    lines = spark.read.text(path).where("length(trim(value)) > 0").select("value", F.col("_metadata.file_name").alias("file"))
    lacking = F.array_except(F.array(*map(F.lit, names)), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")))
    parsed = F.from_json("value", SCHEMAS[kind], {"mode": "FAILFAST"})
    whole = F.when(F.size(lacking) == 0, parsed).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(": malformed, a line lacks "), F.array_join(lacking, ", "))))
    return lines.select(whole.alias("row")).select("row.*")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """Gzipped JSON lines; refuses to overwrite. The folder appears whole or not at all."""
    if one_file:
        df = df.coalesce(1)
    (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def copy_lines(spark: SparkSession, source: str, target: str, field: str, keep: DataFrame) -> None:
    """Lines of ``source`` whose ``field`` is in ``keep`` (value), byte for byte and in their order: by
    file and place in it."""
    lines = spark.read.text(source).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("_v", F.get_json_object("value", f"$.{field}"))
    kept = lines.join(keep.select(F.col("value").alias("_v")).distinct(), "_v", "left_semi")
    kept.orderBy("_f", "_at").select("value").write.mode("errorifexists").option("compression", "gzip").text(target)


def read_trec(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """(question_id, rank, chunk_id, score, tag) of a run file, ranks of at most ``depth``; a line
    that is not six columns raises. Blank lines are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    six = F.when(F.size(parts) == 6, parts).otherwise(F.raise_error(F.concat(F.lit("not six columns: "), "value")))
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(six.alias("p"))
    return rows.select(
        F.col("p")[0].alias("question_id"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[2].alias("chunk_id"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("tag")
    ).where(F.col("rank") <= depth)


def write_trec(rows: DataFrame, path: str) -> None:
    """(question_id, rank, line) as text, ordered by question and rank."""
    rows.repartitionByRange("question_id").sortWithinPartitions("question_id", "rank").select("line").write.mode("errorifexists").text(path)


def publish(folder: str, name: str, documents: dict[str, object]) -> Path:
    """Write small JSON documents of a run into a folder that appears at once and is never
    overwritten."""
    target, staging = Path(folder) / name, Path(folder) / f".incomplete-{name}"
    if target.exists():
        raise FileExistsError(target)
    staging.mkdir(parents=True)
    for file, document in documents.items():
        (staging / file).write_text(document if isinstance(document, str) else json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    return staging.rename(target)


def run_name(started: Column, digest: Column) -> Column:
    """Folder of a run: UTC start and the beginning of its configuration's digest."""
    return F.concat(F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.left(digest, F.lit(12)))


def latest_run(folder: str, document: str = "result.json") -> Path:
    """The finished run with the greatest name; hidden and unfinished ones don't count."""
    runs = [p for p in Path(folder).iterdir() if not p.name.startswith(".") and (p / document).exists()] if Path(folder).exists() else []
    if not runs:
        raise FileNotFoundError(f"no finished run in {folder}")
    return max(runs, key=lambda p: p.name)


def one_commit(runs: DataFrame, column: str = "commit") -> None:
    """Raise unless all runs come from one commit."""
    found = [r[0] for r in runs.select(column).distinct().take(2)]
    if len(found) > 1:
        raise ValueError("runs of more than one commit")


def canonical_digest(document: object, ascii_only: bool = True) -> str:
    """SHA-256 of the JSON with sorted keys and no spaces."""
    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    return hashlib.sha256(text.encode()).hexdigest()


def verified(path: str, size: int, sha256: str) -> bool:
    """Whether a fetched file is the pinned one; another is deleted, so that it is fetched again."""
    file = Path(path)
    if not file.exists():
        return False
    with file.open("rb") as data:
        same = file.stat().st_size == size and hashlib.file_digest(data, "sha256").hexdigest() == sha256
    if not same:
        file.unlink()
    return same


class Cache:
    """Append-only table of (key, value): the last put of a key holds. Each append is a batch of
    files that appears whole, so a torn batch is never read."""

    def __init__(self, spark: SparkSession, folder: str, value_type: str = "string"):
        self.spark, self.folder, self.schema = spark, folder, f"key string, value {value_type}, batch bigint"

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def get(self) -> DataFrame:
        """(key, value) as last put."""
        return self.rows().groupBy("key").agg(F.max_by("value", "batch").alias("value"))

    def misses(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").distinct().join(self.rows().select("key"), "key", "left_anti")

    def put(self, rows: DataFrame) -> None:
        last = self.rows().agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]
        rows.select("key", "value", F.lit(last + 1).cast("bigint").alias("batch")).write.mode("append").parquet(self.folder)


def numbered_vectors(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Vectors of requested keys in the order of the request, repeats included; a missing key raises."""
    joined = requests.join(store, "text_key", "left")
    return joined.withColumn("vector", F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.lit("a text has no vector"))))


def dictionary(rows: DataFrame, column: str, order: str, group: str) -> DataFrame:
    """Each value with its number by first appearance in its group: what an export refers to."""
    first = rows.groupBy(group, column).agg(F.min(order).alias("_first"))
    return first.withColumn("code", F.row_number().over(Window.partitionBy(group).orderBy("_first", column)) - 1).drop("_first")
