"""Documents of finished runs: results, written answers, verdicts, timings, reports and baselines.

What is collected into a document are aggregates of setups, types and metrics, never questions;
rows go to JSON lines beside it.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, is_dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from recallforge.operators import report
from recallforge.sources import files

#: Version of the documents' form.
SCHEMA_VERSION = 4


def rows_of(df: DataFrame, *order: str) -> list[dict]:
    """A small table as plain rows."""
    return [r.asDict(recursive=True) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def folder_name(started: datetime, digest: str) -> str:
    return f"{started.astimezone(UTC):%Y%m%dT%H%M%SZ}-{digest[:12]}"


def document(kind: str, config: object, started: datetime, finished: datetime, commit: str, digest: str, **parts: DataFrame | object) -> dict:
    """One run's document; tables among its parts become lists of rows."""
    told = {k: rows_of(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
    return {
        "schema_version": SCHEMA_VERSION, "kind": kind, "config": asdict(config) if is_dataclass(config) else config, "config_digest": digest,
        "started": started.astimezone(UTC).isoformat(), "finished": finished.astimezone(UTC).isoformat(), "commit": commit, **told,
    }


def publish(results: str, made: dict, rows: dict[str, DataFrame] | None = None) -> Path:
    """A run's folder, whole or not at all: rows as JSON lines first, then the document, by which
    readers know that the run is finished."""
    name = folder_name(datetime.fromisoformat(made["started"]), made["config_digest"])
    target = Path(results) / name
    if target.exists():
        raise FileExistsError(target)
    staged = Path(results) / f".rows-{name}"
    for part, df in (rows or {}).items():
        files.write_jsonl(df, str(staged / part))
    files.publish(results, name, {})
    for part in rows or {}:
        (staged / part).rename(target / part)
    if rows:
        staged.rmdir()
    draft = target / ".result.json"
    draft.write_text(json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")
    draft.rename(target / "result.json")
    return target


def load_runs(spark: SparkSession, results: str, kind: str = "experiment") -> DataFrame:
    """(setup, started, commit, level, answer_type, metric, value) of the latest finished run of every
    setup; runs of several commits or forms raise, as does a folder without a run."""
    latest: dict[str, dict] = {}
    for path in sorted(Path(results).glob("[!.]*/result.json")):
        made = json.loads(path.read_text())
        if made["kind"] == kind:
            if made["schema_version"] != SCHEMA_VERSION:
                raise ValueError(f"{path}: form {made['schema_version']} is not {SCHEMA_VERSION}")
            latest[made["config"]["name"]] = made
    if not latest:
        raise FileNotFoundError(f"no finished run in {results}")
    if len({m["commit"] for m in latest.values()}) > 1:
        raise ValueError("runs of more than one commit")
    rows = [(s, m["started"], m["commit"], a["level"], a["answer_type"], a["metric"], a["value"]) for s, m in latest.items() for a in m["averages"]]
    return spark.createDataFrame(rows, "setup string, started string, commit string, level string, answer_type string, metric string, value double")


def record_baseline(path: str, measured: DataFrame, tolerance: float = 0.0) -> dict:
    """Write what was measured (setup, metric, value) as the gate's baseline. Tolerances that the
    file has stay; new metrics get ``tolerance``; setups that were not measured stay as they are."""
    file = Path(path)
    known = json.loads(file.read_text()) if file.exists() else {"setups": {}}
    for r in measured.where("value IS NOT NULL").collect():
        metrics = known["setups"].setdefault(r.setup, {}).setdefault("metrics", {})
        metrics[r.metric] = {"expected": r.value, "tolerance": metrics.get(r.metric, {}).get("tolerance", tolerance)}
    draft = file.with_name(f".{file.name}")
    draft.write_text(json.dumps(known, indent=2, sort_keys=True) + "\n")
    draft.rename(file)
    return known


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(setup, metric, expected, tolerance), as ``report.gate`` takes it."""
    known = json.loads(Path(path).read_text())["setups"]
    rows = [(s, m, float(x["expected"]), float(x["tolerance"])) for s, held in known.items() for m, x in held["metrics"].items()]
    return spark.createDataFrame(rows, "setup string, metric string, expected double, tolerance double")


def assemble(title: str, sections: dict[str, DataFrame | None], notes: dict[str, str] | None = None) -> tuple[dict, str]:
    """A report as a JSON document and as Markdown. Sections come in the order given; one that is
    None is left out, one without rows says so."""
    made, lines = {"title": title}, [f"# {title}"]
    for name, df in sections.items():
        if df is None:
            continue
        rows = rows_of(df)
        made[name] = rows
        lines += ["", f"## {name}", *([notes[name], ""] if notes and name in notes else [""])]
        lines += report.markdown(rows, df.columns) if rows else ["No rows."]
    return made, "\n".join(lines) + "\n"


class JsonLines(logging.Formatter):
    """Log records as one JSON object a line; extra fields stand beside the message."""

    _plain = set(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}

    def format(self, record: logging.LogRecord) -> str:
        told = {"at": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        told |= {k: v for k, v in vars(record).items() if k not in self._plain}
        if record.exc_info:
            told["error"] = self.formatException(record.exc_info)
        return json.dumps(told, ensure_ascii=False, default=str)


def append_label(path: str, shown: str, label: dict, known: dict[tuple, dict]) -> bool:
    """Append one label (setup, question_id, label, ...) to a JSON-lines file at once. A pair that has
    a label is left as it is; if it was given to another text, that raises. ``known`` holds the labels
    so far and is kept up to date."""
    digest = files.hashlib.sha256(shown.encode()).hexdigest()
    key = label["setup"], label["question_id"]
    if key in known:
        if known[key]["shown_sha256"] != digest:
            raise ValueError(f"{key} was labelled on another text")
        return False
    row = label | {"shown_sha256": digest, "labelled_at": datetime.now(UTC).isoformat()}
    with open(path, "a") as out:
        out.write(json.dumps(row, ensure_ascii=False) + "\n")
        out.flush()
    known[key] = row
    return True
