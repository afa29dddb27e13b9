"""The grid of experiments as configuration files, written from the configurations themselves."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from itertools import product
from pathlib import Path

from recallforge.operators.chunking import ChunkSettings
from recallforge.operators.report import CHUNKERS, RETRIEVERS
from recallforge.plans.config import Bm25, Corpus, Dense, Experiment, Fusion, Rerank, Retrieval

STRATEGY = {"fixed": "fixed_words", "sentence": "sentence_aware", "section": "section_aware"}


def to_toml(value: object, path: tuple[str, ...] = ()) -> str:
    """TOML of any configuration: its own values, then a table for each part. None is left out."""
    own, parts = [], []
    for field in fields(value):
        held = getattr(value, field.name)
        if is_dataclass(held):
            parts.append(to_toml(held, (*path, field.name)))
        elif held is not None:
            own.append(f"{field.name} = {json.dumps(held, ensure_ascii=False)}")
    head = [f"[{'.'.join(path)}]"] if path and own else []
    return "\n\n".join(x for x in ("\n".join(head + own), *parts) if x)


def setup(chunker: str, retriever: str, rerank: bool, flat_tables: bool = False) -> Experiment:
    """The experiment of one cell of the grid."""
    lexical, vectors = retriever == "bm25" or retriever.startswith("hybrid-"), retriever.removeprefix("hybrid-")
    method = {(True, False): "bm25", (False, True): "dense", (True, True): "hybrid"}[lexical, vectors != "bm25"]
    words = [chunker, retriever] + ["rerank"] * rerank + ["flat-tables"] * flat_tables
    return Experiment(
        name="-".join(words),
        corpus=Corpus("natural-questions"),
        chunking=ChunkSettings(STRATEGY[chunker], flatten_tables=flat_tables),
        retrieval=Retrieval(
            method,
            bm25=Bm25() if lexical else None,
            dense=Dense(vectors) if method != "bm25" else None,
            fusion=Fusion() if method == "hybrid" else None,
        ),
        rerank=Rerank("default") if rerank else None,
    )


def write(folder: str) -> list[str]:
    """Bring the folder's ``.toml`` files in line with the grid; the names that it then has."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    cells = {f"{x.name}.toml": to_toml(x) + "\n" for x in (setup(*cell) for cell in product(CHUNKERS, RETRIEVERS, (False, True)))}
    there = {p.name: p.read_text() for p in path.glob("*.toml")}
    for name in there.keys() - cells.keys():
        (path / name).unlink()
    for name in [n for n, text in cells.items() if there.get(n) != text]:
        (path / name).write_text(cells[name])
    return sorted(cells)
