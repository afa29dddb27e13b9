"""Splitting of oversized texts at natural boundaries by content-defined chunking.

A landmark is the gap between two words where a rolling hash over the last words is least
within the span a cut may fall in; the cut is the natural boundary nearest to it. Landmarks
depend on the words around them only, so an edit moves the cuts beside it and the pieces
further on stay as they were.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words under the rolling hash.
WINDOW = 6
#: Usable configurations in one pass over the texts; more are taken in further passes.
CONFIGS = 1_000

# Code points with the Unicode property White_Space, no-break spaces included.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_STOPS, _CLOSERS, _CLAUSES = ".!?…。！？", "\"'”’»)]）」", ",;:–—、；："
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_KIND = np.zeros(0x10000, np.uint8)
for _chars, _bit in ((map(ord, _STOPS), 1), (map(ord, _CLOSERS), 2), (map(ord, _CLAUSES), 4), (SPACES, 8)):
    for _c in _chars:
        _KIND[_c] |= _bit


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the text, their kinds, and the start and end of each word."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(code < 0x10000, _KIND[np.minimum(code, 0xFFFF)], 0)
    word = np.concatenate(([False], (kind & 8) == 0, [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return code, kind, edges[::2], edges[1::2]


def gaps_of(code: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the gap after each word but the last: landmark value, and level of the boundary
    (3 line or paragraph, 2 sentence, 1 clause, 0 none)."""
    n = len(code)
    up, down = _powers(_BASE, n), _powers(_INVERSE, n)
    total = np.concatenate(([np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up)))
    word = (total[end] - total[start]) * down[start]
    word ^= word >> np.uint64(29)
    m = len(word)
    up, down = _powers(_BASE, m), _powers(_INVERSE, m)
    total = np.concatenate(([np.uint64(0)], np.cumsum(word * up)))
    first = np.maximum(np.arange(m) - WINDOW + 1, 0)
    roll = (total[1:] - total[first]) * down[first]
    roll = (roll ^ (roll >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    lines = np.concatenate(([0], np.cumsum(code == 10)))
    last, before = kind[end - 1], kind[np.maximum(end - 2, 0)]
    stop = ((last & 1) > 0) | (((last & 2) > 0) & ((before & 1) > 0) & (end - start > 1))
    head = code[start]
    capital = (head >= 65) & (head <= 90)
    lower = (head >= 97) & (head <= 122)
    short = capital & (end - start <= 3) & (code[end - 1] == 46)  # Dr. St. No.
    level = np.where(stop[:-1] & ~short[:-1] & ~lower[1:], 2, np.where((last[:-1] & 6) > 0, 1, 0))
    level[lines[start[1:]] > lines[end[:-1]]] = 3
    return roll[:-1] >> np.uint64(32), level


def cut(n: int, mark: np.ndarray, strong: list[int], weak: list[int], size: int, overlap: int) -> list[int]:
    """Word numbers where new pieces begin, the overlap not counted.

    Piece i is words cuts[i] - overlap up to cuts[i + 1]; all cuts but the last leave at
    least half of what a piece may add.
    """
    most = size - overlap
    if most == 1:
        return [0, *range(size, n)]
    cuts, at = [0], 0
    low, high = max(overlap, size // 2, 1), size
    while n - at > high:
        lo, hi = at + low - 1, at + high - 1  # gaps after these words may be cut
        landmark = lo + int(mark[lo : hi + 1].argmin())
        for boundaries in (strong, weak):
            a, b = bisect_left(boundaries, lo), bisect_right(boundaries, hi)
            if a < b:
                i = bisect_left(boundaries, landmark, a, b)
                near = boundaries[i] if i < b else boundaries[b - 1]
                if i > a and landmark - boundaries[i - 1] <= near - landmark or i == b:
                    near = boundaries[i - 1]
                break
        else:
            near = landmark
        at = near + 1
        cuts.append(at)
        low, high = max(most // 2, 1), most
    return cuts


def _cutter(configs: list[tuple], only_cut: bool, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            spans: list[list] = [[] for _ in configs]
            for number, text in enumerate(batch.column("text").to_pylist()):
                if text is None:
                    continue
                code, kind, start, end = words_of(text)
                n, prepared = len(start), None
                for where, (_, size, overlap) in enumerate(configs):
                    if n > size:
                        if prepared is None:
                            mark, level = gaps_of(code, kind, start, end)
                            prepared = mark, np.flatnonzero(level >= 2).tolist(), np.flatnonzero(level == 1).tolist()
                        cuts = np.array(cut(n, *prepared, size, overlap))
                        first = np.maximum(cuts - overlap, 0)
                        spans[where].append((number, n, start[first], end[np.append(cuts[1:], n) - 1]))
                    elif n and not only_cut:
                        spans[where].append((number, n, start[:1], end[-1:]))
            for (config, _, _), found in zip(configs, spans, strict=True):
                if found:
                    rows, words, starts, ends = zip(*found, strict=True)
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in starts]))), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (starts, ends)]
                    text = [batch.column("text").take(pa.array(rows)).cast(pa.string())] if "text" in schema.names else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([config] * len(rows), schema.field(0).type), batch.column("item").take(pa.array(rows)), pa.array(words, pa.int32()), *lists, *text],
                        schema=schema,
                    )

    return run


def usable(configs: DataFrame) -> DataFrame:
    """Configurations that define pieces: size >= 1, overlap given, 0 <= overlap < size."""
    return configs.where((F.col("size") >= 1) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("size")))


def cut_texts(
    df: DataFrame, configs: DataFrame, id_col: str, config_col: str = "config_id", text_col: str = "text", only_cut: bool = True, keep_text: bool = False
) -> DataFrame:
    """(config, id, words, starts, ends[, text]): the pieces of each text under each usable config.

    ``starts`` and ``ends`` are code-point offsets, half-open, one pair a piece. Pieces have at
    most ``size`` words and share exactly ``overlap`` words with the piece before. A word is a
    longest run without Unicode white space, however long: a text without white space is one word
    and is never cut. A text of at most ``size`` words is one piece, and is left out if
    ``only_cut``; null, empty and blank texts have no pieces. Repeated rows and ids are cut each for
    itself; other columns are ignored. ``keep_text`` passes the text on, so that ``pieces`` need not
    look for it. One pass, no shuffle: a text meets all configurations, or ``CONFIGS`` at a time, in
    the task that reads it.
    """
    chosen = sorted(tuple(c) for c in usable(configs).select(config_col, "size", "overlap").distinct().toLocalIterator())
    items = df.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    config_type, item_type = configs.schema[config_col].dataType, items.schema["item"].dataType
    fields = [("config", to_arrow_type(config_type)), ("item", to_arrow_type(item_type)), ("words", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
    schema = pa.schema(fields + [("text", pa.string())] * keep_text)
    columns = f"config {config_type.simpleString()}, item {item_type.simpleString()}, words int, starts array<int>, ends array<int>" + ", text string" * keep_text
    passes = [items.mapInArrow(_cutter(chosen[i : i + CONFIGS], only_cut, schema), columns) for i in range(0, max(len(chosen), 1), CONFIGS)]
    cuts = reduce(DataFrame.unionByName, passes)
    return cuts.select(F.col("config").alias(config_col), F.col("item").alias(id_col), "words", "starts", "ends", *["text"] * keep_text)


def pieces(cuts: DataFrame) -> DataFrame:
    """One row a piece: the columns of ``cuts`` with piece (from 0), start and end, and with the
    piece's own text where ``cuts`` have the text."""
    keys = [c for c in cuts.columns if c not in ("words", "starts", "ends", "text")]
    text = [F.expr("substring(text, span.starts + 1, span.ends - span.starts)").alias("text")] * ("text" in cuts.columns)
    spans = cuts.select(*keys, *["text"] * len(text), F.posexplode(F.arrays_zip("starts", "ends")).alias("piece", "span"))
    return spans.select(*keys, "piece", F.col("span.starts").alias("start"), F.col("span.ends").alias("end"), *text)
