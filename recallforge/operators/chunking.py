"""Passages: fixed windows of words, natively; sentences, sections and tables page by page."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.functions import text as tx
from recallforge.functions.sentences import sentence_spans

STRATEGIES = ("fixed_words", "sentence_aware", "section_aware")
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class ChunkSettings:
    strategy: str = "fixed_words"
    size: int = 150
    overlap: int = 30
    flatten_tables: bool = False

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; known: {', '.join(STRATEGIES)}")
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError("size must be at least 1 and overlap at least 0 and below size")


def prefix(title: Column, section: Column) -> Column:
    """The line above a passage: title, and section if there is one."""
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(title, F.lit(" > "), section)).otherwise(title)


def chunk_id(page: Column, position: Column) -> Column:
    return F.concat(page.cast("string"), F.lit("#"), position.cast("string"))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a text as an array of (position, start, end, body).

    A window has ``size`` words and begins ``size - overlap`` words after the one before; the
    first that reaches the last word is the last. The body is the exact slice. Texts without
    words have none. A window is some whole blocks of as many words as windows are apart and
    the beginning of the next, so nothing is exploded into words.
    """
    stride = size - overlap
    whole, rest = divmod(size, stride)
    # rare spaces become plain ones, one for one: the expressions then need the plain classes, which are several times
    # faster, and the places are those in the text itself, which bodies are cut from
    plain, item = tx.plain_spaces(text), r"(?:\S+\s*+)"
    lead = F.length(F.regexp_extract(plain, r"^\s*", 0))
    blocks = F.regexp_extract_all(plain, F.lit(f"({item}{{1,{stride}}})"), F.lit(1))

    def starts(b: Column) -> Column:
        # where each block begins: one running sum over the page
        first = F.struct(lead.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(b, first, lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def end_in(at: Column, b: Column, s: Column, words: int | None = None) -> Column:
        # where the block, or its first words, ends without the spaces after it; null of no such block
        part = F.get(b, at) if words is None else F.regexp_extract(F.get(b, at), f"^({item}{{0,{words}}})", 1)
        return F.get(s, at) + F.length(F.rtrim(part, F.lit(" \t\n\x0b\f\r")))

    def window(at: Column, b: Column, s: Column) -> Column:
        start = F.get(s, at)
        end = end_in(F.least(at + whole, F.size(b)) - 1, b, s)
        if rest:
            end = F.coalesce(end_in(at + whole, b, s, rest), end)
        return F.struct(at.alias("position"), start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("body"))

    def windows(b: Column) -> Column:
        n = (F.size(b) - 1) * stride + F.size(F.regexp_extract_all(F.element_at(b, F.lit(-1)), F.lit(r"(\S+)"), F.lit(1)))
        last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
        return F.flatten(F.transform(F.array(starts(b)), lambda s: F.transform(F.sequence(F.lit(0), last), lambda at: window(at, b, s))))

    bound = F.transform(F.filter(F.array(blocks), lambda b: F.size(b) > 0), windows)
    return F.flatten(bound)


def fixed_chunks(pages: DataFrame, settings: ChunkSettings) -> DataFrame:
    """(page_id, title, text) -> (chunk_id, page_id, position, text, start, end, kind): pages of
    one block. Null texts have no chunks, null titles count as empty. No shuffle."""
    windows = F.inline(fixed_windows(F.coalesce("text", F.lit("")), settings.size, settings.overlap))
    title = F.coalesce("title", F.lit(""))
    return pages.select("page_id", title.alias("title"), windows).select(
        chunk_id(F.col("page_id"), F.col("position")).alias("chunk_id"), "page_id", "position",
        F.concat("title", F.lit("\n"), "body").alias("text"), "start", "end", F.lit("prose").alias("kind"),
    )


def pack(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of sentences of at most ``size`` words, a longer first one alone; the next range
    takes up sentences from the end until they have ``overlap`` words, and always moves on."""
    ranges, first = [], 0
    while first < len(lengths):
        end, used = first + 1, lengths[first]
        while end < len(lengths) and (used == 0 or used + lengths[end] <= size):
            used += lengths[end]
            end += 1
        ranges.append((first, end))
        if end == len(lengths):
            break
        back, again = end, 0
        while back - 1 > first and again < overlap:
            back -= 1
            again += lengths[back]
        first = back
    return ranges


def _prose(run: list[dict], settings: ChunkSettings) -> list[tuple]:
    """Pieces of neighbouring blocks joined by blank lines, placed on the page again."""
    texts = [" ".join(v or "" for row in b["rows"] for v in row) if b["kind"] == "table" else b["text"] for b in run]
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 2
    source = "\n\n".join(texts)
    if settings.strategy == "fixed_words":
        spans = [m.span() for m in _WORD.finditer(source)]
        stride = settings.size - settings.overlap
        count = 1 + -(-max(0, len(spans) - settings.size) // stride) if spans else 0
        cuts = [(spans[k * stride][0], spans[min(k * stride + settings.size, len(spans)) - 1][1]) for k in range(count)]
    else:
        by_section = settings.strategy == "section_aware"
        cuts = []
        for _, group in groupby(range(len(run)), key=lambda i: run[i]["section"] if by_section else 0):
            group = list(group)
            low, high = starts[group[0]], starts[group[-1]] + len(texts[group[-1]])
            sentences = [(low + a, low + b) for a, b in sentence_spans(source[low:high])]
            lengths = [len(_WORD.findall(source[a:b])) for a, b in sentences]
            cuts += [(sentences[a][0], sentences[b - 1][1]) for a, b in pack(lengths, settings.size, settings.overlap)]

    def place(offset: int, first: bool) -> int:
        inside = [i for i, s in enumerate(starts) if s <= offset <= s + len(texts[i])]
        if not inside:
            return run[0]["start"] if first else run[-1]["end"]
        i = inside[0 if first else -1]
        if texts[i] == run[i]["text"]:
            return run[i]["start"] + offset - starts[i]
        return run[i]["start" if first else "end"]

    return [(source[a:b], place(a, True), place(b, False), "prose") for a, b in cuts if source[a:b].strip()]


def _table(block: dict, size: int) -> list[tuple]:
    """Pieces of whole lines of a table, at most ``size`` words unless one line has more."""
    pieces, at, used, first, last = [], 0, 0, 0, 0
    for line in block["text"].split("\n"):
        n = len(_WORD.findall(line))
        if last > first and used + n > size:
            pieces.append((first, last))
            first, used = at, 0
        last, used = at + len(line), used + n
        at = last + 1
    pieces.append((first, last))
    return [(block["text"][a:b], block["start"] + a, block["start"] + b, "table") for a, b in pieces]


def chunk_page(page_id: str, title: str, blocks: list[dict], settings: ChunkSettings) -> list[tuple]:
    """Chunks of one page of several blocks; tables stand apart from prose unless flattened."""
    pieces: list[tuple] = []
    for apart, run in groupby(blocks, key=lambda b: b["kind"] == "table" and not settings.flatten_tables):
        run = list(run)
        pieces += [p for b in run for p in _table(b, settings.size)] if apart else _prose(run, settings)
    out = []
    for position, (body, start, end, kind) in enumerate(pieces):
        home = next((b for b in blocks if b["start"] <= start and (start < b["end"] or end <= b["end"])), None)
        parts = [home["section"] if home else "", home["caption"] if home and kind == "table" else ""]
        heading = " > ".join(x for x in (title, *parts) if x) if any(parts) else title
        out.append((f"{page_id}#{position}", page_id, position, f"{heading}\n{body}", start, end, kind))
    return out


def block_chunks(pages: DataFrame, settings: ChunkSettings) -> DataFrame:
    """(page_id, title, blocks) -> chunks by any strategy, page by page in Arrow batches.

    Blocks are (kind, section, text, start, end, caption, rows). Null blocks, and blocks without
    text, give no chunk; null sections, captions and titles count as empty.
    """

    def run(batches):
        for batch in batches:
            out = []
            for page, title, blocks in zip(batch["page_id"], batch["title"], batch["blocks"]):
                known = [
                    {**b, "section": b["section"] or "", "caption": b["caption"] or "", "rows": [list(r) for r in b["rows"]] if b["rows"] is not None else []}
                    for b in (blocks if blocks is not None else []) if b is not None and b["text"]
                ]
                out += chunk_page(page, title or "", known, settings)
            yield pd.DataFrame(out, columns=["chunk_id", "page_id", "position", "text", "start", "end", "kind"])

    return pages.select("page_id", "title", "blocks").mapInPandas(
        run, "chunk_id string, page_id string, position int, text string, start int, end int, kind string"
    )
