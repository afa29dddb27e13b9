"""Encoding of a corpus with a byte-level BPE vocabulary, and decoding.

Words are encoded, not documents: the distinct words of the corpus grow far slower
than its text. A word's merges are folded by Spark's higher-order functions over the
array of its byte tokens, against the rank map held as array literals in the plan.

The map is a perfect hash of the merging pairs, since a literal MapType is searched
from end to end: pair -> bucket -> displacement -> slot, two array reads. It is bound once
as a lambda variable, so that a task's plan holds one copy. Its size follows the vocabulary.

The fold moves the rest of a word at each merge, so words of more than ``LONG`` bytes (text
without spaces) are merged by a heap in Arrow batches instead, in n log n steps.

Text is split once, where it is read: a chunk is a bounded share of a task's rows, with its
distinct words and, of each document, their numbers. Chunks then meet the ids of their own
words. So no dictionary is broadcast, no row is a word occurrence, and no text is shuffled.
"""

from __future__ import annotations

import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recallforge.llm.vocabulary import merge_pairs, rank_file, read_ranks
from recallforge.session import cut_lineage

#: Stands for "this pair does not merge"; above any id.
NO_MERGE = 1 << 30
#: Bytes of text in a chunk; a longer document is a chunk by itself.
CHUNK_BYTES = 4_000_000
#: Bytes of text that are split at once.
BLOCK_BYTES = 1_000_000
#: Words of more bytes are merged by a heap.
LONG = 64
#: Bits of an id in the packed map: three ids to a number.
_ID_BITS = 21


@lru_cache(maxsize=4)
def _perfect_hash(path: str) -> tuple[list[int], list[int]]:
    """Displacement of each bucket; pair and id of each slot, packed in one number. Buckets
    are placed from the fullest to the emptiest, each at the first displacement that leaves
    its pairs apart."""
    pairs = merge_pairs(path)
    if max(read_ranks(path).values(), default=0) >= 1 << _ID_BITS:
        raise ValueError(f"ids of {1 << _ID_BITS} and more do not fit")
    n_buckets = max(1, len(pairs) * 2 // 3)
    n_slots = _prime(max(3, len(pairs) * 13 // 5))
    buckets: dict[int, list[tuple[int, int]]] = {}
    for left, right in pairs:
        buckets.setdefault((left * 31 + right) % n_buckets, []).append((left, right))
    shift, packed = [1] * n_buckets, [-1] * n_slots
    for bucket, members in sorted(buckets.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        # every displacement below the number of slots is another map: the first rows are spread by it
        for d in range(1, n_slots):
            slots = [((left + 1) * d + right) % n_slots for left, right in members]
            if len(set(slots)) == len(slots) and all(packed[s] < 0 for s in slots):
                break
        else:
            raise ValueError("no perfect hash of this vocabulary")
        shift[bucket] = d
        for s, (left, right) in zip(slots, members, strict=True):
            packed[s] = (((left << _ID_BITS) + right) << _ID_BITS) + pairs[left, right]
    return shift, packed


def _prime(least: int) -> int:
    n = least | 1
    while any(n % i == 0 for i in range(3, int(n**0.5) + 1, 2)):
        n += 2
    return n


def _literal(values: list[int], kind: str) -> Column:
    """An array literal; the split and the cast are folded once, by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point 0 white space, 1 letter, 2 number, 3 other."""
    out = np.fromiter(({"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)), np.uint8, 0x110000)
    # The property White_Space.
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin in UTF-8 ``data``, and its end. Texts begin at ``offsets``, the last being
    the end. Words are the pieces that merges never cross, as the pattern of the vocabulary
    splits them: runs of letters, of numbers and of others with one space before them, what
    is left of white space, and English endings after an apostrophe."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return np.array([len(data)])
    lead = data[at]
    code = lead.astype(np.int32)
    for least, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero(lead >= least)
        value = code[some] & bits if more == 1 else lead[some].astype(np.int32) & bits
        for i in range(1, more + 1):
            value = value << 6 | (data[at[some] + i] & 0x3F)
        code[some] = value
    kind = _classes()[code]
    n = len(at)
    first = np.zeros(n + 1, bool)  # of a text; the end is one too
    first[np.searchsorted(at, offsets)] = True
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    begins[[0, n]] = True
    runs = np.flatnonzero(begins)
    low, high = runs[:-1], runs[1:]
    # white space before other things: its last goes with them if it is a plain space, else alone
    last = high - 1
    before = (kind[low] == 0) & ~first[high]
    begins[last[before]] = True
    begins[high[before & (code[last] == 0x20)]] = False
    # an apostrophe that begins a word and has an ending after it
    apostrophe = low[(high - low == 1) & (code[low] == 0x27) & begins[low] & ~first[high]]
    letters = np.concatenate((code, [0, 0, 0]))
    ends = np.concatenate((first, [True, True]))
    a, b = letters[apostrophe + 1], letters[apostrophe + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ~ends[apostrophe + 2] & (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l"))))
    some = apostrophe[one | two]
    begins[some + 1] = False
    begins[some + np.where(one[one | two], 2, 3)] = True
    return np.append(at, len(data))[np.flatnonzero(begins)]


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ids(word: Column, path: str) -> Column:
    """The ids of one word: its byte tokens, merged lowest rank first, leftmost among equals."""
    ranks, (shift, packed) = read_ranks(path), _perfect_hash(path)
    rank_map = F.struct(
        _literal(shift, "int").alias("shift"),
        _literal(packed, "bigint").alias("packed"),
        _literal([ranks[bytes([b])] for b in range(256)], "int").alias("of_byte"),
    )
    none = F.array().cast("array<int>")
    return _let(rank_map, lambda m: _let(F.hex(F.encode(word, "UTF-8")), lambda hexed: _fold(m, hexed, none, len(shift), len(packed))))


def _fold(m: Column, hexed: Column, none: Column, n_buckets: int, n_slots: int) -> Column:
    def merged(left: Column, right: Column) -> Column:
        """The id that a pair merges into, else NO_MERGE."""
        left, right = left.cast("bigint"), right.cast("bigint")
        slot = (((left + 1) * F.get(m["shift"], ((left * 31 + right) % n_buckets).cast("int")) + right) % n_slots).cast("int")
        return _let(
            F.get(m["packed"], slot),
            lambda v: F.when(F.shiftright(v, _ID_BITS) == left * (1 << _ID_BITS) + right, (v % (1 << _ID_BITS)).cast("int")).otherwise(F.lit(NO_MERGE)),
        )

    n_bytes = F.shiftright(F.length(hexed), 1)
    tokens = F.transform(
        F.sequence(F.lit(0), n_bytes - 1),
        lambda i: F.get(m["of_byte"], F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")),
    )

    def start(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: merged(F.get(t, i), F.get(t, i + 1)))
        return F.struct(t.alias("t"), F.when(F.size(t) > 1, pairs).otherwise(none).alias("r"))

    def step(acc: Column, low: Column) -> Column:
        t, r = acc["t"], acc["r"]

        def merge(at: Column) -> Column:
            # at is 1-based: tokens at and at + 1 become the token low
            left = F.when(at > 1, F.array(merged(F.get(t, at - 2), low))).otherwise(none)
            right = F.when(at + 1 < F.size(t), F.array(merged(low, F.get(t, at + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(t, F.lit(1), at - 1), F.array(low), F.slice(t, at + 2, F.size(t))).alias("t"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"),
            )

        return F.when(F.coalesce(low, F.lit(NO_MERGE)) < NO_MERGE, _let(F.array_position(r, low).cast("int"), merge)).otherwise(acc)

    return F.aggregate(
        F.sequence(F.lit(2), F.greatest(n_bytes, F.lit(2))),
        _let(tokens, start),
        lambda acc, _: _let(F.array_min(acc["r"]), lambda low: step(acc, low)),
        lambda acc: acc["t"],
    )


def merge_by_heap(tokens: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Merges of lowest rank first, leftmost among equals: a linked list and a heap of its pairs."""
    n = len(tokens)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    tokens = list(tokens)
    heap = [(rank, i) for i in range(n - 1) if (rank := pairs.get((tokens[i], tokens[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = right[i] if tokens[i] >= 0 else -1
        # the pair may be gone since
        if j < 0 or pairs.get((tokens[i], tokens[j])) != rank:
            continue
        tokens[i], tokens[j] = rank, -1
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
            if (more := pairs.get((rank, tokens[right[i]]))) is not None:
                heapq.heappush(heap, (more, i))
        if left[i] >= 0 and (more := pairs.get((tokens[left[i]], rank))) is not None:
            heapq.heappush(heap, (more, left[i]))
    return [t for t in tokens if t >= 0]


def encode_words(words: DataFrame, path: str | None = None) -> DataFrame:
    """(word) distinct and not empty -> (word, ids)."""
    path = path or rank_file()
    pairs, ranks = merge_pairs(path), read_ranks(path)
    of_byte = [ranks[bytes([b])] for b in range(256)]

    @F.pandas_udf("array<int>")
    def by_heap(long: pd.Series) -> pd.Series:
        return long.map(lambda w: merge_by_heap([of_byte[b] for b in w.encode()], pairs))

    size = F.octet_length("word")
    short = words.where(size <= LONG).select("word", word_ids(F.col("word"), path).alias("ids"))
    return short.unionByName(words.where(size > LONG).select("word", by_heap("word").alias("ids")))


def _bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``word_bounds`` in blocks of whole texts that fit in a cache."""
    parts, at = [np.zeros(1, np.int32)], 0
    while at < len(offsets) - 1:
        to = max(int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1, at + 1)
        low, high = offsets[at], offsets[to]
        parts.append((word_bounds(data[low:high], offsets[at : to + 1] - low)[1:] + low).astype(np.int32))
        at = to
    return np.concatenate(parts)


def _splitter(chunk_bytes: int, schema: pa.Schema):
    """Rows (row, text) -> chunks (chunk, rows, sizes, numbers, words)."""

    def chunk(number: int, rows: pa.Array, text: pa.Array) -> pa.RecordBatch:
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        bounds = _bounds(data, offsets)
        cut = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = cut.dictionary_encode()
        sizes = np.diff(np.searchsorted(bounds, offsets)).astype(np.int32)
        lists = [rows, pa.array(sizes), coded.indices, coded.dictionary]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), *columns], schema=schema)

    def run(batches):
        number, held, size = 0, [], 0
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            text = pa.concat_arrays([pc.fill_null(text, "")])
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            at = 0
            while at < len(text):
                # as many rows as the chunk still takes, at least one
                to = max(int(np.searchsorted(ends, ends[at] + chunk_bytes - size, "right")) - 1, at if held else at + 1)
                if to > at:
                    held.append((batch.column("row").slice(at, to - at), text.slice(at, to - at)))
                    size += int(ends[to] - ends[at])
                    at = to
                if at < len(text):
                    yield chunk(number, *map(pa.concat_arrays, zip(*held, strict=True)))
                    number, held, size = number + 1, [], 0
        if held:
            yield chunk(number, *map(pa.concat_arrays, zip(*held, strict=True)))

    return run


def _apply(key, chunks: pa.Table, entries: pa.Table) -> pa.Table:
    """The ids of the documents of one chunk from those of its words."""
    entries = entries.sort_by("number")
    rows, sizes, numbers = (chunks.column(c).combine_chunks().flatten() for c in ("rows", "sizes", "numbers"))
    taken = entries.column("ids").combine_chunks().take(numbers)
    per_word = pc.list_value_length(taken).to_numpy(zero_copy_only=False) if len(taken) else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(per_word)))
    offsets = ends[np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False))))]
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.flatten().cast(pa.int32()))
    return pa.table({"row": rows, "ids": out})


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(id, ids) of every row of ``df``.

    Null and empty texts have the empty list; repeated rows and null ids come out as
    often as they are there; other columns are ignored. Text that looks like a special
    token is ordinary text.
    """
    path = path or rank_file()
    rows = df.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    columns = f"chunk bigint, rows array<{kind}>, sizes array<int>, numbers array<int>, words array<string>"
    row_type = to_arrow_type(rows.schema["row"].dataType)
    schema = pa.schema([("chunk", pa.int64()), ("rows", pa.list_(row_type)), *((c, pa.list_(t)) for c, t in (("sizes", pa.int32()), ("numbers", pa.int32()), ("words", pa.string())))])
    chunks = cut_lineage(rows.mapInArrow(_splitter(chunk_bytes, schema), columns))
    vocabulary = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("number", "word"))
    coded = encode_words(vocabulary.select("word").distinct(), path)
    entries = vocabulary.join(coded, "word").select("of", "number", "ids")
    encoded = (
        chunks.select("chunk", "rows", "sizes", "numbers").groupBy("chunk").cogroup(entries.groupBy("of")).applyInArrow(_apply, f"row {kind}, ids array<int>")
    )
    return encoded.select(F.col("row.id").alias(id_col), "ids")


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the tokens' bytes, concatenated, read as UTF-8.

    An empty list gives the empty text. Inverse of encoding for every text.
    """
    ranks = read_ranks(path or rank_file())
    by_id = sorted(ranks, key=ranks.get)
    pieces = F.split(F.lit(",".join(t.hex() for t in by_id)), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")
