"""Texts read in a wrong character encoding: finding and round-trip repair.

A run of non-ASCII characters is encoded again in the encoding it may have been read in and
decoded strictly in the one it may have been written in. The repair is accepted where a
garbling cost drops: the sum, over neighbouring characters, of how few texts have them side
by side. Repairs repeat for nested readings.

The cost is counted over all whole texts, but for what UTF-8 read as something else may have
left; texts that a first model finds garbled do not take part in the second. The rarity of
neighbours only opens the single-byte readings: UTF-8 is tried on every run of its pattern.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.session import cut_lineage

#: All texts of a language together count for so many at most: rare languages stay known, and
#: costs do not depend on how many texts there are.
WEIGHT = 1_000
#: Neighbours are rare if they cost more than this, or if fewer other texts have them.
RARE, FEW = 8.0, 3
#: Drop of the cost that one repair must bring, and all repairs of a text by one pair of
#: encodings; a single repaired run must bring more.
LEAST, TOGETHER, ALONE = 2.0, 9.0, 6.0
#: Extra cost of neighbours that are common in another case only: of a capital after a small
#: letter, and of a small letter after a capital.
CAPITAL_AFTER, CAPITAL_BEFORE = 2.0, 1.0
#: Characters of text that are scanned at once; entries of each memo, and characters of their keys.
SCAN, MEMO, MEMO_KEY = 1 << 20, 100_000, 64

# Encodings that texts are read in by mistake, and those they are written in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "iso8859-15", "cp775", "cp852"]
WRITTEN_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp1253", "iso8859-7", "cp852"]
MULTIBYTE = ["cp932", "euc_jp"]

_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile("[\x80-\x84\x86-\x9f�]")
# Characters that stand by themselves in running text.
_LONE = set("–—°àÀéÉêèáíÁ“”‘’€")
# Punctuation beyond ASCII.
_MARKING = set("¿¡“”‘’„«»‹›–—…·")
# What the commonest reading has for the bytes 80 to 9f; nested readings pass by it.
_BETWEEN = set("€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")
# Byte order marks read as text.
_MARKS = ("ÿþ", "þÿ", "ï»¿")
_SENTENCE_END = re.compile(r"[.!?。…]\s|\n")
# What a reading in a single-byte encoding leaves of punctuation and letters
# when the bytes 80 to 9f are dropped afterwards.
_DROPPED = {"â": "’“”–—‘…€", "Ã": "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞß", "Ä": "ćęąČčĆĘĄ", "Å": "łńśŁŃœŚ"}


@lru_cache(maxsize=64)
def _table(name: str) -> dict[str, int]:
    """Byte of each character; undefined bytes stand for the controls of that number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=64)
def _letters(name: str) -> str:
    """Character of each byte; unassigned bytes give U+FFFF."""
    return "".join(bytes([b]).decode(name, "replace").replace("�", "￿") for b in range(256))


def encode(text: str, name: str) -> bytes | None:
    table = _table(name)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=1)
def _pairs() -> list[tuple[str, str, dict[int, str]]]:
    """(read as, written as, what each character was) of single-byte encodings; pairs that
    say the same are kept once."""
    out, seen = [], set()
    for read in READ_AS:
        for written in WRITTEN_AS:
            if read == written:
                continue
            letters = _letters(written)
            moves = {ord(c): letters[b] for c, b in _table(read).items() if b > 127 and letters[b] != c and letters[b] != "￿"}
            key = tuple(sorted(moves.items()))
            if moves and key not in seen:
                seen.add(key)
                out.append((read, written, moves))
    return out


def _utf8_pattern(name: str) -> re.Pattern:
    letters = {b: c for c, b in _table(name).items()}

    def some(lo: int, hi: int) -> str:
        return "".join(re.escape(letters[b]) for b in range(lo, hi + 1))

    tail = f"[{some(0x80, 0xBF)}]"
    return re.compile(f"(?:[{some(0xC2, 0xDF)}]{tail}|[{some(0xE0, 0xEF)}]{tail}{{2}}|[{some(0xF0, 0xF4)}]{tail}{{3}})+")


@lru_cache(maxsize=1)
def _utf8_patterns() -> list[tuple[str, re.Pattern]]:
    return [(name, _utf8_pattern(name)) for name in READ_AS]


@lru_cache(maxsize=1)
def _bits() -> tuple[dict[str, int], dict[str, int]]:
    """Encodings, as bits in the order of READ_AS, in which a character is the first byte of a UTF-8
    sequence, and in which it is a later one."""
    first: dict[str, int] = {}
    later: dict[str, int] = {}
    for i, name in enumerate(READ_AS):
        for c, b in _table(name).items():
            if 0xC2 <= b <= 0xF4:
                first[c] = first.get(c, 0) | 1 << i
            elif 0x80 <= b <= 0xBF:
                later[c] = later.get(c, 0) | 1 << i
    return first, later


def _may_be_utf8(run: str) -> int:
    """Encodings, as bits, in which the run may hold UTF-8 read as something else."""
    first, later = _bits()
    found = 0
    for a, b in zip(run, run[1:]):
        if a in first:
            found |= first[a] & later.get(b, 0)
    return found


@lru_cache(maxsize=1)
def _bit_tables() -> tuple[np.ndarray, np.ndarray]:
    """``_bits`` by code point, the last entry for all beyond."""
    out = []
    for bits in _bits():
        table = np.zeros(0x10001, np.uint16)
        for c, x in bits.items():
            table[ord(c)] = x
        out.append(table)
    return out[0], out[1]


class Scan:
    """Texts as one array of code points, each followed by a null, and their runs beyond ASCII."""

    def __init__(self, texts: list[str]):
        self.code = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        high = self.code > 127
        edges = np.flatnonzero(np.diff(high, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.number = np.searchsorted(self.offsets, self.starts, "right") - 1
        # neighbours, at least one beyond ASCII, of which neither parts two texts
        at = np.flatnonzero(high[1:] | high[:-1])
        parted = np.zeros(len(self.code), bool)
        parted[self.offsets[1:] - 1] = True
        self.at = at[~(parted[at] | parted[at + 1])]
        self.keys = self.code[self.at].astype(np.uint64) << np.uint64(32) | self.code[self.at + 1]

    def any_in_runs(self, flags: np.ndarray) -> np.ndarray:
        """Of each run whether a flag of ``at`` lies in it or at its edges."""
        total = np.concatenate(([0], np.cumsum(flags)))
        low, high = np.searchsorted(self.at, self.starts - 1), np.searchsorted(self.at, self.ends)
        return total[high] > total[low]

    def utf8(self) -> np.ndarray:
        """Neighbours that may begin a UTF-8 sequence in some encoding."""
        first, later = _bit_tables()
        code = np.minimum(self.code, 0x10000)
        return (first[code[self.at]] & later[code[self.at + 1]]) != 0


def scans(texts: list[str]):
    """(number of the first text, Scan) of as many texts at once as have ``SCAN`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SCAN:
            yield first, Scan(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, Scan(texts[first:])


class Memo(dict):
    """Results by key; emptied when it is full, and without long keys, so that it stays bounded."""

    def of(self, key: tuple, make):
        found = self.get(key)
        if found is None:
            found = make(*key)
            if sum(map(len, key)) <= MEMO_KEY:
                if len(self) >= MEMO:
                    self.clear()
                self[key] = found
        return found


def _unsuspected(run: str, chars: set[str]) -> str:
    """The run with nulls for what UTF-8 of known ``chars`` read as something else may have left;
    words in lower case are none."""
    may = _may_be_utf8(run)
    out = list(run)
    for i, (name, pattern) in enumerate(_utf8_patterns()):
        for m in pattern.finditer(run) if may >> i & 1 else ():
            try:
                new = encode(m.group(), name).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not (m.group().isalpha() and m.group().islower()) and all(c in chars or "\u00a0" <= c <= "\u017f" or c > "\U0001f000" for c in new):
                out[m.start() : m.end()] = "\0" * len(m.group())
    return "".join(out)


@lru_cache(maxsize=100_000)
def kind_of(c: str) -> str:
    """Script and category of a character, roughly: what it may stand beside."""
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
    if not c.isalpha():
        return c
    script = unicodedata.name(c, "?").split()[0]
    return script + ("" if script in ("CJK", "HIRAGANA", "KATAKANA") else "l" if c.islower() else "u")


class GarblingCost:
    """Cost of neighbouring characters: minus the log of the share of texts that have them.

    Unseen neighbours cost what the same letters do in another case, more where cases
    meet, or what their kinds and their own shares tell, whichever is less.
    """

    def __init__(self, texts: int, pairs: dict[str, int], kinds: dict[tuple[str, str], int], singles: dict[str, int]):
        self.texts, self.pairs, self.kinds, self.singles = texts + 1, pairs, kinds, singles
        # of few texts, the judged one and FEW of its like are a large share
        self.rare = min(RARE, math.log(self.texts / FEW))
        self.of_kind: dict[str, int] = {}
        for c, n in singles.items():
            self.of_kind[kind_of(c)] = self.of_kind.get(kind_of(c), 0) + n
        self.costs: dict[str, float] = {}
        self.utf8_memo, self.single_memo = Memo(), Memo()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"} | {"costs": {}, "utf8_memo": Memo(), "single_memo": Memo()}

    def _cost(self, pair: str) -> float:
        if pair.isascii():
            return 0.0
        a, b = pair
        ka, kb = kind_of(a), kind_of(b)
        apart = self.kinds.get((ka, kb), 0) * self.singles.get(a, 0) / self.of_kind.get(ka, 1) * self.singles.get(b, 0) / self.of_kind.get(kb, 1)
        least = max(self.pairs.get(pair, 0), apart)
        cost = -math.log((least + 0.02) / self.texts)
        if (folded := pair.lower()) != pair and len(folded) == 2:
            cost = min(cost, (self.costs.get(folded) or self._cost(folded)) + (CAPITAL_AFTER if a.islower() and b.isupper() else CAPITAL_BEFORE if a.isupper() and b.islower() else 0.0))
        if len(self.costs) >= MEMO:
            self.costs.clear()
        self.costs[pair] = cost
        return cost

    @cached_property
    def tables(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Number of each character of ASCII and the single-byte encodings; what each pair of
        encodings makes of it; costs of all their neighbours."""
        chars = {chr(i) for i in range(128)}
        for _, _, moves in _pairs():
            chars |= {*map(chr, moves), *moves.values()}
        chars |= {c.lower() for c in chars if len(c.lower()) == 1}
        letters = sorted(chars)
        number = {c: i for i, c in enumerate(letters)}
        made = np.array([[number[moves.get(ord(c), c)] for c in letters] for _, _, moves in _pairs()], np.int32)
        kinds = sorted({kind_of(c) for c in letters})
        kind = {k: i for i, k in enumerate(kinds)}
        of = np.array([kind[kind_of(c)] for c in letters])
        share = np.array([self.singles.get(c, 0) / self.of_kind.get(kind_of(c), 1) for c in letters])
        least = np.zeros((len(kinds), len(kinds)))
        for (a, b), n in self.kinds.items():
            if a in kind and b in kind:
                least[kind[a], kind[b]] = n
        least = least[of[:, None], of[None]] * share[:, None] * share[None]
        for pair, n in self.pairs.items():
            if pair[0] in number and pair[1] in number:
                at = number[pair[0]], number[pair[1]]
                least[at] = max(least[at], n)
        cost = -np.log((least + 0.02) / self.texts)
        cost[:128, :128] = 0.0
        lower = np.array([number[c.lower()] if len(c.lower()) == 1 else i for i, c in enumerate(letters)])
        cased = lower != np.arange(len(letters))
        small, capital = (np.array([f(c) for c in letters]) for f in (str.islower, str.isupper))
        folded = cost[lower[:, None], lower[None]] + CAPITAL_AFTER * (small[:, None] & capital[None]) + CAPITAL_BEFORE * (capital[:, None] & small[None])
        cost = np.where(cased[:, None] | cased[None], np.minimum(cost, folded), cost)
        cost[:128, :128] = 0.0
        return number, made, cost

    def of(self, text: str) -> float:
        costs = self.costs
        return sum(costs.get(p) or self._cost(p) for p in map("".join, zip(text, text[1:])))

    def worst(self, text: str) -> float:
        costs = self.costs
        return max((costs.get(p) or self._cost(p) for p in map("".join, zip(text, text[1:]))), default=0.0)

    def known(self, text: str) -> bool:
        return all(c in self.singles or c.lower() in self.singles or "\x80" <= c <= "\u024f" or c in _BETWEEN or c > "\U0001f000" for c in text)

    def usual(self, c: str) -> bool:
        """A Latin letter that many texts have: one rare place of it is no trace."""
        return kind_of(c).startswith("LATIN") and self.singles.get(c, 0) > 0.02 * self.texts

    def screen(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text the runs that a wrong reading may have left: those with rare neighbours and
        those that, however common, are UTF-8 read as something else."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for first, scan in scans(texts):
            known, where = np.unique(scan.keys, return_inverse=True)
            pairs = (chr(k >> 32) + chr(k & 0xFFFFFFFF) for k in known.tolist())
            costs = np.fromiter((self.costs.get(p) or self._cost(p) for p in pairs), float, len(known))
            rare = scan.any_in_runs(costs[where] >= self.rare)
            some = np.flatnonzero(rare | scan.any_in_runs(scan.utf8()))
            for i, a, b, sure in zip((scan.number[some] + first).tolist(), scan.starts[some].tolist(), scan.ends[some].tolist(), rare[some].tolist()):
                text, base = texts[i], int(scan.offsets[i - first])
                a, b = a - base, b - base
                if sure or self.utf8_options(text[max(a - 1, 0) : a], text[a:b], text[b : b + 1]):
                    out[i].append((a, b))
        return out

    def odd_runs(self, text: str) -> list[tuple[int, int]]:
        return self.screen([text])[0]

    def _settled(self, before: str, text: str, after: str) -> float:
        """Cost of the text in its place, after all further layers of UTF-8 are undone. A layer
        makes the text shorter, so there is an end."""
        cost, tried = self.of(before + text + after), set()
        may = _may_be_utf8(text)
        for i, (name, pattern) in enumerate(_utf8_patterns()) if may else ():
            if may >> i & 1:
                try:
                    new = pattern.sub(lambda m, name=name: encode(m.group(), name).decode("utf-8"), text)
                except UnicodeDecodeError:
                    continue
                if new != text and new not in tried and self.known(new):
                    tried.add(new)
                    cost = min(cost, self._settled(before, new, after))
        return cost

    def utf8_options(self, left: str, run: str, right: str) -> list[tuple[str, float, list]]:
        """(read as, gain, repaired spans of the run) for UTF-8 read as something else, also
        where letters changed their case afterwards."""
        return self.utf8_memo.of((left, run, right), self._utf8_options)

    def _utf8_options(self, left: str, run: str, right: str) -> list[tuple[str, float, list]]:
        variants = [(v, may) for v in dict.fromkeys((run, run.upper(), run.lower())) if len(v) == len(run) and (may := _may_be_utf8(v))]
        out = []
        for i, (name, pattern) in enumerate(_utf8_patterns()) if variants else ():
            best, most = [], 0.0
            for variant, may in variants:
                spans, gain = [], 0.0
                for m in pattern.finditer(variant) if may >> i & 1 else ():
                    a, b = m.span()
                    try:
                        new = encode(m.group(), name).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if variant != run and run[a:b].islower():
                        new = new.lower()
                    before, after = (run[:a] or left)[-1:], (run[b:] or right)[:1]
                    g = self.of(before + run[a:b] + after) - self._settled(before, new, after)
                    if self.known(new) and g > (LEAST if variant == run else ALONE):
                        spans.append((a, b, new))
                        gain += g
                if gain > most:
                    best, most = spans, gain
            if best:
                out.append((name, most, best))
        return out

    def single_options(self, left: str, run: str, right: str) -> list[tuple[int, float, str]]:
        """(pair, gain, repaired) of the single-byte pairs that make the run common."""
        return self.single_memo.of((left, run, right), self._single_options)

    def _single_options(self, left: str, run: str, right: str) -> list[tuple[int, float, str]]:
        number, made, cost = self.tables
        if not any(c in number for c in run):
            return []
        before, out = self.of(left + run + right), []
        if all(c in number for c in run):
            # all pairs of encodings at once
            now = np.array([number[c] for c in run])
            new = made[:, now]
            edges = [np.full((len(new), 1), number[c]) if c else np.empty((len(new), 0), int) for c in (left, right)]
            whole = np.hstack((edges[0], new, edges[1]))
            costs = cost[whole[:, :-1], whole[:, 1:]] if whole.shape[1] > 1 else np.zeros((len(new), 1))
            gain = before - costs.sum(axis=1)
            for i in np.flatnonzero((gain > LEAST) & (costs.max(axis=1) < RARE) & (new != now).any(axis=1)).tolist():
                out.append((i, float(gain[i]), run.translate(_pairs()[i][2])))
            return out
        for i, (_, _, moves) in enumerate(_pairs()):
            new = run.translate(moves)
            if new != run:
                gain = before - self.of(left + new + right)
                if gain > LEAST and self.worst(left + new + right) < RARE:
                    out.append((i, gain, new))
        return out

    def _best(self, text: str, runs: list[tuple[int, int]], options) -> tuple[float, list[tuple[float, int, int, str]]]:
        return self._best_reading(text, runs, options)[1:]

    def _best_reading(self, text: str, runs: list[tuple[int, int]], options) -> tuple:
        """The reading whose repairs bring most, over all runs: it, the sum and the repairs."""
        readings: dict = {}
        for a, b in runs:
            for reading, gain, new in options(text[max(a - 1, 0) : a], text[a:b], text[b : b + 1]):
                spans = [(a + x, a + y, n) for x, y, n in new] if isinstance(new, list) else [(a, b, new)]
                spans = [s for s in spans if not _cited(text, *s)]
                if spans:
                    readings.setdefault(reading, []).append((gain, spans))
        if not readings:
            return None, 0.0, []
        best = max(readings, key=lambda r: sum(g for g, _ in readings[r]))
        return best, sum(g for g, _ in readings[best]), [(g, *s) for g, spans in readings[best] for s in spans]

    def _mentions(self, text: str, a: int, b: int) -> bool:
        """Whether the run holds a garbled sequence that the sentence cites."""
        options = self.utf8_options(text[max(a - 1, 0) : a], text[a:b], text[b : b + 1])
        return any(_cited(text, a + x, a + y, new) for _, _, spans in options for x, y, new in spans)

    def best_layer(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, bool]:
        """The reading that brings most. Where UTF-8 explains all odd runs completely, single-byte
        encodings need not be tried."""
        gain, repairs = self._best(text, runs, self.utf8_options)
        explained = {i for _, a, b, _ in repairs for i in range(a, b)}
        if repairs and all(i in explained for a, b in runs for i in range(a, b)):
            return _replace(text, repairs), True
        other, more = self.single_byte(text, runs)
        if more > gain:
            return other, True
        return _replace(text, repairs), gain > 0

    def utf8(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, float]:
        """One layer of UTF-8 read as something else undone, and what that brings."""
        gain, repairs = self._best(text, runs, self.utf8_options)
        return _replace(text, repairs), gain

    def single_byte(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, float]:
        """One layer of a single-byte encoding read as another undone, and what that brings.

        Once a pair of encodings is sure, it holds for every run that it makes more common.
        """
        pair, gain, repairs = self._best_reading(text, [r for r in runs if not _lone_symbol(text, *r)], self.single_options)
        repairs = [r for r in repairs if not _stands_alone(text, r[1], r[2]) or r[3] in _LONE]
        # odd spaces and the marks of other languages are no trace by themselves
        gain = sum(r[0] for r in repairs if not all(c.isspace() or c in _MARKING for c in text[r[1] : r[2]]))
        usual = all(self.usual(c) for r in repairs for c in text[r[1] : r[2]])
        if gain < TOGETHER and not (len(repairs) == 1 and gain >= ALONE) or (len(repairs) == 1 and usual):
            return text, 0.0
        moves, sure = _pairs()[pair][2], {r[1] for r in repairs}
        for m in _RUN.finditer(text):
            if m.start() not in sure and not _stands_alone(text, *m.span()):
                left, right = text[max(m.start() - 1, 0) : m.start()], text[m.end() : m.end() + 1]
                new = m.group().translate(moves)
                if "\uffff" not in new and (more := self.of(left + m.group() + right) - self.of(left + new + right)) > 0:
                    repairs.append((more, *m.span(), new))
        return _replace(text, sorted(repairs, key=lambda r: r[1])), gain

    def multibyte(self, text: str) -> tuple[str, bool]:
        """Lines of Japanese read in a single-byte encoding, which have few ASCII letters."""
        done, lines = False, text.split("\n")
        for i, line in enumerate(lines):
            high = len(line) - len(line.encode("ascii", "ignore"))
            if high < 4 or high * 3 < len(line) or all(kind_of(c) in ("CJK", "HIRAGANA", "KATAKANA") for c in line if c.isalpha() and c > "\x7f"):
                continue
            best, cost = None, self.of(line) - TOGETHER
            for name in READ_AS:
                raw = encode(line, name) if high else None
                for written in MULTIBYTE if raw else ():
                    try:
                        new = raw.decode(written)
                    except UnicodeDecodeError:
                        continue
                    if self.known(new) and (now := self.of(new)) < cost:
                        best, cost = new, now
            if best is not None:
                lines[i], done = best, True
        return "\n".join(lines), done

    def dropped(self, text: str, runs: list[tuple[int, int]]) -> tuple[str, bool]:
        """Letters left of UTF-8 whose control bytes were dropped."""
        repairs = []
        for a, b in runs:
            if b - a == 1 and text[a] in _DROPPED:
                left, right = text[max(a - 1, 0) : a], text[b : b + 1]
                new = min(_DROPPED[text[a]], key=lambda c: self.of(left + c + right))
                gain = self.of(left + text[a] + right) - self.of(left + new + right)
                if gain >= LEAST and self.worst(left + new + right) < RARE and not _cited(text, a, b, new):
                    repairs.append((gain, a, b, new))
        if sum(g for g, *_ in repairs) < TOGETHER:
            return text, False
        return _replace(text, repairs), True

    def repair(self, text: str, whole: bool = True, runs: list[tuple[int, int]] | None = None) -> tuple[bool, str]:
        """Whether the text shows traces of a wrong reading, and what could be restored: unless
        ``whole``, by the first layer at most. ``runs`` are its odd runs where they are known.

        Layers are undone until none is left that lowers the cost."""
        found = bool(_CONTROL.search(text))
        if found and not whole:
            return found, text
        if text.startswith(_MARKS):
            found, text, runs = True, text[next(len(m) for m in _MARKS if text.startswith(m)) :], None
        seen: set[str] = set()
        while text not in seen:
            layer = len(seen)
            seen.add(text)
            runs = [r for r in (self.odd_runs(text) if runs is None else runs) if not self._mentions(text, *r)]
            if not runs and not (found and layer):
                break
            text, again = self.multibyte(text)
            if not again and found and layer:
                text, gain = self.utf8(text, [m.span() for m in _RUN.finditer(text) if m.end() - m.start() > 1])
                again = gain > 0
            if not again:
                text, again = self.best_layer(text, runs)
            if not again:
                text, again = self.dropped(text, runs)
            found |= again
            runs = None
            if not again or not whole:
                break
        return found, text

    def repair_all(self, texts: list[str], whole: bool = True) -> list[tuple[bool, str]]:
        """``repair`` of each text. Most have no odd run and are done with after one scan of all."""
        screened = self.screen(texts)
        return [self.repair(t, whole, runs) if runs or _CONTROL.search(t) or t.startswith(_MARKS) else (False, t) for t, runs in zip(texts, screened, strict=True)]


def _replace(text: str, repairs: list[tuple[float, int, int, str]]) -> str:
    out, at = [], 0
    for _, a, b, new in repairs:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def _stands_alone(text: str, a: int, b: int) -> bool:
    return b - a == 1 and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def _lone_symbol(text: str, a: int, b: int) -> bool:
    """A symbol that stands by itself and nowhere else in the text: its own meaning is likelier."""
    return _stands_alone(text, a, b) and not text[a].isalpha() and text.count(text[a]) == 1


@lru_cache(maxsize=64)
def _sentences(text: str) -> list[int]:
    """Where the sentences of the text end."""
    return [m.end() for m in _SENTENCE_END.finditer(text)]


def _cited(text: str, a: int, b: int, new: str) -> bool:
    """Whether the characters stand by themselves in a sentence that also has, by itself, what
    they would be repaired to, and is plain otherwise: a text about garbling."""
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()) or not (bare := new.strip()) or bare not in text:
        return False
    ends = _sentences(text)
    at = bisect_left(ends, a + 1)
    low = ends[at - 1] if at else 0
    later = bisect_left(ends, b + 1)
    high = ends[later] if later < len(ends) else len(text)
    rest = text[low:a] + " \0 " + text[b:high]
    if not re.search(rf"(?<!\w){re.escape(bare)}(?!\w)", rest):
        return False
    return all(c in new or c in "“”‘’–—«»" for c in rest if c > "\x7f")


def _count(texts: list[str], chars: set[str]) -> Counter:
    """How many texts there are, and how many have each character, pair and pair of kinds, by
    (what, key), but for what UTF-8 read as something else may have left. Pairs of ASCII
    characters, which no reading changes, are not counted."""
    found: Counter = Counter({("texts", ""): len(texts)}) if texts else Counter()
    memo = Memo()

    def add(what: str, keys: np.ndarray, name) -> None:
        # keys are distinct in a text, whose number stands in front
        for k, n in zip(*(x.tolist() for x in np.unique(keys & np.uint64((1 << 42) - 1), return_counts=True))):
            found[what, name(k)] += n

    for _, scan in scans(texts):
        texts_at = np.searchsorted(scan.offsets, np.arange(len(scan.code)), "right") - 1
        hidden = np.zeros(len(scan.code), bool)
        for i in np.flatnonzero(scan.any_in_runs(scan.utf8())).tolist():
            a, b = int(scan.starts[i]), int(scan.ends[i])
            run = scan.code[a:b].tobytes().decode("utf-32-le", "surrogatepass")
            hidden[a:b] = np.fromiter((c == "\0" for c in memo.of((run,), lambda run: _unsuspected(run, chars))), bool, b - a)
        at = scan.at[~(hidden[scan.at] | hidden[scan.at + 1])]
        a, b, number = (x.astype(np.uint64) for x in (scan.code[at], scan.code[at + 1], texts_at[at]))
        pairs = np.unique(number << np.uint64(42) | a << np.uint64(21) | b)
        add("pair", pairs, lambda k: chr(k >> 21) + chr(k & 0x1FFFFF))
        # kinds of each distinct pair, numbered
        distinct, where = np.unique(pairs & np.uint64((1 << 42) - 1), return_inverse=True)
        kinds = [f"{kind_of(chr(k >> 21))}\0{kind_of(chr(k & 0x1FFFFF))}" for k in distinct.tolist()]
        names = sorted(set(kinds))
        of = {k: i for i, k in enumerate(names)}
        coded = np.fromiter((of[k] for k in kinds), np.uint64, len(kinds))
        add("kinds", np.unique((pairs >> np.uint64(42)) << np.uint64(42) | coded[where]), names.__getitem__)
        shown = np.flatnonzero(~hidden)
        there = scan.code[shown] < 128
        plain = np.zeros((len(scan.offsets) - 1, 128), np.int64)
        plain[texts_at[shown[there]], scan.code[shown[there]]] = 1
        for c, n in enumerate(plain.sum(axis=0).tolist()):
            if c and n:
                found["single", chr(c)] += n
        other = shown[~there]
        add("single", np.unique(texts_at[other].astype(np.uint64) << np.uint64(42) | scan.code[other]), chr)
    return found


def _cost_of(counted: dict[tuple[str, str], tuple[int, float]]) -> GarblingCost:
    """The model of (texts, their weight) by (what, key)."""
    of = {what: {k: (n, weight) for (w, k), (n, weight) in counted.items() if w == what and n > 0} for what in ("texts", "pair", "kinds", "single")}
    return GarblingCost(
        sum(weight for _, weight in of["texts"].values()),
        {k: weight for k, (_, weight) in of["pair"].items()},
        {tuple(k.split("\0")): weight for k, (_, weight) in of["kinds"].items()},
        {k: weight for k, (_, weight) in of["single"].items()},
    )


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> GarblingCost:
    """Fit on all distinct texts, whole. The tables that are collected are as large as the
    alphabet in use lets them be."""
    rows = df.where(f"length({text_col}) > 0").select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))

    def letters(batches):
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for _, scan in scans(batch["text"].tolist()):
                seen[scan.code] = True
        yield pd.DataFrame({"c": [chr(c) for c in np.flatnonzero(seen).tolist() if not 0xD800 <= c < 0xE000]}, dtype=object)

    chars = {r.c for r in rows.select("text").mapInPandas(letters, "c string").distinct().collect()}
    texts = cut_lineage(rows.distinct())
    weights = {r.lang: min(1.0, WEIGHT / r["count"]) for r in texts.groupBy("lang").count().collect()}

    def counts(model: GarblingCost | None) -> dict:
        def run(batches):
            found: dict[str, Counter] = {}
            for batch in batches:
                for lang, group in batch.groupby("lang"):
                    some = group["text"].tolist()
                    if model is not None:
                        some = [t for t, (wrong, _) in zip(some, model.repair_all(some, whole=False), strict=True) if wrong]
                    found.setdefault(lang, Counter()).update(_count(some, chars))
            for lang, counted in found.items():
                yield pd.DataFrame([(*key, n, n * weights[lang]) for key, n in counted.items()], columns=["what", "key", "n", "weight"])

        kept = texts.mapInPandas(run, "what string, key string, n bigint, weight double").groupBy("what", "key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
        return {(r.what, r.key): (r.n, r.weight) for r in kept.collect()}

    every = counts(None)
    for key, (n, weight) in counts(_cost_of(every)).items():
        every[key] = every[key][0] - n, every[key][1] - weight
    return _cost_of(every)


def find_garbled(df: DataFrame, cost: GarblingCost, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of each text with traces of a wrong reading, the text as far as restored.

    Null, empty and pure ASCII texts have none. Text that was lost (replacement characters)
    stays as it is. Repeated rows come out as often as they are there; other columns are
    ignored. One pass, no shuffle.
    """

    def run(batches):
        for batch in batches:
            found = cost.repair_all(batch["text"].tolist())
            keep = [f for f, _ in found]
            yield pd.DataFrame({"id": batch["id"][keep], "text": pd.Series([t for f, t in found if f], batch.index[keep], object)})

    rows = df.where(F.col(text_col).rlike(r"[^\x00-\x7f]")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
