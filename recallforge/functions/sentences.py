"""Sentence spans by rule: a stop, its closing marks and a space before a new beginning."""

from __future__ import annotations

import re

# Abbreviations that a stop does not end a sentence after.
ABBREVIATIONS = set(
    "dr mr mrs ms prof st sr jr no nos vs etc e.g i.e approx ca cf fig vol pp ed eds inc ltd co gen col capt lt sgt rev hon gov "
    "jan feb mar apr jun jul aug sep sept oct nov dec z.b d.h bzw u.s u.k".split()
)
_END = re.compile(r"""[.!?…]+["'”’»)\]]*(?=\s)|[。！？]+[」』）]*|\n\s*\n""")
_LAST = re.compile(r"([^\s(\[“\"]+?)\.$")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Half-open spans of the sentences of ``text``, without outer spaces; none of blank text."""
    spans, start = [], 0
    for match in _END.finditer(text):
        stop = match.group()
        if stop == ".":
            word = _LAST.search(text[start : match.end()])
            name = word.group(1).lower() if word else ""
            follows = text[match.end() :].lstrip()[:1]
            if name in ABBREVIATIONS or (len(name) == 1 and name.isalpha()) or follows.islower():
                continue
        _add(spans, text, start, match.end())
        start = match.end()
    _add(spans, text, start, len(text))
    return spans


def _add(spans: list, text: str, start: int, end: int) -> None:
    piece = text[start:end]
    if piece.strip():
        left = len(piece) - len(piece.lstrip())
        spans.append((start + left, start + left + len(piece.strip())))
