"""Public byte-level BPE vocabularies.

A vocabulary is a rank file: one line per token with the token's bytes in base64
and its rank, which is also its id. ``TOKENIZER_DIR`` is where the files are; every
function takes another path.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the public vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that ``token`` is merged from: what is left of its bytes after all
    merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        merges = [ranks.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:])]
        low = min(merges)
        if low >= ranks[token]:
            return None
        at = merges.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def merge_pairs(path: str) -> dict[tuple[int, int], int]:
    """Each pair of tokens that merges, with the id of the token it makes.

    The id is also the rank of the merge.
    """
    ranks = read_ranks(path)
    pairs = {}
    for token, rank in ranks.items():
        if len(token) > 1 and (halves := _halves(token, ranks)):
            pairs[ranks[halves[0]], ranks[halves[1]]] = rank
    return pairs
