"""Porter stemming of English terms, with the usual extensions of the published algorithm.

Extensions: words of two letters or fewer stay; ``ies`` and ``ied`` of short words keep
their e; a y after a consonant becomes i only past the second letter; ``bli``, ``alli``,
``fulli`` and ``logi`` are endings of step two; a few irregular forms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forms that the rules would miss.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Endings and what they become, by step.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# the longest ending counts; sorted once, as millions of words are stemmed
LONGEST2, LONGEST3, LONGEST4 = (tuple(sorted(x, key=len, reverse=True)) for x in (STEP2, STEP3, STEP4))


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; or is vowel, consonant."""
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _shape(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _replace(word, STEP2, LONGEST2)
    if word.endswith("logi") and _measure(word[:-3]) > 0:
        word = word[:-1]
    word = _replace(word, STEP3, LONGEST3)
    if word.endswith(LONGEST4):
        ending = next(x for x in LONGEST4 if word.endswith(x))
        left = word[: -len(ending)]
        if _measure(left) > 1 and (ending != "ion" or left[-1:] in ("s", "t")):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short_end(left)):
            word = left
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _replace(word: str, endings: dict[str, str], longest: tuple[str, ...]) -> str:
    if not word.endswith(longest):
        return word
    ending = next(x for x in longest if word.endswith(x))
    left = word[: -len(ending)]
    return left + endings[ending] if _measure(left) > 0 else word


def stem_terms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem) of each distinct term: Python sees the vocabulary, not the text."""

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return terms.select(term_col).distinct().withColumn("stem", stemmed(term_col))
