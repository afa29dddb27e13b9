"""Language of a short text, by naive Bayes over its words and their endings.

The model is fitted here, on texts whose language is labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts that the model is fitted on, at most, of each language; and their characters.
SAMPLE, SAMPLE_CHARS = 1_000, 400

# Units, which belong to no language.
_UNITS = {"km", "m", "cm", "kg", "ca"}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def features(text: str) -> list[str]:
    """Lower-case words but no names: a capital that doesn't open a sentence is a name's.
    Writing without capitals or spaces gives its single characters."""
    out = []
    for match in _WORD.finditer(text):
        word = match.group()
        before = text[: match.start()].rstrip()
        if word[0].isupper() and (before and before[-1] not in ".!?:¿¡…\n" or word[1:] != word[1:].lower()):
            if not word.isupper() or len(word) == 1:
                continue
        if ord(word[0]) > 0x2E80:
            out += word
            continue
        word = word.lower().replace("’", "'")
        for part in word.split("'") if word[0].isalpha() else [word]:
            if part and part not in _UNITS:
                out += [part, "…" + part[-3:]]
    return out


class LanguageModel:
    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        total = {l: sum(c.values()) + 1.0 for l, c in counts.items()}
        seen = {f for c in counts.values() for f, n in c.items() if n > 1}
        # a feature weighs as much as it tells the languages apart; unseen ones tell nothing
        self.weights = {}
        for f in seen:
            logs = [math.log((counts[l].get(f, 0) + 0.02) / total[l]) for l in self.languages]
            mean = sum(logs) / len(logs)
            self.weights[f] = [x - mean for x in logs]

    def scores(self, text: str) -> tuple[dict[str, float], int]:
        """Log-odds of each language, and the number of known words, endings not counted."""
        sums, known = [0.0] * len(self.languages), 0
        for f in features(text):
            if (w := self.weights.get(f)) is not None:
                known += f[0] != "…"
                sums = [a + b for a, b in zip(sums, w)]
        return dict(zip(self.languages, sums)), known


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on a sample of at most ``sample`` texts of each language, the beginnings of texts
    chosen by hash. Rows without text or language tell nothing."""
    rows = df.where(f"length(trim({text_col})) > 0 AND {lang_col} IS NOT NULL").select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text")
    )
    first = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    chosen = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample).select("lang", "text")
    counts: dict[str, Counter] = {}
    for lang, text in chosen.collect():
        counts.setdefault(lang, Counter()).update(features(text))
    return LanguageModel(counts)
