"""Defects of prompt and response pairs.

Copies: the response's word shingles lie in the prompt's and the prompt is a common
subsequence of the response. Refusals: a sentence aligns with a refusal template by longest
common subsequence. Breaks and languages need the response alone, and the prompt's language.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm.language import LanguageModel

#: A copy: share of the response's shingles in the prompt; share of the prompt in the response.
COPY_CONTAINED, COPY_COVERED = 0.8, 0.8
#: A refusal: share of a template found in a sentence, in order; share of the sentence explained.
REFUSAL_COVERED, REFUSAL_EXPLAINED = 0.8, 0.6
#: Another language: log-odds by which it must beat the prompt's.
LANGUAGE_ODDS = 4.0

# Openings of refusals, and refusals; * stands for any words.
OPENINGS = """
sorry | i am sorry | i'm sorry | unfortunately | i'm afraid | i am afraid | i apologise | i apologize | but | regrettably | apologies
leider | es tut mir leid | tut mir leid | entschuldigung | bedauerlicherweise | désolé | je suis désolé | je regrette | malheureusement | hélas
lo siento | por desgracia | lamentablemente | desafortunadamente | desculpe | sinto muito | infelizmente | przykro mi | niestety | przepraszam
извините | к сожалению | простите | mi dispiace | purtroppo
"""
REFUSALS = """
i don't know
i do not know *
i don't know the answer
i don't have *  information *
i do not have access to *
i do not have * information *
i have no information *
i am not sure
i'm not sure
i am unable to help *
i am unable to answer *
i'm unable to *
i am not able to *
as an assistant i am not able to comment on *
as an ai i cannot *
i can't answer *
i cannot answer *
i can't help *
i cannot help *
i cannot determine this *
i can't determine *
i cannot say *
i can't say *
i must decline to answer *
i won't answer *
i won't guess *
i would rather not answer *
i refuse to answer *
there is not enough information *
there isn't enough information *
not enough information *
there is no information *
no answer to this is found *
no answer *  found
none of the * passages mentions *
none of the * passages answer *
the passages do not contain *
the passages don't contain *
the passages do not mention *
the passages do not say *
the provided context says nothing about it
the provided context does not *
the context does not *
the text does not *
the question cannot be answered *
it isn't possible to answer *
it is not possible to answer *
it is not possible to say *
this cannot be answered *
ich weiß es nicht
ich weiss es nicht
das weiß ich nicht
dazu kann ich nichts sagen
dazu kann ich keine *
das kann ich nicht *
ich kann diese frage nicht *
ich kann das nicht *
ich kann dazu nichts sagen
das lässt sich aus dem text nicht bestimmen
das lässt sich * nicht *
die abschnitte enthalten keine antwort
die passagen enthalten keine *
der text enthält keine *
dazu liegen keine informationen *
je ne sais pas *
je ne peux pas répondre *
je ne suis pas en mesure de *
je n'ai pas * information *
les passages ne contiennent pas *
le texte ne permet pas de le dire
le texte ne permet pas *
le texte ne contient pas *
il n'est pas possible de *
no lo sé
no sé *
no puedo responder *
no puedo contestar *
no puedo ayudar *
no tengo información *
no dispongo de información *
los pasajes no contienen *
el texto no permite saberlo
el texto no permite *
el texto no contiene *
no es posible *
não sei
não sei responder *
não posso responder *
as passagens não contêm *
o texto não permite *
nie wiem
nie mogę odpowiedzieć *
fragmenty nie zawierają odpowiedzi
nie da się tego określić *
я не знаю
не знаю
я не могу ответить *
отрывки не содержат ответа
в тексте нет ответа
из текста это не ясно
"""

# Labels before a question or an answer, and words that stand for no answer.
_LABEL = re.compile(r"\s*(?:q|a|question|answer|frage|antwort|réponse|pregunta|respuesta)\s*:", re.I)
_NOTHING = {"n/a", "na", "none", "null", "nan", "nil", "tbd"}
_CITATION = re.compile(r"\[\s*\d*\s*\]|\((?:passages?|abschnitt|pasaje|source)\s*\d+\)", re.I)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"|‘[^’]{8,}’")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+|(?<=\w):\s")
_COMPLETE = ".!?…。！？"
_CLOSING = "\"'”’»)]）」"


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.replace("’", "'").lower())


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    masks: dict[str, int] = {}
    row = full = (1 << len(b)) - 1
    for x in a:
        if x in places:
            if x not in masks:
                bits = bytearray(len(b) // 8 + 1)
                for j in places[x]:
                    bits[j >> 3] |= 1 << (j & 7)
                masks[x] = int.from_bytes(bits, "little")
            met = row & masks[x]
            row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


class RefusalTemplates:
    def __init__(self, refusals: str = REFUSALS, openings: str = OPENINGS):
        self.openings = sorted((tokens(x) for line in openings.split("\n") for x in line.split("|") if x.strip()), key=len, reverse=True)
        self.templates = []
        for line in refusals.strip().split("\n"):
            words = [t for part in line.split("*") for t in tokens(part)]
            self.templates.append((words, "*" in line))
        self.by_word: dict[str, set[int]] = {}
        for i, (words, _) in enumerate(self.templates):
            for w in words:
                self.by_word.setdefault(w, set()).add(i)

    def refuses(self, sentence: list[str], known: set[str]) -> bool:
        """Whether a template covers the sentence. ``known`` are words of the prompt, which
        the sentence may cite."""
        opened = True
        while opened and sentence:
            opened = next((o for o in self.openings if sentence[: len(o)] == o), None)
            sentence = sentence[len(opened) :] if opened else sentence
        hits: dict[int, int] = {}
        for w in set(sentence):
            for i in self.by_word.get(w, ()):
                hits[i] = hits.get(i, 0) + 1
        for i, n in hits.items():
            words, open_end = self.templates[i]
            if n < REFUSAL_COVERED * len(set(words)):
                continue
            if common(words, sentence[: len(words) + 4 if open_end else None]) < REFUSAL_COVERED * len(words):
                continue
            # what the template does not explain must be few words, the open end apart
            rest = sum(w not in known for w in sentence) - len(words)
            if rest <= (1 - REFUSAL_EXPLAINED) * len(sentence) or (open_end and rest <= 6 and words[:2] == sentence[:2]):
                return True
        return False


def is_empty(text: str) -> bool:
    """Nothing but spaces, marks, labels and citations."""
    bare = _CITATION.sub(" ", _LABEL.sub(" ", text))
    return not any(unicodedata.category(c)[0] in "LNS" for c in bare) or text.strip().lower() in _NOTHING


def is_copy(prompt: list[str], response: list[str]) -> bool:
    if not prompt or not response:
        return False
    k = min(3, len(prompt), len(response))
    again = prompt + prompt
    there = {tuple(again[i : i + k]) for i in range(len(again) - k + 1)}
    mine = [tuple(response[i : i + k]) for i in range(len(response) - k + 1)]
    if sum(s in there for s in mine) < COPY_CONTAINED * len(mine):
        return False
    return common(prompt, response) >= COPY_COVERED * len(prompt)


def is_truncated(text: str) -> bool:
    """Running text that stops without an end; names, numbers and lists of them may."""
    bare = _CITATION.sub(" ", text).rstrip()
    while bare and (bare[-1] in _CLOSING or bare[-1].isspace()):
        bare = bare[:-1]
    if not bare or bare[-1] in _COMPLETE or text.rstrip()[-1] in "”»":
        return False
    words = re.findall(r"[^\W\d_]+", bare)
    running = [w for w in words if w[0].islower() and len(w) > 1 and w not in ("km", "ca")]
    if any(ord(w[0]) > 0x2E80 for w in words):
        return len("".join(words)) > 12
    return len(running) >= 2 or (len(running) >= 1 and (len(words) >= 4 or bare[-1] in ",;:-–—"))


def other_language(prompt: str, response: str, model: LanguageModel, of_prompt: str | None = None) -> bool:
    """Whether the response's own words, without quoted phrases and the prompt's words, belong
    to another language than the prompt."""
    asked, known = model.scores(prompt)
    if not known:
        return False
    mine = max(asked, key=asked.get)
    cited = set(tokens(prompt))
    text = _QUOTED.sub(" ", response)
    text = re.sub(r"[^\W\d_]+", lambda m: "·" if m.group()[0].isupper() and m.group().lower() in cited else m.group(), text)
    found, known = model.scores(text)
    if known < 2:
        return False
    best = max(found, key=found.get)
    return best != mine and found[best] - found[mine] > LANGUAGE_ODDS


def defect_of(prompt: str | None, response: str | None, model: LanguageModel, templates: RefusalTemplates) -> str | None:
    """The defect of a pair, the first of: empty, refusal, copy, truncated, language."""
    if response is None or is_empty(response):
        return "empty"
    prompt = prompt or ""
    bare = _CITATION.sub(" ", response)
    asked = tokens(prompt)
    sentences = [s for s in (tokens(x) for x in _SENTENCE.split(bare)) if s]
    if sentences:
        known = set(asked)
        whole = [w for s in sentences for w in s]
        refused = [templates.refuses(s, known) for s in sentences]
        opening = [s in templates.openings for s in sentences]
        if any(refused) and all(r or o for r, o in zip(refused, opening)) or templates.refuses(whole, known):
            return "refusal"
    if is_copy(asked, tokens(_LABEL.sub(" ", bare))):
        return "copy"
    if is_truncated(response):
        return "truncated"
    if other_language(prompt, response, model):
        return "language"
    return None


def find_defects(df: DataFrame, model: LanguageModel, id_col: str = "answer_id", prompt_col: str = "question", response_col: str = "text") -> DataFrame:
    """(id, defect) of each pair that is not usable.

    A null response is empty; with a null prompt only the response is judged. Repeated rows
    come out as often as they are there; other columns are ignored. One pass, no shuffle.
    """
    templates = RefusalTemplates()

    def run(batches):
        for batch in batches:
            found = [defect_of(p, r, model, templates) for p, r in zip(batch["prompt"], batch["response"])]
            batch = batch[["id"]].assign(defect=found)
            yield batch[batch["defect"].notna()]

    rows = df.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"), F.col(response_col).alias("response"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, defect string").withColumnRenamed("id", id_col)
