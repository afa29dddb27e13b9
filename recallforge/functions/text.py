"""Column functions over text. Offsets count code points; null in, null out, unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a character class that Spark and DuckDB both read.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = f"[^{SPACES}]+"
_RARE_SPACES = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TERM = r"[\p{L}\p{N}_]+"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Function words, which carry no claim.
FUNCTION_WORDS = (
    "a an the and or but of in on at to for from by with as is are was were be been being "
    "it its this that these those he she they them his her their there here which who whom "
    "whose what when where why how do does did has have had not no yes so than then also "
    "about into over after before during i you we us our"
).split()


def tokenize(text: Column) -> Column:
    """Lower-case terms: runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def plain_spaces(text: Column) -> Column:
    """The text with a plain space for each rare one: as many characters."""
    return F.translate(text, _RARE_SPACES, " " * len(_RARE_SPACES))


def words(text: Column) -> Column:
    """Longest runs without white space. Rare spaces become plain ones first: the regular
    expression then needs the plain class, which is several times faster."""
    return F.regexp_extract_all(plain_spaces(text), F.lit(r"(\S+)"), F.lit(1))


def normalise_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and English articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    # the letter is looked at first: whether a word begins is a slow question in Unicode
    no_articles = F.regexp_replace(bare, r"(?U)(?=[at])\b(a|an|the)\b", " ")
    return F.array_join(words(no_articles), " ")


def contains_reference(answer: Column, references: Column) -> Column:
    """Whether any reference, normalised and not empty, stands in the answer as whole words."""
    padded = F.concat(F.lit(" "), normalise_answer(answer), F.lit(" "))
    return F.exists(
        F.coalesce(references, F.array().cast("array<string>")),
        lambda r: (normalise_answer(r) != "") & padded.contains(F.concat(F.lit(" "), normalise_answer(r), F.lit(" "))),
    )


def lexical_support(asked: Column, answer: Column, passages: Column) -> Column:
    """Share of the answer's new content words that the passages have; 1 of no new words.

    All three are arrays of terms, stemmed alike or not at all.
    """
    stop = F.array(*map(F.lit, FUNCTION_WORDS))
    new = F.array_except(F.array_except(answer, asked), stop)
    return F.when(F.size(new) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(new, passages)) / F.size(new))


def is_declined(answer: Column) -> Column:
    """Whether the answer is the sentence of declining, whatever its quotes, stop and case."""
    bare = F.lower(F.translate(F.regexp_replace(answer, f"^[{SPACES}]+|[{SPACES}]+$", ""), "’", "'"))
    return F.regexp_replace(bare, r"""^["'.]+|["'.]+$""", "").rlike(r"^i (don't|do not) know$")


def numbered(passages: Column) -> Column:
    """Passages as ``[i] text``, joined by blank lines."""
    lines = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p))
    return F.array_join(lines, "\n\n")


def answer_prompt(question: Column, passages: Column) -> Column:
    return F.concat(F.lit("Passages:\n"), numbered(passages), F.lit("\n\nQuestion: "), question)


def groundedness_prompt(question: Column, passages: Column, answer: Column) -> Column:
    """What a judge of groundedness sees: no reference."""
    return F.concat(answer_prompt(question, passages), F.lit("\n\nAnswer: "), answer)


def correctness_prompt(question: Column, references: Column, answer: Column) -> Column:
    listed = F.array_join(F.transform(references, lambda r: F.concat(F.lit("- "), r)), "\n")
    return F.concat(F.lit("Question: "), question, F.lit("\n\nReference answers:\n"), listed, F.lit("\n\nAnswer: "), answer)


def heading(text: Column) -> Column:
    """The line before the first line break."""
    return F.substring_index(text, "\n", 1)


def body(text: Column) -> Column:
    """What follows the first line break; empty without one."""
    at = F.instr(text, "\n")
    return F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise(F.lit(""))


def digest(text: Column, length: int = 64) -> Column:
    """Beginning of the SHA-256 in hex."""
    return F.left(F.sha2(text, 256), F.lit(length))


def page_id(url: Column) -> Column:
    return F.concat(F.lit("nq-"), digest(url, 12))


def tag_name(token: Column) -> Column:
    """Upper-case name of a tag, without attributes; empty of no name."""
    return F.upper(F.regexp_extract(token, r"^<?\s*/*\s*([^\s<>/]*)", 1))


def is_closing(token: Column) -> Column:
    return token.rlike(r"^<?\s*/")


def answer_type(tag: Column) -> Column:
    """Kind of answer by the tag it begins with."""
    return (
        F.when(tag.isin("TABLE", "TR", "TD", "TH"), "table").when(tag.isin("UL", "OL", "LI", "DL", "DD", "DT"), "list").otherwise("paragraph")
    )


def cost(prompt: Column, output: Column, thinking: Column, per_input: float, per_output: float) -> Column:
    """Price of a call, the rates being per million tokens."""
    return (prompt * per_input + (output + thinking) * per_output) / 1e6


def setup_parts(setup: Column) -> Column:
    """(chunker, retriever, rerank, flat_tables) of a setup's name."""
    flat = setup.endswith("-flat-tables")
    rest = F.regexp_replace(setup, "-flat-tables$", "")
    rerank = rest.endswith("-rerank")
    rest = F.regexp_replace(rest, "-rerank$", "")
    return F.struct(
        F.substring_index(rest, "-", 1).alias("chunker"), F.regexp_replace(rest, "^[^-]*-", "").alias("retriever"), rerank.alias("rerank"), flat.alias("flat_tables")
    )


def setup_name(chunker: Column, retriever: Column, rerank: Column, flat_tables: Column) -> Column:
    return F.concat_ws("-", chunker, retriever, F.when(rerank, "rerank"), F.when(flat_tables, "flat-tables"))
