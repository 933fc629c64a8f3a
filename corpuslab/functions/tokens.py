"""Tokenizers and token-list functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.bytelevel import byte_text
from corpuslab.functions.cleaning import WHITESPACE

# The marker tokens and what separates words.
UNK = "<unk>"
PAD = "<pad>"
BOS = "<BOS>"
EOS = "<EOS>"
AMPERSAND = "&amp;"
SINGLED_OUT = r"([()!.?,$~+*])"
DECIMAL_DIGIT = r"\p{Nd}"
QUOTES = "\"'"
WORD_START = "\u0120"  # stands for the space before a word in byte-level pieces
CONTINUED = "##"  # starts a piece that continues a word
PROMPT_NOISE = '\\.!"\n'


def char_tokens(text: Column) -> Column:
    """One token per character; no tokens for an empty text."""
    empty = F.array().cast("array<string>")
    return F.when(text == "", empty).otherwise(F.split(text, ""))


def space_tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, f"{WHITESPACE}+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Words, with punctuation singled out and digits and quotes dropped.

    A text is cut before ``&amp;``, around each singled-out sign, at digits and at
    single spaces. Separators are put in as spaces, so one split on a space is
    enough and no look-around is needed.
    """
    text = F.regexp_replace(text, r"\n\z", "")
    text = F.replace(text, F.lit(AMPERSAND), F.lit(f" {AMPERSAND}"))
    text = F.regexp_replace(text, SINGLED_OUT, " $1 ")
    text = F.regexp_replace(text, DECIMAL_DIGIT, " ")
    text = F.translate(text, QUOTES, "")
    return F.filter(F.split(text, " "), lambda t: t != "")


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "char": char_tokens,
    "space": space_tokens,
    "word": word_tokens,
}


def get_tokenizer(name: str) -> Callable[[Column], Column]:
    """The tokenizer of that name; an unknown name fails before any job starts."""
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}, expected one of {sorted(TOKENIZERS)}")
    return TOKENIZERS[name]


def wrap(tokens: Column) -> Column:
    """Begin and end markers around a token list."""
    return F.concat(F.array(F.lit(BOS)), tokens, F.array(F.lit(EOS)))


def join_tokens(tokens: Column, mode: str) -> Column:
    """Text from a token list, by the kind of tokens it holds."""
    if mode == "char":
        return F.array_join(tokens, "")
    if mode == "word":
        return F.array_join(tokens, " ")
    if mode == "byte-level":
        return byte_text(F.array_join(tokens, ""))
    if mode == "subword":
        return F.replace(F.array_join(tokens, " "), F.lit(f" {CONTINUED}"), F.lit(""))
    raise ValueError(f"unknown mode {mode!r}")


def _occurrences(text: Column, part: str) -> Column:
    removed = F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    return (removed / len(part)).cast("long")


def words_of_characters(text: Column) -> Column:
    """Words in the characters of a text, as ``words_in_sequence`` counts them in their list."""
    return _occurrences(text, " ") + 1


def words_in_sequence(tokens: Column, mode: str) -> Column:
    """Words in an unpadded token list that starts with the begin marker."""
    size = F.size(tokens).cast("long")
    if mode == "char":
        return F.size(F.filter(tokens, lambda t: t == " ")).cast("long") + 1
    if mode == "word":
        return size - 1
    if mode == "byte-level":
        return _occurrences(F.array_join(tokens, ""), WORD_START) - 1
    if mode == "subword":
        return size - _occurrences(F.array_join(tokens, ""), CONTINUED) - 1
    raise ValueError(f"unknown mode {mode!r}")


def first_word(line: Column) -> Column:
    """The first space-delimited piece of a line, without the noise signs."""
    return F.translate(F.split(line, " ", 2)[0], PROMPT_NOISE, "")
