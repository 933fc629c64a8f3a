import random

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import tokens
from corpuslab.functions.bytelevel import byte_pieces, byte_symbols, printable_bytes


def plain_words(text):
    """Words read letter by letter: marks and ampersands stand alone, digits, spaces and quotes go."""
    if text.endswith("\n"):
        text = text[:-1]
    words, word, at = [], "", 0
    while at < len(text):
        letter = text[at]
        if text.startswith("&amp;", at):
            # An ampersand begins a word, and what follows it belongs to that word.
            words, word, at = [*words, word], "&amp;", at + 5
            continue
        if letter in "()!.?,$~+*":
            words, word = [*words, word, letter], ""
        elif letter == " " or letter.isdecimal():
            words, word = [*words, word], ""
        elif letter not in "\"'":
            word += letter
        at += 1
    return [w for w in [*words, word] if w]


WORD_CASES = {
    "": [],
    "a.b!c": ["a", ".", "b", "!", "c"],
    "x&amp;y": ["x", "&amp;y"],
    "it's \"ok\"": ["its", "ok"],
    "a1b22c": ["a", "b", "c"],
    "a٣b": ["a", "b"],
    "tab\there": ["tab\there"],
    "two  spaces": ["two", "spaces"],
    "end\n": ["end"],
    "(hi)$~+*": ["(", "hi", ")", "$", "~", "+", "*"],
    "a\nb": ["a\nb"],
    "& amp;": ["&", "amp;"],
    '&a"mp;': ["&amp;"],
}


def test_word_cases(column):
    assert column(tokens.word_tokens, list(WORD_CASES)) == list(WORD_CASES.values())


def test_tokenizers_on_random_texts(column):
    rng = random.Random(5)
    parts = list("ab .,!?$~+*()\"'0٣é\t\n") + ["&amp;", "😀", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(1000)]
    assert column(tokens.word_tokens, texts) == [plain_words(t) for t in texts]
    assert column(tokens.char_tokens, texts) == [list(t) for t in texts]
    assert column(tokens.space_tokens, texts) == [t.split() for t in texts]


def test_unknown_tokenizer_fails_early():
    with pytest.raises(ValueError, match="unknown tokenizer"):
        tokens.get_tokenizer("sentence")


@pytest.mark.parametrize(
    "mode, given, text",
    [
        ("char", ["a", " ", "b"], "a b"),
        ("word", ["a", "b"], "a b"),
        ("byte-level", ["The", "Ġca", "t"], "The cat"),
        ("subword", ["play", "##ing", "now"], "playing now"),
    ],
)
def test_join_tokens(spark, mode, given, text):
    row = spark.range(1).select(tokens.join_tokens(F.array(*map(F.lit, given)), mode)).first()
    assert row[0] == text


@pytest.mark.parametrize(
    "mode, given, words",
    [
        ("char", ["<BOS>", "a", " ", "b", " ", "c"], 3),
        ("word", ["<BOS>", "a", "b"], 2),
        ("byte-level", ["<BOS>", "Ġa", "b", "Ġc"], 1),
        ("subword", ["<BOS>", "play", "##ing", "now"], 2),
    ],
)
def test_words_in_sequence(spark, mode, given, words):
    column = tokens.words_in_sequence(F.array(*map(F.lit, given)), mode)
    assert spark.range(1).select(column).first()[0] == words


def test_first_word(column):
    texts = ["I am", "So. what", 'a\\b!"c d', "alone", "", " lead"]
    assert column(tokens.first_word, texts) == ["I", "So", "abc", "alone", "", ""]


def test_printable_bytes():
    table = printable_bytes()
    assert len(set(table)) == 256
    assert table[ord(" ")] == "Ġ" and table[ord("\n")] == "Ċ" and table[ord("a")] == "a"
    assert all(not c.isspace() for c in table)


def test_byte_pieces_and_symbols(column):
    assert column(byte_pieces, ["It's 12 days,  ok é"]) == [
        ["It", "'s", " 12", " days", ",", " ", " ok", " é"]
    ]
    assert column(byte_symbols, [" é"]) == [["Ġ", "Ã", "©"]]
