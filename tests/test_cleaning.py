import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import cleaning


def plain_strict(text):
    """The strict rules in plain Python, one statement each."""
    steps = [
        (r"https?://[^ ]+", ""), ("@[^ ]+", ""), ("#", ""), (r"([A-Za-z])\1{2,}", r"\1"),
        (" 0 ", "zero"), ("[^A-Za-z ]", ""),
    ]
    for pattern, new in steps:
        text = re.sub(pattern, new, text)
    return text.lower().lstrip()


CASES = {
    "http://t.co/abc end": "end",
    "@TheUser So true :)": "so true ",
    "#tag word": "tag word",
    "sooooo gooood": "so god",
    "aa bbb": "aa b",
    "a 0 b": "azerob",
    "mail a@b.com": "mail a",
    "$5 and €6": " and ".lstrip(),
    "Ünïcode": "ncode",
    "   lead": "lead",
    "!!! ...": "",
    "😀 ok": "ok",
}


def test_strict_cases(column):
    assert column(cleaning.clean_strict, list(CASES)) == list(CASES.values())


def test_strict_matches_plain_rules_on_random_texts(column):
    rng = random.Random(3)
    parts = ["http://x.y/z", "@me", "#", "aaa", "BBBB", " 0 ", " ", "é", "7", "word", "!", "\t", "0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    assert column(cleaning.clean_strict, texts) == [plain_strict(t) for t in texts]


def test_single_strict_rules(column):
    only = lambda name: lambda c: cleaning.clean_strict(c, [name])
    assert column(only("urls"), ["see https://a.b/c now"]) == ["see  now"]
    assert column(only("lower"), ["  A b "]) == ["a b "]
    with pytest.raises(ValueError):
        cleaning.clean_strict(F.lit(""), ["no such rule"])


def test_null_stays_null(column):
    assert column(cleaning.clean_strict, [None]) == [None]
    assert column(cleaning.clean_general, [None]) == [None]


def test_general(column):
    cases = {
        "See HTTPS://x.y": "see https://x.y",
        "See https://x.y/z?q now": "see <url> now",
        "www.site.org!": "<url>",
        "mail a.b@c.org": "mail <email>",
        "$5 and €6,50": "<cur><number> and <cur><number>",
        "a1b 3.14 1,000": "a0b <number> <number>",
        "Ünïcödé  tab\there": "unicode tab here",
        "smile 😀❤ end": "smile end",
        "line\nbreak": "line\nbreak",
    }
    assert column(cleaning.clean_general, list(cases)) == list(cases.values())


def test_general_placeholders_are_parameters(column):
    rule = lambda c: cleaning.clean_general(c, number_word="#", url_word="")
    assert column(rule, ["12 http://a.b x"]) == ["# x"]


def test_letters(column):
    assert column(cleaning.clean_letters, ["  The 3 Dogs! ", "", "99"]) == ["the dogs", "", ""]


def test_blank_matches_python_white_space(column):
    texts = ["", " ", "\t\n", " ", "  \x85", "a", " a ", "​", "\x1c\x0b"]
    expected = [re.fullmatch(r"\s*", t) is not None for t in texts]
    assert column(cleaning.is_blank, texts) == expected


def test_drop_blank_nulls_every_text_column(spark):
    rows = spark.createDataFrame(
        [(1, "a", " "), (2, "\t", "b"), (3, None, "c")], "n int, text string, other string"
    )
    kept = cleaning.drop_blank(rows, "text").collect()
    assert [tuple(r) for r in kept] == [(1, "a", None)]
