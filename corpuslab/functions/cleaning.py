"""Text cleaning rules as Column expressions.

Two rule lists exist. The *general* list replaces things that are not prose
(addresses, numbers, currency signs) by placeholder words and folds the text to
lower-case ASCII. The *strict* list leaves only lower-case letters and spaces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.rows import item_rows

# Patterns and words of the strict rules.
URL = r"https?://[^ ]+"
USER_NAME = r"@[^ ]+"
HASH_SIGN = "#"
REPEATED_LETTER = r"([A-Za-z])\1{2,}"
LONE_ZERO = " 0 "
ZERO_WORD = "zero"
NOT_LETTER_OR_SPACE = r"[^A-Za-z ]"
NOT_LETTERS = r"[^A-Za-z]+"

# Patterns of the general rules (syntax common to Java and RE2).
ADDRESS = r"(?:https?://|www\.)[^ \t\r\n\f]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CURRENCY = r"\p{Sc}"
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)*\b"
DIGIT = r"[0-9]"
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]"
NOT_ASCII = r"[^\x00-\x7F]"
BLANK_RUN = r"[ \t\f\x0B]+"

# Fixed value: every character that counts as white space in text.
WHITESPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, UNACCENTED = _accent_table()

STRICT_RULES: dict[str, Callable[[Column], Column]] = {
    "urls": lambda c: F.regexp_replace(c, URL, ""),
    "user_names": lambda c: F.regexp_replace(c, USER_NAME, ""),
    "hash_signs": lambda c: F.replace(c, F.lit(HASH_SIGN), F.lit("")),
    "repeated_letters": lambda c: F.regexp_replace(c, REPEATED_LETTER, "$1"),
    "lone_zero": lambda c: F.replace(c, F.lit(LONE_ZERO), F.lit(ZERO_WORD)),
    "letters_only": lambda c: F.regexp_replace(c, NOT_LETTER_OR_SPACE, ""),
    "lower": lambda c: F.ltrim(F.lower(c)),
}


def clean_strict(text: Column, rules: Iterable[str] = tuple(STRICT_RULES)) -> Column:
    """Apply the named strict rules, always in the order of ``STRICT_RULES``."""
    wanted = set(rules)
    unknown = wanted - set(STRICT_RULES)
    if unknown:
        raise ValueError(f"unknown cleaning rules: {sorted(unknown)}")
    for name, rule in STRICT_RULES.items():
        if name in wanted:
            text = rule(text)
    return text


def clean_general(
    text: Column,
    *,
    url_word: str = "<url>",
    email_word: str = "<email>",
    number_word: str = "<number>",
    digit_word: str = "0",
    currency_word: str = "<cur>",
) -> Column:
    """Replace what is not prose by placeholder words, fold to lower-case ASCII."""
    text = F.regexp_replace(text, ADDRESS, url_word)
    text = F.regexp_replace(text, EMAIL, email_word)
    text = F.regexp_replace(text, CURRENCY, currency_word)
    text = F.regexp_replace(text, EMOJI, "")
    text = F.translate(text, ACCENTED, UNACCENTED)
    text = F.regexp_replace(text, NOT_ASCII, "")
    text = F.regexp_replace(text, NUMBER, number_word)
    text = F.regexp_replace(text, DIGIT, digit_word)
    text = F.regexp_replace(F.lower(text), BLANK_RUN, " ")
    return F.trim(text)


def clean_letters(text: Column) -> Column:
    """Runs of anything but letters become one space; trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, NOT_LETTERS, " ")))


def is_blank(text: Column) -> Column:
    """True for text of white space only, the empty string included."""
    return text.rlike(rf"\A{WHITESPACE}*\z")


def drop_blank(df: DataFrame, required: str) -> DataFrame:
    """Blank strings become null in every string column; rows without ``required`` go.

    A required string is made a row of its own: a filter on it would be moved below
    the rules it comes from, which then ran three times.
    """
    def filled(name: str) -> Column:
        return F.when(~is_blank(F.col(name)), F.col(name))

    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    others = [filled(c).alias(c) if c in strings else F.col(c) for c in df.columns if c != required]
    if required not in strings:
        return df.select(*others, required).select(df.columns).dropna(subset=[required])
    return item_rows(df, others, F.array(filled(required)), required).select(df.columns)
