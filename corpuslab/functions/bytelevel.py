"""Byte-level pieces: words as strings of printable stand-ins for their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how text is cut into pieces before byte pairs are merged.
PIECES = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> list[str]:
    """A printable character per byte value.

    Printable Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order. A space becomes ``Ġ``.
    """
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


def byte_pieces(text: Column) -> Column:
    """The pieces of a text, still as plain text."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def byte_values(piece: Column, table: Column) -> Column:
    """For each UTF-8 byte of a piece, the entry of a 256-entry array, as an array."""
    pairs = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.get(table, F.conv(h, 16, 10).cast("int")))


def byte_symbols(piece: Column) -> Column:
    """The stand-in characters of a piece's UTF-8 bytes, as an array."""
    return byte_values(piece, F.array(*[F.lit(c) for c in printable_bytes()]))


def byte_text(symbols: Column) -> Column:
    """The text of a string of stand-in characters; bytes that are no UTF-8 become replacement signs.

    A symbol beyond U+0143 or without a byte is left out.
    """
    codes = F.split(symbols, "")
    digits = F.transform(codes, lambda c: F.get(_hex_digits(), F.ascii(c)))
    raw = F.unhex(F.array_join(F.filter(digits, lambda d: d.isNotNull()), ""))
    return F.when(symbols == "", F.lit("")).otherwise(F.make_valid_utf8(raw.cast("string")))


def _hex_digits() -> Column:
    """Two hexadecimal digits by code point of a stand-in character; null where there is none."""
    byte_of = {ord(c): b for b, c in enumerate(printable_bytes())}
    found = [f"{byte_of[i]:02X}" if i in byte_of else None for i in range(max(byte_of) + 1)]
    return F.array(*[F.lit(d).cast("string") for d in found])
