"""String expressions whose results must not depend on locale."""

from __future__ import annotations

import string
import zlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_upper(c: Column) -> Column:
    """Uppercase a-z only. ``upper`` would turn a dotless i into I and a sharp s into SS."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def _unsigned(half: Column) -> Column:
    wide = half.cast("decimal(38,0)")
    return F.when(half < 0, wide + F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(wide)


def _word_tables(order: str) -> list[list[int]]:
    """What the four bytes of a CRC-32 each say of the four bytes that it was taken of, read as a number in that byte order.

    Of four bytes CRC-32 loses nothing, and but for a constant it is linear over bits: their number is the four tables' entries XORed.
    """
    nothing = zlib.crc32(bytes(4))
    rows: dict[int, tuple[int, int]] = {}  # by highest bit: a CRC without its constant, and the number that has it
    for i in range(32):
        number, check = 1 << i, zlib.crc32((1 << i).to_bytes(4, order)) ^ nothing
        while check and (found := rows.get(check.bit_length())):
            check, number = check ^ found[0], number ^ found[1]
        rows[check.bit_length()] = check, number

    def number_of(check: int) -> int:
        number = 0
        while check:
            found = rows[check.bit_length()]
            check, number = check ^ found[0], number ^ found[1]
        return number

    return [[number_of((v << 8 * j) ^ (nothing & 0xFF << 8 * j)) for v in range(256)] for j in range(4)]


_TABLES = {order: [f"array({', '.join(f'{n}L' for n in t)})" for t in _word_tables(order)] for order in ("little", "big")}


def _word(four: Column, order: str) -> Column:
    """Four bytes as an unsigned number: looked up by their CRC-32, which costs far less than hexadecimal digits."""
    check = F.crc32(four)
    found = [
        F.get(F.expr(table), F.shiftright(check, 8 * j).bitwiseAND(F.lit(0xFF)).cast("int")) for j, table in enumerate(_TABLES[order])
    ]
    return reduce(Column.bitwiseXOR, found)


def byte_words(c: Column) -> tuple[Column, Column, Column, Column]:
    """The first eight bytes as a little-endian number and the last eight as a big-endian one: upper and lower 32 bits of each, unsigned.

    Shorter strings are zero padded, the first number behind them and the second before them.
    """
    raw = c.cast("binary")
    head, tail = F.rpad(raw, 8, F.lit(b"\x00")), F.lpad(F.substring(raw, -8, 8), 8, F.lit(b"\x00"))
    return (
        _word(F.substring(head, 5, 4), "little"),
        _word(F.substring(head, 1, 4), "little"),
        _word(F.substring(tail, 1, 4), "big"),
        _word(F.substring(tail, 5, 4), "big"),
    )


def fingerprint_halves(c: Column) -> tuple[Column, Column]:
    """First eight bytes as a little-endian number, and the first eight of the reversed bytes.

    Shorter strings are zero padded. The second number is also the big-endian reading of the last eight bytes.
    Both are unsigned 64-bit numbers in a long.
    """
    words = byte_words(c)
    return tuple(F.shiftleft(upper, 32).bitwiseOR(lower) for upper, lower in (words[:2], words[2:]))


def string_fingerprint(c: Column) -> Column:
    """The sum of both halves. DECIMAL(38,0), so that sums over a corpus stay exact."""
    head, tail = fingerprint_halves(c)
    return (_unsigned(head) + _unsigned(tail)).cast("decimal(38,0)")


def blank(c: Column) -> Column:
    """Null or nothing but whitespace."""
    return F.coalesce(F.trim(c), F.lit("")) == ""
