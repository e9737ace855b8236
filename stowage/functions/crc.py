"""CRC-32 of concatenations as Catalyst expressions.

A CRC is a polynomial over GF(2) modulo POLY, bits reflected. Appending n bytes multiplies it by x^(8n), so
combine(c1, c2, n) = c1 * x^(8n) + c2. Powers x^(2^k) repeat after 32. Multiplying by a fixed power is linear, so products
with a power are looked up by nibbles of the CRC in a table built below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLY = 0xEDB88320
ONE = 1 << 31


def multiply(a: int, b: int) -> int:
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLY if b & 1 else 0)
    return out


def _powers() -> list[int]:
    out = [1 << 30]  # x
    for _ in range(31):
        out.append(multiply(out[-1], out[-1]))
    return out


POWERS = _powers()


def shift(n: int) -> int:
    """x^(8n)."""
    out, k = ONE, 3
    while n:
        if n & 1:
            out = multiply(POWERS[k % 32], out)
        n, k = n >> 1, k + 1
    return out


def combine(c1: int, c2: int, n: int) -> int:
    return multiply(shift(n), c1) ^ c2


#: Bits of a length, all that a long has.
LENGTH_BITS = 63


def _products() -> list[int]:
    """For bit k of a length, nibble j of a CRC and the nibble's value v, at 128k + 16j + v: the CRC's part times x^(8 * 2^k)."""
    return [multiply(POWERS[(k + 3) % 32], v << 4 * j) for k in range(LENGTH_BITS) for j in range(8) for v in range(16)]


PRODUCTS = _products()


def combine_col(c1: Column, c2: Column, n: Column) -> Column:
    """CRC of two parts from their CRCs and the length of the second: one step of eight lookups for each set bit of the length."""
    table = F.from_json(F.lit(str(PRODUCTS)), "array<bigint>")  # folded to a literal
    bits = F.filter(F.sequence(F.lit(0), F.lit(LENGTH_BITS - 1)), lambda k: F.call_function("shiftright", n.cast("long"), k).bitwiseAND(F.lit(1).cast("long")) == 1)

    def step(crc: Column, k: Column) -> Column:
        parts = [F.element_at(table, k * 128 + F.shiftright(crc, 4 * j).bitwiseAND(F.lit(15).cast("long")).cast("int") + (16 * j + 1)) for j in range(8)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseXOR(p)
        return out

    return F.aggregate(bits, c1, step).bitwiseXOR(c2)
