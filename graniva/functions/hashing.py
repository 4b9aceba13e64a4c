"""Prime tables, linear hashes and exact residues of strings, as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus of the linear hashes, and the length of the shared bit array.
P, BITS = 92143, 69997


@lru_cache
def primes(low: int, high: int) -> tuple[int, ...]:
    """All primes in [low, high]."""
    return tuple(n for n in range(max(2, low), high + 1) if all(n % d for d in range(2, int(n**0.5) + 1)))


def multipliers() -> tuple[int, ...]:
    return primes(71263, 71881)


def increments() -> tuple[int, ...]:
    return primes(30011, 31319)


def stream_coefficients(n: int) -> list[tuple[int, int, int]]:
    """(i, a, b) of the stream hashes ((a·x + b) mod P) mod BITS."""
    a, b = multipliers(), increments()
    return [(i, a[i % len(a)], b[(i + 1) % len(b)]) for i in range(n)]


def residue(text: Column, modulus: int = P) -> Column:
    """The UTF-8 bytes of a string as one big-endian integer, modulo ``modulus``, by Horner's rule."""
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    digits = F.when(F.octet_length(text) > 0, digits).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: F.pmod(s * 256 + d, F.lit(modulus)))


def linear(x: Column, a: Column, b: Column, p: int, m: int | Column) -> Column:
    """((a·x + b) mod p) mod m."""
    return F.pmod(F.pmod(a * x + b, F.lit(p)), m if isinstance(m, Column) else F.lit(m))


def trailing_zeros(h: Column) -> Column:
    """Trailing zeros of the binary form; 1 for 0."""
    return F.when(h == 0, F.lit(1)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))
