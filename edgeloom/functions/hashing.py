"""64-bit mixing hashes as column expressions that hold under ANSI arithmetic, and keyed random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the SplitMix64 generator.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
MASK = (1 << 64) - 1


def _limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]


def _join(parts: list[Column]) -> Column:
    """Limbs, of which each may hold a carry for the next, as one 64-bit pattern."""
    out, carry = F.lit(0).cast("long"), F.lit(0).cast("long")
    for i, p in enumerate(parts):
        p = p + carry
        out = out.bitwiseOR(F.shiftleft(p.bitwiseAND(F.lit(0xFFFF)), 16 * i))
        carry = F.shiftrightunsigned(p, 16)
    return out


def mul64(x: Column, c: int) -> Column:
    """x * c modulo 2^64, on bit patterns."""
    xs, cs = _limbs(x), [c >> 16 * i & 0xFFFF for i in range(4)]
    return _join([sum((xs[j] * F.lit(cs[i - j]).cast("long") for j in range(i + 1)), F.lit(0).cast("long")) for i in range(4)])


def add64(x: Column, c: int) -> Column:
    """x + c modulo 2^64, on bit patterns."""
    return _join([v + F.lit(c >> 16 * i & 0xFFFF).cast("long") for i, v in enumerate(_limbs(x))])


def _fold(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftrightunsigned(x, n))


def with_mix64(df: DataFrame, out: str, x: Column, gamma: bool = True) -> DataFrame:
    """df with the SplitMix64 of x as a 64-bit pattern in column out; without gamma only its finaliser. Each step is a
    let-binding by way of a one-element array, so that the expression stays small."""

    def let(value: Column, use) -> Column:
        return F.transform(F.array(value), use)[0]

    first = add64(x, GAMMA) if gamma else x
    step = let(first, lambda v: mul64(_fold(v, 30), MIX_1))
    step = let(step, lambda v: mul64(_fold(v, 27), MIX_2))
    return df.withColumn(out, let(step, lambda v: _fold(v, 31)))


def with_pair_hash(df: DataFrame, out: str, u: str, v: str) -> DataFrame:
    """df with a signed 32-bit hash of the unordered pair (u, v) of 32-bit ids."""
    key = F.shiftleft(F.least(u, v).cast("long"), 32).bitwiseOR(F.greatest(u, v).cast("long"))
    return with_mix64(df, "__h", key, gamma=False).withColumn(out, F.shiftright(F.shiftleft(F.col("__h"), 32), 32).cast("int")).drop("__h")


def unsigned_order(h: str | Column) -> Column:
    """A sort key under which bit patterns rise as unsigned numbers."""
    return (F.col(h) if isinstance(h, str) else h).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def splitmix64(value: int) -> int:
    """The same of one number, on the driver."""
    x = (value + GAMMA) & MASK
    x = (x ^ x >> 30) * MIX_1 & MASK
    x = (x ^ x >> 27) * MIX_2 & MASK
    return x ^ x >> 31


def permutation(n: int, seed: int, epoch: int = 0) -> tuple[int, int]:
    """(offset, stride) of the affine permutation of 0..n-1 that belongs to a seed and an epoch."""
    if n <= 1:
        return 0, 1
    key = seed + 1_000_003 * epoch + 17
    at = splitmix64(key + 1) % (n - 1)
    # the first stride from there on, around the end, that shares no divisor with n
    stride = next(s for s in ((at + i) % (n - 1) + 1 for i in range(n)) if math.gcd(s, n) == 1)
    return splitmix64(key) % n, stride


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number from 0 to 1, without 1, that depends on seed and keys alone, not on partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def draw(n: int | Column, seed: int, *keys: str | Column) -> Column:
    """A whole number from 0 to n - 1, likewise."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n) if isinstance(n, int) else n)
