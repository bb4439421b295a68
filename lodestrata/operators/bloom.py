"""Block-split Bloom filters as tables, built and tested with built-in functions."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public split-block layout: odd multipliers that pick one bit in each of a block's eight words.
SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: A filter is sent to every executor up to this size and joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20


def optimal_bits(ndv: int, fpp: float) -> int:
    """Bits for ndv values at a false-positive rate: eight bits a value, a power of two, 256 at least."""
    if not 0 < fpp < 1:
        raise ValueError("the false-positive rate lies between 0 and 1")
    raw = max(256, floor(-8.0 * ndv / log(1 - fpp ** (1 / 8))))
    return 2 ** ceil(log2(raw))


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _masks(h: Column) -> list[Column]:
    """One bit for each word: the top five bits of the low half times the salt, modulo 2^32, in 16-bit steps so that nothing overflows."""
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.shiftrightunsigned(low, 16), low.bitwiseAND(F.lit(0xFFFF))

    def place(salt: int) -> Column:
        product = F.shiftleft((a * F.lit(salt)).bitwiseAND(F.lit(0xFFFF)), 16) + b * F.lit(salt)
        return F.shiftrightunsigned(product.bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")

    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(s)) for s in SALT]


def build(df: DataFrame, field: str, bits: int, within: list[str] | None = None) -> DataFrame:
    """block, w0 to w7 (and within): the filter over the field's valid values, by partial OR before the shuffle."""
    h, blocks = F.xxhash64(field), max(1, bits // 256)
    words = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(h))]
    return df.where(F.col(field).isNotNull()).groupBy(*(within or []), _block(h, blocks).alias("block")).agg(*words)


def probe(df: DataFrame, field: str, sieve: DataFrame, bits: int, within: Column | None = None) -> DataFrame:
    """The rows whose value may be in the filter (that of their group, where within tells which it is); those left out surely aren't."""
    h, blocks = F.xxhash64(field), max(1, bits // 256)
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(h))])
    sent = F.broadcast(sieve) if within is None and bits // 8 * 3 <= BROADCAST_BYTES else sieve
    on = _block(h, blocks) == F.col("block")
    return df.join(sent, on if within is None else on & within).where(hit).select(*[df[c] for c in df.columns])


def semi_join(df: DataFrame, field: str, members: DataFrame, key: str, fpp: float = 0.05) -> DataFrame:
    """The rows whose value is a member: the filter first, then the exact semi-join over what it passes."""
    keys = members.select(F.col(key).alias(field)).where(F.col(field).isNotNull())
    bits = optimal_bits(max(1, keys.agg(F.approx_count_distinct(field, 0.02)).first()[0]), fpp)
    return probe(df, field, build(keys, field, bits), bits).join(keys, field, "left_semi").select(*df.columns)


def holding(sieve: DataFrame, value, kind: str, bits: int, within: list[str]) -> DataFrame:
    """The groups (within) whose filter may hold value; sieve: as build() makes it by group, or read back."""
    one = sieve.sparkSession.range(1).select(F.lit(value).cast(kind).alias("v"))
    h, blocks = F.xxhash64("v"), max(1, bits // 256)
    wanted = one.select(_block(h, blocks).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks(h))]).first()
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.lit(wanted[f"m{i}"])) == F.lit(wanted[f"m{i}"]) for i in range(8)])
    return sieve.where((F.col("block") == wanted["block"]) & hit).select(*within)


def may_have(df: DataFrame, field: str, value, bits: int, within: list[str]) -> DataFrame:
    """The groups (within) whose filter may hold value, from a filter built by group."""
    return holding(build(df, field, bits, within), value, df.schema[field].dataType.simpleString(), bits, within)
