"""Fingerprint hashes and bit functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

c = F.col


def _bit(condition: Column, place: int) -> Column:
    return F.shiftleft(F.coalesce(condition, F.lit(False)).cast("bigint"), place)


def _field(value: Column, width: int, place: int) -> Column:
    return F.shiftleft(value.cast("bigint").bitwiseAND(F.lit((1 << width) - 1)), place)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _common(shift: int) -> list[Column]:
    """Bits 6 to 33: order of bins and magnitudes, of the two time and bin steps, the coarse first bin and the two steps in bins."""
    d21, d32 = F.abs(c("f2") - c("f1")), F.abs(c("f3") - c("f2"))
    flags = [c("f1") > c("f2"), c("f2") > c("f3"), c("f3") > c("f1"), c("m1") > c("m2"), c("m2") > c("m3"), c("m3") > c("m1"), (c("t2") - c("t1")) > (c("t3") - c("t2")), d21 > d32]
    return [*(_bit(x, 6 + i) for i, x in enumerate(flags)), _field(F.shiftright("f1", shift), 8, 14), _field(F.shiftright(d21, 2), 6, 22), _field(F.shiftright(d32, 2), 6, 28)]


def hash_constant_q() -> Column:
    """34 bits over t1..m3; the low six are the ratio of the two time steps. Exact in integers; null where t3 = t1 or a time or bin is null."""
    ratio = F.expr("CASE WHEN t3 <> t1 THEN (64 * (CAST(t2 AS BIGINT) - t1)) div (CAST(t3 AS BIGINT) - t1) END")
    return _any([_field(ratio, 6, 0), *_common(5)])


def hash_fft() -> Column:
    """34 bits over t1..m3; the low six are the whole time step, modulo 64."""
    return _any([_field(c("t3") - c("t1"), 6, 0), *_common(1)])


def hash_robust() -> Column:
    """30 bits: interleaved log ratios of the time and of the bin steps, six comparisons, coarse bins; the time flag is added over the top bit of the third bin."""

    def ratio(a: Column, b: Column, least: float, most: float) -> Column:
        low, high = F.log(F.lit(least / most)), F.log(F.lit(most / least))
        return F.floor((F.log(F.abs(F.try_divide(a.cast("double"), b.cast("double")))) - low) / (high - low) * 512 + 0.5).cast("bigint")

    time = ratio(c("t2") - c("t1"), c("t3") - c("t2"), 2, 30)
    freq = ratio(c("f2") - c("f1"), c("f3") - c("f2"), 1, 126)
    flags = [c("f1") > c("f2"), c("f2") > c("f3"), c("f3") > c("f1"), c("m1") > c("m2"), c("m2") > c("m3"), c("m3") > c("m1")]
    parts = [morton_encode(freq, time).bitwiseAND(F.lit((1 << 18) - 1)), *(_bit(x, 18 + i) for i, x in enumerate(flags)), *(_field(F.shiftright(f, 7), 2, p) for f, p in (("f1", 24), ("f2", 26), ("f3", 28)))]
    return _any(parts) + _bit((c("t2") - c("t1")) > (c("t3") - c("t2")), 29)


def _spread(x: Column) -> Column:
    x = x.cast("bigint").bitwiseAND(F.lit(0xFFFF))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.cast("bigint").bitwiseAND(F.lit(0x55555555))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton_encode(x: Column, y: Column) -> Column:
    """16 bits of each: those of ``x`` at the even places, those of ``y`` at the odd ones."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_decode(code: Column) -> tuple[Column, Column]:
    return _gather(code), _gather(F.shiftright(code, 1))


def hamming(x: Column, y: Column, bits: int = 64) -> Column:
    """Number of bits that differ, of two longs or, with ``bits=32``, two integers."""
    return F.bit_count(x.cast("bigint").bitwiseXOR(y.cast("bigint")).bitwiseAND(F.lit(-1 if bits == 64 else (1 << bits) - 1)))


def hamming_bits(x: Column, y: Column) -> Column:
    """The same for arrays of booleans, over their common length."""
    n = F.least(F.size(x), F.size(y))
    pairs = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: (a != b).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, b: s + F.coalesce(b, F.lit(0)))
