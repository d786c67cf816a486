"""Packed bit vectors: arrays of 32-bit words in bigints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(x + F.lit(0.5))


def pack(bit: Callable[[Column], Column], n: int) -> Column:
    """Words of ``n`` bits; ``bit(k)`` says whether bit ``k`` is set."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(first: int) -> Column:
        places = F.sequence(F.lit(first), F.lit(min(first + 32, n) - 1))
        return F.aggregate(places, none, lambda acc, k: acc + F.when(bit(k), F.call_function("shiftleft", one, k - first)).otherwise(none))

    return F.array(*[word(w) for w in range(0, n, 32)])


def pack_text(bits: Column) -> Column:
    """Words of a text of '0' and '1'."""
    n = F.length(bits)
    words = F.sequence(F.lit(0), F.greatest(F.ceil(n / 32).cast("int") - 1, F.lit(0)))
    return F.when(n > 0, F.transform(words, lambda w: F.conv(F.reverse(F.substring(bits, w * 32 + 1, F.lit(32))), 2, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def bit_sim(a: Column, b: Column, bits: Column | int | None = None) -> Column:
    """Share of equal bits; null if a side is missing or lengths differ."""
    n = F.size(a) * 32 if bits is None else bits
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), 1 - hamming(a, b) / n)


def char_sim(a: Column, b: Column) -> Column:
    """Share of places with equal characters, by the length of ``a``; 0 if
    either text is missing or empty."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), same / F.length(a)).otherwise(F.lit(0.0))
