"""Exact vector arithmetic: scaled integers, dot products, and a binary sort key without rounding."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .canonical import UNIT, quantize

#: The ranking constants as whole numbers: a hop keeps 43/50, a resonant link adds 1/2, and a
#: reinforced memory counts 3/2. Over the common denominator 2 * 50**10 all are integers.
HOP_NUM, HOP_DEN, HOPS = 43, 50, 10
COMMON = 2 * HOP_DEN**HOPS
KEY_SHIFT, KEY_BYTES = 256, 96
SHARP = 10**30


def scaled(vector: str | Column) -> Column:
    """Float32 components as whole multiples of 10**-10, halves to even; exact for float32 input."""
    return F.transform(vector, lambda x: F.rint(x.cast("double") * F.lit(float(UNIT))).cast("bigint"))


def scaled_text(vector: str | Column) -> Column:
    """Fixed-point text components as whole multiples of 10**-10."""
    return F.transform(vector, lambda x: (x.cast("decimal(38,10)") * F.lit(UNIT)).cast("bigint"))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of whole numbers, as decimal(38,0)."""
    zero = F.lit(0).cast("decimal(38,0)")
    products = F.zip_with(a, b, lambda x, y: x.cast("decimal(19,0)") * y.cast("decimal(19,0)"))
    return F.aggregate(products, zero, lambda s, p: (s + p).cast("decimal(38,0)"))


def multiplier(state: str, hop: int, resonant: int) -> int:
    """The score's factor over COMMON."""
    h = max(hop, 0)
    boost = 3 if state == "REINFORCED" else 2
    return boost * HOP_NUM**h * HOP_DEN ** (HOPS - h) + resonant * HOP_DEN**HOPS


def rank_key(d: int, n: int, m: int) -> bytes:
    """Bytes that order like d**2 * m**2 / n, and are all zero unless d * m is positive.

    Two different such fractions differ by at least 1 over the product of their denominators,
    so the shift keeps them apart as long as no denominator has more than half its bits.
    """
    if d <= 0 or m <= 0:
        return bytes(KEY_BYTES)
    if 2 * n.bit_length() > KEY_SHIFT:
        raise OverflowError("the vector is too long for an exact key")
    return ((d * d * m * m << KEY_SHIFT) // n).to_bytes(KEY_BYTES, "big")


@F.pandas_udf(BinaryType())
def exact_key(d: pd.Series, n: pd.Series, state: pd.Series, hop: pd.Series, resonant: pd.Series) -> pd.Series:
    return pd.Series([rank_key(int(a), int(b), multiplier(s, int(h), int(k))) for a, b, s, h, k in zip(d, n, state, hop, resonant, strict=True)], dtype=object)


def root(value: Fraction) -> Fraction:
    """The square root to thirty places, rounded down; for display, at ten."""
    return Fraction(math.isqrt(math.floor(value * SHARP**2)), SHARP)


def display_score(d: int, n: int, n_query: int, m: int) -> Decimal:
    """The cosine times the factor m / COMMON, at ten places; d, n and n_query are in units of 10**-20."""
    if d * m <= 0:
        return quantize(0)
    return quantize(Fraction(d, UNIT**2) * Fraction(m, COMMON) / root(Fraction(n * n_query, UNIT**4)))
