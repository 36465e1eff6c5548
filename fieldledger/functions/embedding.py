"""A deterministic text embedding: no model, only digests; for tools and tests."""

from __future__ import annotations

from decimal import Decimal
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import quantize_vector

WIDTH = 384


def embed(text: str, width: int = WIDTH) -> list[Decimal]:
    """Component i is the head of sha256(sha256(text) || i) spread over -1 to 1."""
    start = sha256(text.encode("utf-8")).digest()
    heads = (sha256(start + i.to_bytes(2, "big")).digest()[:4] for i in range(width))
    return quantize_vector(int.from_bytes(h, "big") / 2147483647.5 - 1.0 for h in heads)


def embed_heads(text: str | Column, width: int = WIDTH) -> Column:
    """The unsigned 32-bit heads behind the components, inside the JVM: exact, before any float."""
    c = F.col(text) if isinstance(text, str) else text
    start = F.unhex(F.sha2(c, 256))
    index = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(index, lambda i: F.conv(F.substring(F.sha2(F.concat(start, F.unhex(F.lpad(F.hex(i), 4, "0"))), 256), 1, 8), 16, 10).cast("bigint"))


#: A double between -1 and 1 that is the difference of a double and 1 is a whole multiple of 2**-53.
FINE = 2**53
#: 10**10 / 2**53 as a fraction without common factor: FIVES / 2**43.
FIVES, SHIFT, LOW = 5**10, 43, 27


def units(component: Column) -> Column:
    """A whole multiple of 2**-53 between -1 and 1 in units of 10**-10, halves to even; exact, in 64-bit integers.

    With k = component * 2**53 it is k * FIVES / 2**43. The product has up to 77 bits, so k is split
    at LOW bits; the two products are put together again as a quotient and a rest of 43 bits.
    """
    k = (component * F.lit(float(FINE))).cast("bigint")
    low = k.bitwiseAND(F.lit((1 << LOW) - 1)) * FIVES
    high = F.shiftright(k, LOW) * FIVES + F.shiftright(low, LOW)
    kept = SHIFT - LOW
    whole = F.shiftright(high, kept)
    rest = F.shiftleft(high.bitwiseAND(F.lit((1 << kept) - 1)), LOW) + low.bitwiseAND(F.lit((1 << LOW) - 1))
    half = 1 << (SHIFT - 1)
    return whole + F.when((rest > half) | ((rest == half) & (whole.bitwiseAND(F.lit(1)) == 1)), 1).otherwise(0)


def embedded(text: str | Column, width: int = WIDTH) -> Column:
    """The vector of ``embed`` in units of 10**-10, an array of whole numbers, without leaving the JVM."""
    return F.transform(embed_heads(text, width), lambda h: units(h.cast("double") / F.lit(2147483647.5) - F.lit(1.0)))


#: What tells the components of a text apart: their numbers as two bytes.
_NUMBERS = [i.to_bytes(2, "big") for i in range(1 << 16)]


def _units_of(heads: np.ndarray) -> np.ndarray:
    """``units`` of the components behind unsigned heads, in the same whole numbers."""
    k = ((heads.astype(np.float64) / 2147483647.5 - 1.0) * float(FINE)).astype(np.int64)
    low = (k & ((1 << LOW) - 1)) * FIVES
    high = (k >> LOW) * FIVES + (low >> LOW)
    kept = SHIFT - LOW
    whole = high >> kept
    rest = ((high & ((1 << kept) - 1)) << LOW) + (low & ((1 << LOW) - 1))
    half = 1 << (SHIFT - 1)
    return whole + ((rest > half) | ((rest == half) & (whole & 1 == 1)))


def embedded_texts(text: Column, width: int = WIDTH) -> Column:
    """The vector of ``embedded`` as text, its numbers joined by commas. Texts stay in the JVM; only their digests go to
    Python, in batches, where a component costs one call of the platform's SHA-256."""
    numbers = _NUMBERS[:width]

    @F.pandas_udf("string")
    def vectors(digests: pd.Series) -> pd.Series:
        def one(start: bytes) -> str:
            heads = np.frombuffer(b"".join([sha256(start + n).digest()[:4] for n in numbers]), ">u4")
            return ",".join(map(str, _units_of(heads).tolist()))

        return digests.map(lambda hexed: None if hexed is None else one(bytes.fromhex(hexed)))

    return vectors(F.sha2(text, 256))
