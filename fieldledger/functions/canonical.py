"""Canonical JSON, digests and fixed-point numbers, as Python functions and as column expressions."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timezone
from decimal import ROUND_HALF_EVEN, Context, Decimal
from fractions import Fraction
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SCALE = 10
UNIT = 10**SCALE
_STEP = Decimal(1).scaleb(-SCALE)


#: What may stand in hashed text beside objects, arrays and decimals. No float has one true text.
_PLAIN = (str, int, type(None))


def _unfit(value: object) -> Iterator[str]:
    """Where and why value has no canonical form."""
    todo = [("$", value)]
    while todo:
        path, part = todo.pop()
        if isinstance(part, Mapping):
            yield from (f"{path}: the key {k!r} is not text" for k in part if not isinstance(k, str))
            todo += [(f"{path}.{k}", v) for k, v in part.items()]
        elif isinstance(part, (list, tuple)):
            todo += [(f"{path}[{i}]", v) for i, v in enumerate(part)]
        elif isinstance(part, Decimal):
            if part.as_tuple().exponent != -SCALE:
                yield f"{path}: {part} does not have {SCALE} places"
        elif not isinstance(part, _PLAIN):
            yield f"{path}: {type(part).__name__}"


def _written(part: Decimal | Mapping) -> str | dict:
    return f"{part:f}" if isinstance(part, Decimal) else dict(part)


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=_written)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, text as it is, decimals as text with ten places; the bytes that every digest covers."""
    if faults := sorted(_unfit(value)):
        raise TypeError("no canonical form: " + "; ".join(faults))
    return _ENCODER.encode(value)


def digest(text: str) -> str:
    return sha256(text.encode("utf-8")).hexdigest()


def seal(body: object) -> str:
    return digest(canonical_json(body))


#: How each exact kind of number becomes a decimal. Fractions are divided in 28 digits, so they
#: are rounded twice; digests depend on that.
_DIGITS = Context(prec=28, rounding=ROUND_HALF_EVEN)
_EXACT = {int: Decimal, Decimal: Decimal, Fraction: lambda f: _DIGITS.divide(Decimal(f.numerator), Decimal(f.denominator))}


def quantize(value: Fraction | Decimal | int) -> Decimal:
    """To ten places, halves to even."""
    if type(value) not in _EXACT:
        raise TypeError(f"{type(value).__name__} cannot be quantized")
    return _DIGITS.quantize(_EXACT[type(value)](value), _STEP)


def quantize_vector(values: Iterable[float | int | Decimal | str]) -> list[Decimal]:
    """A vector in fixed point; floats count with their exact binary value."""
    out = []
    for v in values:
        if isinstance(v, bool):
            raise TypeError("a component cannot be a truth value")
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError("a component must be finite")
            v = Fraction(v)
        out.append(quantize(Decimal(v) if isinstance(v, str) else v))
    if not out:
        raise ValueError("a vector needs a component")
    return out


def vector_json(values: Iterable[Decimal | str]) -> str:
    return canonical_json({"v": [v if isinstance(v, str) else format(v, "f") for v in values]})


def format_ts(at: datetime) -> str:
    if at.tzinfo is None:
        raise ValueError("an instant needs a time zone")
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00")


def now_ts() -> str:
    return format_ts(datetime.now(timezone.utc))


# --- columns -------------------------------------------------------------------------------

_NAMED = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(column: str | Column) -> Column:
    """A string column as a JSON string. to_json will not do: it writes control characters in
    upper-case hexadecimal digits."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_NAMED.get(chr(code), f"\\u{code:04x}")))
    plain = ~c.rlike(r'[\x00-\x1f"\\]')
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(out), F.lit('"'))


def json_object(**members: Column) -> Column:
    """An object from columns that hold JSON text, its keys in canonical order."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(members)):
        parts += [F.lit(("{" if i == 0 else ",") + json.dumps(key) + ":"), members[key]]
    return F.concat(*parts, F.lit("}"))


def json_array(items: Column) -> Column:
    """An array of JSON texts as a JSON array."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def sha256_hex(column: str | Column) -> Column:
    return F.sha2(column, 256)


def is_canonical_text(text: str | None) -> bool:
    """Whether the text is valid JSON in canonical form."""
    try:
        return text is not None and canonical_json(json.loads(text)) == text
    except (ValueError, TypeError):
        return False


@F.pandas_udf(BooleanType())
def is_canonical(stored: pd.Series) -> pd.Series:
    return stored.map(is_canonical_text)
