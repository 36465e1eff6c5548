"""What a service does to its input before anything else: texts are cut, numbers are kept in range, ids are checked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HOPS_RANGE, MAX_ID, MAX_TEXT, TOP_K_RANGE


def cut_text(column: str | Column, limit: int = MAX_TEXT) -> Column:
    """A text of more than limit characters keeps one less than limit, and three dots follow."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("..."))).otherwise(c)


def cut(text: str, limit: int = MAX_TEXT) -> str:
    return text if len(text) <= limit else text[: limit - 1] + "..."


def in_range(top_k: int, hops: int) -> tuple[int, int]:
    """top_k and hops as a service takes them."""
    return tuple(max(low, min(int(n), high)) for n, (low, high) in ((top_k, TOP_K_RANGE), (hops, HOPS_RANGE)))


def clean_id(value: str, name: str) -> str:
    """The identifier without blanks around it; empty and long ones are refused."""
    value = value.strip() if isinstance(value, str) else ""
    if not value:
        raise ValueError(f"{name} is empty")
    if len(value) > MAX_ID:
        raise ValueError(f"{name} has more than {MAX_ID} characters")
    return value
