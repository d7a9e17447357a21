"""Formatting and parsing of numbers for people, and CSV quoting as a Column."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def thousands(n: int) -> str:
    return f"{n:,}"


def binary_size(n: int) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def duration(s: float) -> str:
    if s < 1:
        return f"{s * 1000:.0f} ms"
    return f"{s:.2f} s" if s < 60 else f"{int(s // 60)} min {s % 60:.0f} s"


def size_of(text: str) -> int:
    """Bytes of a size such as ``64K``, ``1.5G`` or plain bytes."""
    found = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)(?:i?B)?", text.strip(), re.IGNORECASE)
    if not found:
        raise ValueError(f"invalid size {text!r}")
    return int(float(found[1]) * _UNITS[found[2].upper()])


def integer_of(text: str) -> int:
    """An integer that may have ``_`` or ``,`` between its digits."""
    return int(text.replace("_", "").replace(",", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, and stands once in the plan."""
    return F.transform(F.array(value), body)[0]


def quoted(column: Column, delimiter: str = ",", quote: str | None = '"') -> Column:
    """A field as CSV text: quoted only where it has to be.  Null is an empty field."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    if quote is None:
        return text
    needs = text.contains(delimiter) | text.contains(quote) | text.contains("\n") | text.contains("\r")
    return F.when(needs, F.concat(F.lit(quote), F.replace(text, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(text)
