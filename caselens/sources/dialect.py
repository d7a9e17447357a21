"""Dialects of delimited text, and how to tell them from a file's first bytes."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import asdict, dataclass, replace

from . import records

CANDIDATES = ",\t;|"
SAMPLE_RECORDS = 256
HEAD_BYTES = 1 << 20
_BOMS = ((b"\xef\xbb\xbf", "utf8"), (b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be"))


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str | None = '"'
    header: bool = True

    def json(self) -> dict:
        return asdict(self)

    @property
    def parts(self) -> tuple[bytes, bytes | None]:
        return self.delimiter.encode(), self.quote.encode() if self.quote else None


@dataclass(frozen=True)
class Sniff:
    dialect: Dialect
    bom: str
    scan_start: int
    field_count: int
    consistency: float
    sampled_records: int


def bom_of(head: bytes) -> tuple[str, int]:
    """Name and length of a byte order mark."""
    return next(((name, len(mark)) for mark, name in _BOMS if head.startswith(mark)), ("none", 0))


def _sampled(sample: bytes, dialect: Dialect, truncated: bool) -> list[records.Span]:
    """The first records; the last one of a cut-off sample does not vote unless its terminator is there."""
    spans = list(itertools.islice(records.iterate(sample, *dialect.parts), SAMPLE_RECORDS))
    if spans and truncated and len(spans) < SAMPLE_RECORDS and spans[-1].end == len(sample):
        spans.pop()
    return spans


def _looks_like_data(value: bytes) -> bool:
    """Values that hardly ever name a column: numbers, dotted quads, dates, long hex."""
    digits = sum(48 <= b <= 57 for b in value)
    if not digits:
        return False
    return bool(
        re.fullmatch(rb"[0-9.+\-eE]+", value) and 2 * digits >= len(value)
        or re.fullmatch(rb"[0-9]*(?:\.[0-9]*){3}", value)
        or len(value) >= 8 and re.match(rb"[0-9]{4}[-/]", value)
        or re.fullmatch(rb"[0-9a-fA-F]{32,}", value)
    )


def _has_header(sample: bytes, dialect: Dialect, truncated: bool) -> bool:
    spans = _sampled(sample, dialect, truncated)
    if not spans:
        return False
    first = records.split_fields(sample[spans[0].start : spans[0].end], *dialect.parts)
    return all(first) and len(set(first)) == len(first) and not any(map(_looks_like_data, first))


def sniff(head: bytes, size: int) -> Sniff:
    """The dialect that splits the head most evenly.

    Ranked by: several fields at all; share of records with the most frequent
    number of fields; quotes that behave; more records; more fields.  Equal
    candidates keep the earlier one.
    """
    bom, start = bom_of(head)
    sample, truncated = head[start:], len(head) < size
    best, chosen = None, None
    for delimiter, quote in itertools.product(CANDIDATES, ('"', None)):
        dialect = Dialect(delimiter, quote)
        spans = _sampled(sample, dialect, truncated)
        counts = Counter(s.fields for s in spans)
        fields, votes = max(counts.items(), key=lambda c: (c[1], c[0]), default=(0, 0))
        share = votes / len(spans) if spans else 0.0
        healthy = quote is not None and not any(s.lenient or s.unterminated for s in spans)
        rank = (bool(spans) and fields >= 2, int(share * 1000 + 0.5), healthy, len(spans), fields)
        if best is None or rank > best:
            best, chosen = rank, (dialect, fields, share, len(spans))
    dialect, fields, share, n = chosen
    if not n or fields < 2:
        dialect = Dialect()
    return Sniff(replace(dialect, header=_has_header(sample, dialect, truncated)), bom, start, fields, share, n)


def delimiter_of(text: str) -> str:
    """A delimiter as given on a command line."""
    named = {"tab": "\t", "\\t": "\t"}.get(text, text)
    if len(named.encode()) != 1:
        raise ValueError(f"the delimiter {text!r} is not one byte")
    return named
