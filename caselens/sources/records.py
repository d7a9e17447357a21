"""Records and fields of delimited text, by one regular expression each.

A quote opens a quoted field only at a field's start; inside, a doubled quote
is one; after the closing quote the rest up to the delimiter is literal.  LF,
CR and CRLF end a record, empty lines are skipped, and the last record needs no
terminator.  Repetitions are possessive, so matching is linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Span:
    """A record: its bytes are ``start:end`` of what was scanned, without the terminator."""

    ordinal: int
    start: int
    end: int
    fields: int
    unterminated: bool
    lenient: bool


@lru_cache(maxsize=32)
def patterns(delimiter: bytes, quote: bytes | None) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of a record (after skipped terminators) and of a field with what follows it."""
    d = re.escape(delimiter)
    plain = rb"[^" + d + rb"\r\n]*+"
    if quote is None:
        body = plain
    else:
        q = re.escape(quote)
        body = rb"(?:" + q + rb"(?:[^" + q + rb"]|" + q + q + rb")*+(?:" + q + plain + rb"|\Z)|" + plain + rb")"
    record = re.compile(rb"[\r\n]*+(?!\Z)(" + body + rb"(?:" + d + body + rb")*+)")
    one = re.compile(rb"(" + body + rb")(" + d + rb"|\Z|(?=[\r\n]))")
    return record, one


def raw_fields(record: bytes, delimiter: bytes = b",", quote: bytes | None = b'"') -> list[bytes]:
    """Fields of one record as they stand, quotes included."""
    one = patterns(delimiter, quote)[1]
    out, at = [], 0
    while True:
        found = one.match(record, at)
        out.append(found[1])
        if not found[2]:
            return out
        at = found.end()


def unquote(raw: bytes, quote: bytes | None) -> tuple[bytes, bool, bool]:
    """A field's value, and whether its quote was never closed or followed by more text."""
    if quote is None or not raw.startswith(quote):
        return raw, False, False
    i, parts = 1, []
    while True:
        end = raw.find(quote, i)
        if end < 0:
            return b"".join([*parts, raw[i:]]), True, False
        parts.append(raw[i:end])
        if raw[end + 1 : end + 2] != quote:
            rest = raw[end + 1 :]
            return b"".join([*parts, rest]), False, bool(rest)
        parts.append(quote)
        i = end + 2


def split_fields(record: bytes, delimiter: bytes = b",", quote: bytes | None = b'"') -> list[bytes]:
    """Values of one record's fields."""
    if quote is None or quote not in record:
        return record.split(delimiter)
    return [unquote(raw, quote)[0] for raw in raw_fields(record, delimiter, quote)]


def nth_field(record: bytes, k: int, delimiter: bytes = b",", quote: bytes | None = b'"') -> bytes | None:
    """One value, or None where the record is too short."""
    fields = split_fields(record, delimiter, quote)
    return fields[k] if k < len(fields) else None


def write_field(value: bytes, delimiter: bytes = b",", quote: bytes | None = b'"') -> bytes:
    """A value as a field, quoted only where it has to be."""
    if quote is None or not any(c in value for c in (delimiter, quote, b"\n", b"\r")):
        return value
    return quote + value.replace(quote, quote * 2) + quote


def iterate(data: bytes, delimiter: bytes = b",", quote: bytes | None = b'"', start: int = 0, ordinal: int = 0) -> Iterator[Span]:
    """All records of bytes that begin at a record's start."""
    record = patterns(delimiter, quote)[0]
    for found in record.finditer(data, start):
        text = found[1]
        if not text and found.end() == len(data):  # nothing but terminators was left
            continue
        if quote is None or quote not in text:
            yield Span(ordinal, *found.span(1), text.count(delimiter) + 1, False, False)
        else:
            marks = [unquote(raw, quote)[1:] for raw in raw_fields(text, delimiter, quote)]
            yield Span(ordinal, *found.span(1), len(marks), any(m[0] for m in marks), any(m[1] for m in marks))
        ordinal += 1


def scan_all(data: bytes, delimiter: bytes = b",", quote: bytes | None = b'"') -> list[Span]:
    return list(iterate(data, delimiter, quote))


# -- boundaries of chunks -------------------------------------------------

#: where a scan may stand between two bytes
RECORD_START, AFTER_CR, FIELD_START, IN_FIELD, QUOTED, AFTER_QUOTE = range(6)


@lru_cache(maxsize=32)
def _tokens(delimiter: bytes, quote: bytes | None) -> re.Pattern:
    special = re.escape(delimiter) + rb"\r\n" + (re.escape(quote) if quote else b"")
    return re.compile(rb"[" + special + rb"]|[^" + special + rb"]+")


def transitions(chunk: bytes, delimiter: bytes = b",", quote: bytes | None = b'"') -> list[tuple[int, int, int]]:
    """For each state before the chunk: the state after it, the records that end in it, and where the first new record begins.

    Vectors of neighbouring chunks compose, so chunks are scanned apart and
    every chunk's state and first ordinal follow from those before it.  The
    last number is -1 if no record begins in the chunk.
    """
    out: dict[int, tuple[int, int, int]] = {}
    pending = {s: (s, 0, -1) for s in range(6)}
    at = 0
    for token in _tokens(delimiter, quote).findall(chunk):
        merged: dict[tuple[int, int, int], list[int]] = {}
        for s, key in pending.items():
            merged.setdefault(key, []).append(s)
        for key, starts in merged.items():
            new = _step(key, token, at, delimiter, quote)
            for s in starts:
                pending[s] = new
        at += len(token)
    out.update(pending)
    return [out[s] for s in range(6)]


def _step(key: tuple[int, int, int], token: bytes, at: int, delimiter: bytes, quote: bytes | None) -> tuple[int, int, int]:
    state, ended, first = key
    if state == AFTER_CR:  # a line feed here belongs to the terminator before it
        state = RECORD_START
        if token == b"\n":
            return state, ended, first
    if state == QUOTED:
        return (AFTER_QUOTE if token == quote else QUOTED), ended, first
    if state == AFTER_QUOTE:
        if token == quote:
            return QUOTED, ended, first
        state = IN_FIELD
    if token in (b"\n", b"\r"):
        after = AFTER_CR if token == b"\r" else RECORD_START
        return after, ended + (state != RECORD_START), first
    if state == RECORD_START and first < 0:
        first = at
    if token == quote and state in (RECORD_START, FIELD_START):
        return QUOTED, ended, first
    return (FIELD_START if token == delimiter else IN_FIELD), ended, first
