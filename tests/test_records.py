"""Record and field splitting against a byte-by-byte automaton."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselens.operators.frames import FIELDS, ORDINAL, RAW
from caselens.sources import index, reader, records
from caselens.sources.dialect import Dialect, sniff
from caselens.sources.evidence import Source


def plain(data: bytes, delimiter: int = 44, quote: int | None = 34) -> list[tuple]:
    """Records, fields and flags, one byte at a time."""
    out, i, n = [], 0, len(data)
    while i < n:
        if data[i] in b"\r\n":
            i += 1
            continue
        start, fields, lenient, unterminated = i, [], False, False
        while True:
            value = bytearray()
            if quote is not None and i < n and data[i] == quote:
                i += 1
                closed = False
                while i < n:
                    if data[i] == quote:
                        if i + 1 < n and data[i + 1] == quote:
                            value.append(quote)
                            i += 2
                            continue
                        closed = True
                        i += 1
                        break
                    value.append(data[i])
                    i += 1
                unterminated |= not closed
                tail = i
                while i < n and data[i] != delimiter and data[i] not in b"\r\n":
                    value.append(data[i])
                    i += 1
                lenient |= i > tail
            else:
                while i < n and data[i] != delimiter and data[i] not in b"\r\n":
                    value.append(data[i])
                    i += 1
            fields.append(bytes(value))
            if i < n and data[i] == delimiter:
                i += 1
                continue
            break
        out.append((start, i, fields, lenient, unterminated))
    return out


def got(data: bytes, quote: bytes | None = b'"') -> list[tuple]:
    return [(s.start, s.end, records.split_fields(data[s.start : s.end], b",", quote), s.lenient, s.unterminated) for s in records.iterate(data, b",", quote)]


TORTURE = [
    b"", b"\n", b"\r\n\r\n", b"a", b"a,b", b"a,b\n", b"a,b\r\nc,d", b"a\rb\nc\r\nd", b"\n\na\n\n\nb\n", b",", b",,\n,", b'"a"', b'"a,b",c', b'"a\nb",c\nd', b'"a""b"', b'""', b'"",""',
    b'"', b'"a', b'"a\n', b'"a"b,c', b'"a"b"c,d\ne', b'a"b,c', b'a,"b', b'"a" ,b', b"a,b,\n", b'"\r\n"\r\n"x"', b"a\r", b"\ra", b'x,"y""z"w\n1', "é,日本\n\"ü\"".encode(),
]


@pytest.mark.parametrize("data", TORTURE)
def test_torture(data):
    assert got(data) == plain(data)
    assert got(data, None) == plain(data, quote=None)


@settings(max_examples=600, deadline=None)
@given(st.binary(max_size=39).map(lambda b: bytes(b'ab,"\n\r '[x % 7] for x in b)))
def test_random(data):
    assert got(data) == plain(data)
    for s in records.iterate(data):
        assert s.fields == len(records.raw_fields(data[s.start : s.end]))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60).map(lambda b: bytes(b'ab,"\n\r'[x % 6] for x in b)), st.integers(1, 7), st.booleans())
def test_any_chunk_size_gives_the_same_splits(data, chunk, header):
    vectors = [records.transitions(data[k : k + chunk]) for k in range(0, len(data), chunk)]
    splits = index._compose(len(data), 0, chunk, vectors, header)
    want = [(k - header, a, b) for k, (a, b, *_) in enumerate(plain(data))]
    found = [(s.ordinal, split.start + s.start, split.start + s.end) for split in splits for s in records.iterate(data[split.start : split.end], ordinal=split.ordinal)]
    assert found == want


def test_write_field_round_trip():
    rng = random.Random(1)
    for _ in range(500):
        values = [bytes(rng.choice(b'a",\n\r ') for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 5))]
        line = b",".join(map(records.write_field, values))
        assert records.split_fields(line) == values
    assert records.nth_field(b"a,b", 1) == b"b" and records.nth_field(b"a,b", 2) is None


def test_reader_with_tiny_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    for trial in range(3):
        data = b"id,text,note\n" + bytes(rng.choice(b'abc,,"\n\r\n ') for _ in range(700))
        path = tmp_path / f"{trial}.csv"
        path.write_bytes(data)
        monkeypatch.setattr(reader, "BLOCK_BYTES", 64)
        source, dialect = Source(path), Dialect()
        splits = index.plan_splits(spark, source, dialect, 0, 97)
        df = reader.evidence(spark, source, dialect, splits)
        want = plain(data)[1:]
        rows = df.orderBy(ORDINAL).collect()
        assert [(r._start, r._end, [bytes(f) for f in r[FIELDS]], r._lenient, r._unterminated) for r in rows] == want
        assert [bytes(r[RAW]) for r in rows] == [data[a:b] for a, b, *_ in want]
        some = reader.evidence(spark, source, dialect, splits, (10, 15)).orderBy(ORDINAL).collect()
        assert [r[ORDINAL] for r in some] == list(range(10, 15))


def test_bounds_drop_splits():
    splits = [index.Split(0, 10, -1), index.Split(10, 20, 5), index.Split(20, 30, 9)]
    at = lambda a, b: [s.ordinal for s in reader.covering(splits, a, b)]
    assert at(6, 9) == [5] and at(0, 5) == [-1] and at(4, 10) == [-1, 5, 9] and at(50, 60) == [9] and at(0, 0) == [-1]


@pytest.mark.parametrize(
    ("data", "delimiter", "quote", "header"),
    [
        (b"a,b\n1,2\n3,4\n", ",", '"', True),
        (b"a\tb\n1\t2\n", "\t", '"', True),
        (b'id;text\n1;"x;y"\n2;z\n', ";", '"', True),
        (b"\xef\xbb\xbfa|b\n1|2\n", "|", '"', True),
        (b"1,2\n3,4\n", ",", '"', False),
        (b"a,a\nx,y\n", ",", '"', False),
        (b'id,note\n1,"open\n2,"x\n3,y\n', ",", None, True),
        (b"", ",", '"', False),
        (b"one\ntwo\n", ",", '"', True),
        (b"2026-01-01,x\n", ",", '"', False),
    ],
)
def test_sniff(data, delimiter, quote, header):
    found = sniff(data, len(data))
    assert (found.dialect.delimiter, found.dialect.quote, found.dialect.header) == (delimiter, quote, header)
    assert found.scan_start == (3 if data.startswith(b"\xef") else 0)


def test_truncated_tail_does_not_vote():
    data = b"a,b,c\n1,2,3\n4,5"
    assert sniff(data, 1000).sampled_records == 2 and sniff(data, len(data)).sampled_records == 3
