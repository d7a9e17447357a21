"""Spark data source ``evidence_csv``: records of a delimited file with their ordinals and raw bytes.

Options: ``path``, ``delimiter``, ``quote`` (empty: none), ``scanStart``,
``splits`` (JSON rows of start, end, ordinal) and ``header``.  Every split
begins at a record, so it is read by itself.

Records are found by number through the splits (``evidence`` with bounds), not
by filter pushdown: a Python source keeps pushed filters with the loaded
relation, so a frame used twice in a query would get one side's filter on both.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.frames import FIELDS, ORDINAL, RAW, Frame
from . import index as indexes
from . import files, records
from .dialect import Dialect
from .evidence import Source

SCHEMA = f"{ORDINAL} bigint, _start bigint, _end bigint, _nfields int, _unterminated boolean, _lenient boolean, {RAW} binary, {FIELDS} array<binary>"
BATCH_RECORDS, BLOCK_BYTES = 8192, 4 << 20


class _Split(InputPartition):
    def __init__(self, start: int, end: int, ordinal: int):
        super().__init__(None)
        self.start, self.end, self.ordinal = start, end, ordinal


class EvidenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.delimiter = options.get("delimiter", ",").encode()
        self.quote = options.get("quote", '"').encode() or None
        self.splits = [_Split(*s) for s in json.loads(options["splits"])]

    def partitions(self) -> list[_Split]:
        return self.splits or [_Split(0, 0, 0)]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        # a split ends where the next one's first record begins, so it holds whole records
        with files.opened(self.path) as f:
            f.seek(partition.start)
            left, rest, base, ordinal = partition.end - partition.start, b"", partition.start, partition.ordinal
            while left or rest:
                block = f.read(min(max(BLOCK_BYTES, len(rest)), left))  # a record longer than a block is scanned few times over
                left -= len(block)
                data, last = rest + block, not left
                done = 0
                spans = records.iterate(data, self.delimiter, self.quote, 0, ordinal)
                held = next(spans, None)
                while held is not None:
                    following = next(spans, None)
                    if following is None and not last:  # the block may have cut it
                        break
                    raw = data[held.start : held.end]
                    rows.append((held.ordinal, base + held.start, base + held.end, held.fields, held.unterminated, held.lenient, raw, records.split_fields(raw, self.delimiter, self.quote)))
                    done, ordinal = held.end, held.ordinal + 1
                    held = following
                    if len(rows) >= BATCH_RECORDS:
                        yield _batch(rows)
                        rows = []
                if last:
                    break
                if done == 0 and held is None:  # terminators only
                    done = len(data)
                # a record may end where the block does; keep from its end on, terminator included
                rest, base = data[done:], base + done
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.list_(pa.binary()))
    names = (ORDINAL, "_start", "_end", "_nfields", "_unterminated", "_lenient", RAW, FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def covering(splits: list[indexes.Split], first: int, end: int) -> list[indexes.Split]:
    """The splits that may hold records ``first`` to ``end`` (exclusive)."""
    after = {s.start: following.ordinal for s, following in pairwise(splits)}
    return [s for s in splits if after.get(s.start, first + 1) > first and s.ordinal < end]


def evidence(spark: SparkSession, source: Source, dialect: Dialect, splits: list[indexes.Split], bounds: tuple[int, int] | None = None) -> DataFrame:
    """The evidence frame: ordinals, places, raw bytes and fields of every record, the header left out.

    With ``bounds`` (first record, end) only the splits that hold them are read.
    """
    spark.dataSource.register(EvidenceSource)
    rows = json.dumps([(s.start, s.end, s.ordinal) for s in (covering(splits, *bounds) if bounds else splits)])
    reader = spark.read.format("evidence_csv").option("path", str(source.path)).option("delimiter", dialect.delimiter).option("quote", dialect.quote or "")
    df = reader.option("splits", rows).load()
    first, end = bounds or (0, None)
    kept = F.col(ORDINAL) >= max(0, first)
    return df.where(kept if end is None else kept & (F.col(ORDINAL) < end))


def column_names(source: Source, dialect: Dialect, scan_start: int, width: int, names: list[str] | None = None) -> list[str]:
    """Header names, or given ones, with ``col{i}`` for what has none."""
    known = list(names or source.header(dialect, scan_start) or [])
    return known + [f"col{k}" for k in range(len(known), width)]


def wide(df: DataFrame, names: list[str], dialect: Dialect) -> Frame:
    """One text column a field; a missing field is null.  Of equal names the first keeps it, later ones get their number added."""
    used: list[str] = []
    for k, n in enumerate(names):
        while n in used or n in names[:k]:
            n = f"{n}_{k}"
        used.append(n)
    columns = [F.get(FIELDS, F.lit(k)).cast("string").alias(n) for k, n in enumerate(used)]
    kept = [ORDINAL, RAW, FIELDS, "_nfields", "_start", "_end", "_lenient", "_unterminated"]
    return Frame(df.select(*kept, *columns), tuple(used), delimiter=dialect.delimiter, quote=dialect.quote)


def stats(df: DataFrame, expected: int) -> indexes.Stats:
    """Statistics of all records in one aggregation."""
    row = df.agg(
        F.count("*"), F.sum(F.when(F.col("_nfields") != expected, 1).otherwise(0)), F.sum(F.col("_lenient").cast("int")),
        F.sum(F.col("_unterminated").cast("int")), F.max(F.col("_end") - F.col("_start")),
    ).first()
    return indexes.Stats(row[0], expected, *(v or 0 for v in row[1:]), complete=True)
