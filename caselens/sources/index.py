"""Record index of a file: where splits begin, at which ordinal, and statistics.

The file is cut into byte chunks.  A Spark job scans each chunk for all states
the scan may be in before it; composing the results gives each chunk's true
state, so splits and their first ordinals are known without reading the file in
one piece.  The sidecar is JSON with a digest of its own, bound to the source's
identity and the dialect.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from . import files, records
from .dialect import Dialect
from .evidence import Source, temporary

VERSION = 1
CHUNK_BYTES = 8 << 20
#: files up to this size are one split, without a job to find it
SMALL_BYTES = 8 << 20


@dataclass(frozen=True)
class Split:
    """Records that begin in ``start:end``; ``start`` is the first one's, ``ordinal`` its number (header excluded)."""

    start: int
    end: int
    ordinal: int


@dataclass
class Stats:
    records: int = 0
    expected_fields: int = 0
    field_mismatches: int = 0
    lenient_quotes: int = 0
    unterminated_quotes: int = 0
    max_record_bytes: int = 0
    complete: bool = False


@dataclass
class Index:
    source: dict
    dialect: dict
    scan_start: int
    splits: list[Split]
    stats: Stats = field(default_factory=Stats)
    digests: dict = field(default_factory=dict)

    def locate(self, record: int) -> Split | None:
        """The last split that begins at or before a record."""
        return next((s for s in reversed(self.splits) if s.ordinal <= record), None)

    def matches(self, source: Source, dialect: Dialect, scan_start: int) -> bool:
        return self.source == source.id.json() and self.dialect == dialect.json() and self.scan_start == scan_start

    def save(self, path: str | Path) -> None:
        body = json.dumps({"caselens_index": VERSION, **{k: v for k, v in asdict(self).items()}}, sort_keys=True)
        part = temporary(path)
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        part.write_text(body + "\n" + hashlib.sha256(body.encode()).hexdigest() + "\n")
        os.replace(part, path)

    @classmethod
    def load(cls, path: str | Path) -> Index:
        body, _, digest = Path(path).read_text().rstrip("\n").rpartition("\n")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise ValueError(f"{path} is damaged")
        held = json.loads(body)
        if held.pop("caselens_index") != VERSION:
            raise ValueError(f"{path} has another version")
        held["splits"] = [Split(**s) for s in held["splits"]]
        held["stats"] = Stats(**held["stats"])
        return cls(**held)


def _compose(source_size: int, scan_start: int, chunk: int, vectors: list[list[tuple[int, int, int]]], header: bool) -> list[Split]:
    state, ended, splits = records.RECORD_START, 0, []
    begun = 0  # records that began before the chunk
    for k, vector in enumerate(vectors):
        after, ends, first = vector[state]
        if first >= 0:
            splits.append((scan_start + k * chunk + first, begun))
        ended += ends
        state = after
        begun = ended + (state not in (records.RECORD_START, records.AFTER_CR))
    starts = [s for s, _ in splits] + [source_size]
    return [Split(start, starts[k + 1], ordinal - header) for k, (start, ordinal) in enumerate(splits)]


def plan_splits(spark: SparkSession, source: Source, dialect: Dialect, scan_start: int = 0, chunk: int = CHUNK_BYTES) -> list[Split]:
    """Splits of the file, in order; the header record is part of the first one, with ordinal -1."""
    size = source.size - scan_start
    if size <= 0:
        return []
    path, parts = str(source.path), dialect.parts

    def vector(k: int) -> list[tuple[int, int, int]]:
        with files.opened(path) as f:
            f.seek(scan_start + k * chunk)
            return records.transitions(f.read(chunk), *parts)

    n = -(-size // chunk)
    if size <= SMALL_BYTES and n == 1:
        return _compose(source.size, scan_start, chunk, [vector(0)], dialect.header)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column("id").to_pylist():
                flat = [x for state in vector(k) for x in state]
                yield pa.RecordBatch.from_pydict({"k": [k], "v": pa.array([flat], pa.list_(pa.int64()))})

    rows = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "k long, v array<long>").collect()
    flat = {r.k: r.v for r in rows}
    vectors = [[tuple(flat[k][3 * s : 3 * s + 3]) for s in range(6)] for k in range(n)]
    return _compose(source.size, scan_start, chunk, vectors, dialect.header)


def bootstrap(source: Source, dialect: Dialect, scan_start: int = 0) -> Index:
    """An index that knows only where the records begin and how wide the first one is."""
    head = source.head()[scan_start:]
    first = next(records.iterate(head, *dialect.parts), None)
    fields = first.fields if first else 0
    splits = [Split(scan_start, source.size, -int(dialect.header))] if first else []
    return Index(source.id.json(), dialect.json(), scan_start, splits, Stats(expected_fields=fields))


def cache_folder() -> Path:
    return Path(os.environ.get("CASELENS_CACHE") or Path.home() / ".cache" / "caselens")


def sidecar_path(source: Source, dialect: Dialect, suffix: str = "index.json") -> Path:
    """Where a file's sidecar is kept: by path and dialect."""
    key = json.dumps([files.real(source.path), dialect.json()])
    return cache_folder() / f"{hashlib.sha256(key.encode()).hexdigest()[:32]}.{suffix}"
