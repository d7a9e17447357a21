"""The evidence file: identity, guards against change and against being written to, digests."""

from __future__ import annotations

import hashlib
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from . import dialect as dialects
from . import files, records


@dataclass(frozen=True)
class SourceId:
    """What tells a file from a changed one, whatever its path."""

    size: int
    mtime_secs: int
    mtime_nanos: int

    @classmethod
    def of(cls, path: str | Path) -> SourceId:
        size, changed = files.status(path)
        return cls(size, changed // 10**9, changed % 10**9)

    def json(self) -> dict:
        return asdict(self)


class SourceChanged(RuntimeError):
    """The file is not the one that was opened."""


class Source:
    """A regular file, opened for reading only: a path, or a URI such as ``hdfs://`` or ``s3://`` that the executors reach as well."""

    def __init__(self, path: str | Path):
        self.path = str(path) if files.is_remote(path) else Path(path)
        self.id = SourceId.of(self.path)

    @property
    def name(self) -> str:
        return str(self.path).rstrip("/").rpartition("/")[2]

    @property
    def size(self) -> int:
        return self.id.size

    def read_at(self, offset: int, length: int) -> bytes:
        with files.opened(self.path) as f:
            f.seek(offset)
            return f.read(length)

    def head(self) -> bytes:
        return self.read_at(0, dialects.HEAD_BYTES)

    def sniff(self) -> dialects.Sniff:
        return dialects.sniff(self.head(), self.size)

    def ensure_unchanged(self) -> None:
        if SourceId.of(self.path) != self.id:
            raise SourceChanged(f"{self.path} changed while it was in use")

    def guard(self, *targets: str | Path | None) -> None:
        """Raises if writing to a target, or to a temporary file beside it, would touch the source."""
        for target in filter(None, targets):
            for path in (Path(target), temporary(target)):
                own = Path(str(self.path).removeprefix("file://"))
                same = path.exists() and own.exists() and os.path.samefile(path, own)
                if same or files.real(path) == files.real(own):
                    raise ValueError(f"{path} is the source: it is never written to")

    def header(self, dialect: dialects.Dialect, scan_start: int = 0) -> list[str] | None:
        """Names in the first record, or None without a header."""
        if not dialect.header:
            return None
        head = self.head()[scan_start:]
        first = next(records.iterate(head, *dialect.parts), None)
        return [f.decode(errors="replace") for f in records.split_fields(head[first.start : first.end], *dialect.parts)] if first else []

    def digest(self, algorithms: tuple[str, ...] = ("sha256",), chunk: int = 8 << 20) -> dict[str, str | None]:
        """Digests of the whole file, read once.  BLAKE3 is given if its package is installed, else None."""
        known: dict = {}
        for name in algorithms:
            if name == "sha256":
                known[name] = hashlib.sha256()
            elif name == "blake3":
                try:
                    from blake3 import blake3
                except ImportError:
                    known[name] = None
                else:
                    known[name] = blake3()
            else:
                raise ValueError(f"unknown digest {name!r}")
        with files.opened(self.path) as f:
            while block := f.read(chunk):
                for h in filter(None, known.values()):
                    h.update(block)
        return {name: h and h.hexdigest() for name, h in known.items()}


def temporary(target: str | Path) -> Path:
    """Where a file is written before it takes its name."""
    target = Path(target)
    return target.with_name(f".{target.name}.partial")
