"""Evidence where it lies: a path of this machine, or a URI of a store that all executors reach."""

from __future__ import annotations

import os
import stat
from pathlib import Path
from typing import BinaryIO


def is_remote(place: str | Path) -> bool:
    return "://" in str(place)


def opened(place: str | Path) -> BinaryIO:
    """The file, opened for reading; it can be sought in."""
    if not is_remote(place):
        return open(place, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(str(place))
    return store.open_input_file(path)


def status(place: str | Path) -> tuple[int, int]:
    """Size and time of change in nanoseconds; raises unless it is a regular file."""
    if not is_remote(place):
        s = os.stat(place)
        if not stat.S_ISREG(s.st_mode):
            raise ValueError(f"{place} is not a regular file")
        return s.st_size, s.st_mtime_ns
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(str(place))
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        raise ValueError(f"{place} is not a regular file")
    return info.size, info.mtime_ns or 0


def real(place: str | Path) -> str:
    """What a file is known by."""
    return str(place) if is_remote(place) else os.path.realpath(place)
