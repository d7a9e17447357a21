"""Cached whole-file analyses: profiles, counts and timelines, beside the index.

A cache is bound to the source's identity, and to its digest when both sides
know one.  Counts of more values serve requests for fewer.  Selections and
derived columns are never cached.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from .sources.evidence import Source, temporary

VERSION = 1


class AnalysisCache:
    def __init__(self, source: Source, path: str | Path, sha256: str | None = None):
        self.source, self.path, self.sha256 = source, Path(path), sha256
        self.held: dict = {"profile": None, "counts": {}, "timelines": {}}
        try:
            stored = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return
        known = stored.get("sha256")
        if stored.get("caselens_cache") == VERSION and stored.get("source") == source.id.json() and (not sha256 or not known or sha256 == known):
            self.held = stored["held"]
            self.sha256 = sha256 or known

    def profile(self) -> dict | None:
        return self.held["profile"]

    def count(self, column: str, top: int) -> dict | None:
        found = self.held["counts"].get(column)
        if found is None or len(found["top"]) < min(top, found["distinct"]):
            return None
        return found | {"top": found["top"][:top]}

    def timeline(self, column: str, year: int, width: int | None) -> dict | None:
        found = self.held["timelines"].get(column)
        return found if found and found["year"] == year and width in (None, found["bucket_s"]) else None

    def put_profile(self, value: dict) -> None:
        self.held["profile"] = value

    def put_count(self, column: str, value: dict) -> None:
        self.held["counts"][column] = value

    def put_timeline(self, column: str, value: dict) -> None:
        self.held["timelines"][column] = value

    def save(self) -> None:
        self.source.ensure_unchanged()
        self.source.guard(self.path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = temporary(self.path)
        part.write_text(json.dumps({"caselens_cache": VERSION, "source": self.source.id.json(), "sha256": self.sha256, "held": self.held}))
        os.replace(part, self.path)
