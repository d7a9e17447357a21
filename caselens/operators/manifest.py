"""Provenance manifests of exports, and their verification."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import sys
from datetime import UTC, datetime
from pathlib import Path

from ..sources import files
from ..sources.evidence import Source, temporary

VERSION = 1
TOOL = {"name": "caselens", "version": "0.1.0"}


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def path_for(output: str | Path) -> Path:
    return Path(f"{output}.manifest.json")


def build(source: dict, operations: list[dict], selection: dict, output: dict) -> dict:
    tool = TOOL | {"platform": f"{sys.platform}-{platform.machine()}"}
    return {"caselens_manifest": VERSION, "created_at": now(), "tool": tool, "source": source, "operations": operations, "selection": selection, "output": output}


def source_entry(source: Source, dialect: dict, digests: dict, records: int, names: list[str] | None = None) -> dict:
    mtime = datetime.fromtimestamp(source.id.mtime_secs, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    entry = {
        "path": files.real(source.path), "name": source.name, "size": source.size, "sha256": digests.get("sha256"),
        "blake3": digests.get("blake3"), "mtime": mtime, "dialect": dialect, "records": records,
    }
    return entry | ({"names": names} if names else {})


def write(manifest: dict, path: str | Path) -> None:
    part = temporary(path)
    part.write_text(json.dumps(manifest, indent=2, ensure_ascii=False) + "\n")
    os.replace(part, path)


def read(path: str | Path) -> dict:
    held = json.loads(Path(path).read_text())
    if held.get("caselens_manifest") != VERSION:
        raise ValueError(f"{path} is no manifest of version {VERSION}")
    return held


def verify(output: str | Path, manifest_path: str | Path | None = None, source: str | Path | None = None, skip_source: bool = False, require_source: bool = False) -> dict:
    """Hashes the output, and the source if it is there, and compares both with the manifest.  Nothing is replayed."""
    manifest_path = Path(manifest_path or path_for(output))
    held = read(manifest_path)
    if Path(output).is_dir():  # parts of a dataset: the digest of their digests, by name
        parts = [Source(p) for p in sorted(Path(output).glob("part-*"))]
        got, size = hashlib.sha256("".join(p.digest()["sha256"] for p in parts).encode()).hexdigest(), sum(p.size for p in parts)
    else:
        written = Source(output)
        got, size = written.digest()["sha256"], written.size
    output_ok = held["output"]["sha256"] == got and held["output"]["size"] == size
    place, status, digest = source or held["source"]["path"], "skipped", None
    if not skip_source:
        status = "not found"
        if files.is_remote(place) or Path(place).exists():
            origin = Source(place)
            digest = origin.digest()["sha256"]
            status = "ok" if held["source"]["sha256"] == digest and held["source"]["size"] == origin.size else "MISMATCH"
    checked = status == "ok"
    return {
        "manifest": str(manifest_path),
        "output": {"path": str(output), "status": "ok" if output_ok else "MISMATCH", "sha256": got, "expected": held["output"]["sha256"]},
        "source": {"path": str(place), "status": status, "sha256": digest, "expected": held["source"]["sha256"]},
        "scope": "output+source" if checked else "output-only",
        "source_checked": checked,
        "ok": output_ok and status != "MISMATCH" and (checked or not require_source),
    }
