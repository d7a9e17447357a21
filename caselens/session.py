"""An investigation of one evidence file: what a front end calls."""

from __future__ import annotations

import hashlib
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .cache import AnalysisCache
from .functions import redaction, timestamps
from .operators import counts, edits, enrich, export, manifest, profile, search, timeline
from .operators.frames import ORDINAL, RAW, Frame
from .operators.lineage import Selection
from .sources import index as indexes
from .sources import reader
from .sources.dialect import Dialect
from .sources.evidence import Source

HEAD_ROWS, TOP_VALUES, DESKTOP_BUCKETS = 1000, 500, 120


class Case:
    """An opened file: its dialect, index, frame, current selection, enrichment, redactions and edits."""

    def __init__(self, spark: SparkSession, path: str | Path, dialect: Dialect | None = None, names: list[str] | None = None, use_index: bool = True, index_path: str | Path | None = None, **overrides):
        self.spark = spark
        self.source = Source(path)
        self.sniffed = self.source.sniff()
        chosen = dialect or self.sniffed.dialect
        if names:
            overrides.setdefault("header", False)
        self.dialect = replace(chosen, **overrides)
        self.names = names
        self.index_path = Path(index_path) if index_path else indexes.sidecar_path(self.source, self.dialect)
        self.notes: list[str] = []
        self.index = self._stored() if use_index else None
        self.from_index = self.index is not None
        if self.index is None:
            self.index = indexes.bootstrap(self.source, self.dialect, self.sniffed.scan_start)
            self.index.splits = indexes.plan_splits(spark, self.source, self.dialect, self.sniffed.scan_start)
        self.evidence = reader.evidence(spark, self.source, self.dialect, self.index.splits)
        width = self.index.stats.expected_fields
        self.columns = reader.column_names(self.source, self.dialect, self.sniffed.scan_start, width, names)
        self.frame = reader.wide(self.evidence, self.columns, self.dialect)
        self.selection = Selection.all(self.frame)
        self.rules: list[enrich.Rule] = []
        self.redactions: list[redaction.Rule] = []
        self.edits = edits.EditSet()

    # -- index and statistics

    def _stored(self) -> indexes.Index | None:
        if not self.index_path.exists():
            return None
        try:
            found = indexes.Index.load(self.index_path)
        except (OSError, ValueError) as error:
            self.notes.append(f"index not used: {error}")
            return None
        if found.matches(self.source, self.dialect, self.sniffed.scan_start):
            return found
        self.notes.append("index not used: it was made for another file or other parser settings")
        return None

    def build_index(self, algorithms: tuple[str, ...] = ("sha256",), save: bool = True) -> indexes.Index:
        """Splits, statistics and digests of the whole file, kept as a sidecar."""
        self.source.guard(self.index_path)
        if not self.index.stats.complete:
            self.index.stats = reader.stats(self.evidence, self.index.stats.expected_fields)
        missing = tuple(a for a in algorithms if not self.index.digests.get(a))
        if missing:
            self.index.digests |= self.source.digest(missing)
        self.source.ensure_unchanged()
        if save:
            self.index.save(self.index_path)
        return self.index

    def count(self) -> indexes.Stats:
        """Record statistics by a full scan."""
        return reader.stats(self.evidence, self.index.stats.expected_fields)

    def cache(self) -> AnalysisCache:
        return AnalysisCache(self.source, self.index_path.with_suffix(".analysis.json"), self.index.digests.get("sha256"))

    # -- rows

    def rows(self, start: int = 0, count: int = 20) -> Frame:
        found = self._between(start, start + count)
        return found.with_df(found.df.orderBy(ORDINAL))

    def scattered(self, ordinals: list[int]) -> Frame:
        found = self._between(min(ordinals, default=0), max(ordinals, default=-1) + 1)
        return found.with_df(found.df.where(found.df[ORDINAL].isin(ordinals)).orderBy(ORDINAL))

    def _between(self, first: int, end: int) -> Frame:
        """Records by number, read from their splits alone."""
        df = reader.evidence(self.spark, self.source, self.dialect, self.index.splits, (first, end))
        return reader.wide(df, self.columns, self.dialect)

    def go_to(self, record: int) -> int:
        """A record number within the known ones."""
        total = self.index.stats.records if self.index.stats.complete else self.count().records
        return max(0, min(record, total - 1))

    # -- selections

    def find(self, query: search.SearchQuery) -> Selection:
        self.selection = self.selection.narrow(query)
        return self.selection

    def pivot(self, column: str, value: str) -> Selection:
        self.selection = self.selection.pivot(column, value)
        return self.selection

    def filter_range(self, column: str, start: int, end: int, width: int = 1, year: int | None = None) -> Selection:
        """A time range, widened to the edges of the buckets it was dragged over."""
        start, end = search.snapped(start, end, width)
        self.selection = self.selection.narrow(search.TimeRange(column, start, end, year))
        return self.selection

    def revert_to(self, depth: int) -> Selection:
        self.selection = self.selection.revert_to(depth)
        return self.selection

    def pop_selection(self) -> Selection:
        self.selection = self.selection.back()
        return self.selection

    def clear_selection(self) -> Selection:
        self.selection = self.selection.clear()
        return self.selection

    # -- derived columns and analyses; these read the source, never the edits

    def enrich(self, rules: list[enrich.Rule]) -> None:
        self.rules = list(rules)

    def analysed(self) -> Frame:
        """The selected records with their derived columns."""
        self.selection.require()
        return enrich.enrich(self.selection.frame, self.rules)

    def values(self, column: str, top: int = TOP_VALUES) -> tuple[counts.Totals, DataFrame]:
        frame = self.analysed()
        return counts.Totals(**counts.totals(frame, column).first().asDict()), counts.value_counts(frame, column, top)

    def timeline(self, column: str, width: int | None = None, target: int = DESKTOP_BUCKETS, year: int | None = None) -> tuple[timeline.Totals, int, DataFrame]:
        return timeline.timeline(self.analysed(), column, width, target, year)

    def profile(self, whole: bool = False) -> list[dict]:
        return profile.profile(self.frame, whole, self.index.stats.records if self.index.stats.complete else None)

    def quick_profile(self) -> list[dict]:
        """The profile of the first rows, for a file that was just opened."""
        return profile.profile(self._between(0, HEAD_ROWS), whole=True)

    def dashboard(self) -> list[tuple[counts.Panel, DataFrame]]:
        return [(p, counts.panel_data(self.analysed(), p)) for p in counts.panels(self.profile())]

    # -- edits, redaction, export

    def edit(self, record: int, column: str, value: str) -> None:
        row = self.scattered([record]).df.select(f"`{self.frame.resolve(column)}`").first()
        self.edits.set_cell(record, self.frame.index(column), value, (row[0] or "") if row else "")

    def mark(self, record: int, color: int, note: str = "") -> None:
        self.edits.set_mark(record, color, note)

    def save_version(self, path: str | Path, name: str = "") -> None:
        self.source.guard(path)
        self.edits.name = name or Path(path).stem
        self.edits.stamp(self.source.size, self.build_index().digests["sha256"], self.dialect.json())
        Path(path).write_text(self.edits.to_json())

    def open_version(self, path: str | Path) -> None:
        found = edits.EditSet.from_json(Path(path).read_text())
        found.check(self.source.size, self.build_index().digests["sha256"], self.dialect.json())
        self.edits = found

    def discard_edits(self) -> None:
        self.edits = edits.EditSet()

    def rows_shown(self, start: int = 0, count: int = 20) -> Frame:
        """Rows as a front end shows them: edited, with derived columns computed from the edited values."""
        frame = edits.overlay(self.rows(start, count), self.edits.table(self.spark)) if self.edits.cells else self.rows(start, count)
        shown = enrich.enrich(frame, self.rules)
        return shown.with_df(shown.df.orderBy(ORDINAL))

    def redact_on_export(self, rules: list[redaction.Rule]) -> None:
        self.redactions = list(rules)

    def export(self, output: str | Path, key: bytes | None = None, header: bool = True, terminator: str = "\n", force: bool = False) -> dict:
        """Writes the selection and its manifest; refused while a step of the selection is incomplete."""
        index = self.build_index()
        self.selection.complete()
        how = export.Transform(self.edits if self.edits.cells else None, self.redactions, key, self.rules)
        if how.edits and how.edits.bound:
            how.edits.check(self.source.size, index.digests["sha256"], self.dialect.json())
        frame = self.selection.frame
        pending = export.write(frame, self.source, self.dialect, output, self._header() if header else None, terminator.encode(), how, force)
        steps = self.selection.operations() + export.operations(frame, how, pending.changed)
        origin = manifest.source_entry(self.source, self.dialect.json(), index.digests, index.stats.records, self.names)
        told = manifest.build(origin, steps, self.selection.description(), pending.report)
        pending.commit(told)
        return told

    def export_dataset(self, folder: str | Path, key: bytes | None = None, terminator: str = "\n", force: bool = False) -> dict:
        """Writes the selection as a folder of parts, each by the task that holds its records, and a manifest beside it."""
        index = self.build_index()
        self.selection.complete()
        how = export.Transform(self.edits if self.edits.cells else None, self.redactions, key, self.rules)
        place = manifest.path_for(folder)
        self.source.guard(folder, place)
        frame = self.selection.frame
        export.write_dataset(frame, self.dialect, f"file://{Path(folder).resolve()}", how, terminator, force)
        self.source.ensure_unchanged()
        changed = {r for r, _ in how.edits.cells} if how.edits else set()
        parts = [r.asDict() for r in export.dataset_parts(self.spark, f"file://{Path(folder).resolve()}").orderBy("name").collect()]  # one row a part
        whole = hashlib.sha256("".join(p["sha256"] for p in parts).encode()).hexdigest()
        report = {
            "path": str(Path(folder).resolve()), "name": Path(folder).name, "format": "csv-parts", "content": export.content_label(bool(changed), how), "header": False, "terminator": terminator,
            "records": self.selection.count(), "size": sum(p["size"] for p in parts), "sha256": whole, "parts": parts, "blake3": None,
        }
        origin = manifest.source_entry(self.source, self.dialect.json(), index.digests, index.stats.records, self.names)
        told = manifest.build(origin, self.selection.operations() + export.operations(frame, how, changed), self.selection.description(), report)
        manifest.write(told, place)
        return told

    def _header(self) -> bytes | None:
        from .sources import records

        if not self.dialect.header:
            return None
        head = self.source.head()[self.sniffed.scan_start :]
        first = next(records.iterate(head, *self.dialect.parts), None)
        return head[first.start : first.end] if first else None


def lookup_table(spark: SparkSession, path: str | Path, key: str, values: tuple[str, ...] = ()) -> tuple[Frame, dict]:
    """A lookup table from a file, sniffed by itself, and what a manifest says of it."""
    case = Case(spark, path, use_index=False)
    stats = case.count()
    frame = case.frame
    picked = [frame.resolve(v) for v in values] or [n for n in frame.names if n != frame.resolve(key)]
    told = {
        "name": Path(path).name, "kind": "csv", "size": case.source.size, "sha256": case.source.digest()["sha256"], "records": stats.records,
        "lookup": {"key": frame.resolve(key), "values": picked, **case.dialect.json()},
    }
    return frame.with_df(frame.df.drop(RAW)), told


__all__ = ["Case", "lookup_table", "timestamps"]
