"""Cell edits and row marks kept beside a source, never in it."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import ORDINAL, Frame, col

VERSION = 2
COLORS = range(1, 7)


@dataclass
class EditSet:
    """Edits by (record, column index) and marks by record, bound to one source and dialect."""

    cells: dict[tuple[int, int], dict] = field(default_factory=dict)
    marks: dict[int, dict] = field(default_factory=dict)
    bound: dict | None = None
    name: str = ""

    def set_cell(self, record: int, column: int, value: str, was: str) -> None:
        """Records an edit; typing the source's value takes it back."""
        if value == was:
            self.cells.pop((record, column), None)
        else:
            self.cells[record, column] = {"value": value, "was_sha256": hashlib.sha256(was.encode()).hexdigest()}

    def clear_cell(self, record: int, column: int) -> None:
        self.cells.pop((record, column), None)

    def set_mark(self, record: int, color: int, note: str = "") -> None:
        """A coloured mark; colour 0 takes it away."""
        if color == 0:
            self.marks.pop(record, None)
        elif color in COLORS:
            self.marks[record] = {"color": color, "note": note}
        else:
            raise ValueError(f"marks have colours 1 to {COLORS[-1]}")

    def stamp(self, size: int, sha256: str, dialect: dict) -> None:
        self.bound = {"size": size, "sha256": sha256, "dialect": dialect}

    def check(self, size: int, sha256: str, dialect: dict) -> None:
        """Raises ValueError unless the edits were made for this source, parsed this way."""
        if self.bound is None:
            raise ValueError("the edits are bound to no source")
        if (self.bound["size"], self.bound["sha256"]) != (size, sha256):
            raise ValueError("the edits were made for another source")
        if self.bound["dialect"] != dialect:
            raise ValueError("the edits were made with other parser settings")

    def to_json(self) -> str:
        return json.dumps(
            {
                "caselens_edits": VERSION, "name": self.name, "bound": self.bound,
                "cells": [{"record": r, "column": c, **e} for (r, c), e in sorted(self.cells.items())],
                "marks": [{"record": r, **m} for r, m in sorted(self.marks.items())],
            },
            indent=2,
        )

    @classmethod
    def from_json(cls, text: str) -> EditSet:
        held = json.loads(text)
        if held.get("caselens_edits") != VERSION:
            raise ValueError(f"edit files of version {held.get('caselens_edits')} are not supported")
        cells = {(c["record"], c["column"]): {"value": c["value"], "was_sha256": c["was_sha256"]} for c in held["cells"]}
        marks = {m["record"]: {"color": m["color"], "note": m.get("note", "")} for m in held["marks"]}
        return cls(cells, marks, held["bound"], held.get("name", ""))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a record with edits: ``_edited`` and a map of column index to value."""
        rows: dict[int, dict[int, str]] = {}
        for (record, column), edit in self.cells.items():
            rows.setdefault(record, {})[column] = edit["value"]
        return spark.createDataFrame([(r, v) for r, v in sorted(rows.items())], "_edited bigint, _values map<int,string>")

    def info(self, names: list[str], written: set[int] | None = None, redacted: set[str] | None = None) -> dict:
        """What a manifest says of the edits that were written; values of redacted columns are left out."""
        cells = []
        for (record, column), edit in sorted(self.cells.items()):
            if written is not None and record not in written:
                continue
            name = names[column] if column < len(names) else f"col{column}"
            entry = {"record": record, "column": column, "name": name, "was_sha256": edit["was_sha256"]}
            cells.append(entry if name in (redacted or ()) else entry | {"value": edit["value"]})
        return {"op": "edit", "edits": {"version": self.name, "cells": cells, "marks": len(self.marks)}}


def overlay(frame: Frame, edits: DataFrame) -> Frame:
    """The frame with edited values; ``_changed`` tells which records have any.

    ``edits`` is an edit set's table: hand-made, so small, and still joined by
    Spark's own choice of strategy.
    """
    df = frame.df.join(edits, F.col(ORDINAL) == F.col("_edited"), "left")
    changed = {n: F.coalesce(F.col("_values")[k], col(n).cast("string")) for k, n in enumerate(frame.names)}
    df = df.withColumn("_changed", F.col("_edited").isNotNull()).withColumns(changed)
    return frame.with_df(df.drop("_edited", "_values"))
