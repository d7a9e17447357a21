"""Exports: selected records as CSV, raw or transformed, with a manifest.

Raw records keep their bytes; only terminators are made equal.  Transformations
come in a fixed order: cell edits, then redaction; derived columns are computed
from the edited record before redaction and appended.  Fields that nothing
touches keep their own quoting.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..sources import records
from ..sources.dialect import Dialect
from ..sources.evidence import Source, temporary
from . import edits as editing
from . import enrich as enriching
from . import manifest as manifests
from .frames import ORDINAL, RAW, Frame, col


@dataclass
class Transform:
    edits: editing.EditSet | None = None
    redact: list[redaction.Rule] = field(default_factory=list)
    key: bytes | None = None
    enrich: list[enriching.Rule] = field(default_factory=list)


def _edited(raw: Column, values: Column, dialect: Dialect) -> Column:
    delimiter, quote = dialect.parts

    @F.pandas_udf("binary")
    def render(raws: pd.Series, changes: pd.Series) -> pd.Series:
        def one(raw: bytes, change) -> bytes:
            if change is None:
                return raw
            change = dict(change)
            fields = records.split_fields(raw, delimiter, quote)
            fields += [b""] * (max(change) + 1 - len(fields))
            for k, value in change.items():
                fields[k] = value.encode()
            return delimiter.join(records.write_field(f, delimiter, quote) for f in fields)

        return pd.Series([one(r, c) for r, c in zip(raws, changes, strict=True)])

    return render(raw, values)


def _rendered(df: DataFrame, raw: Column, new: Column, extra: Column, dropped: list[bool], dialect: Dialect) -> DataFrame:
    """``_ordinal, line, _changed``: records with new values in place of the old ones (null: as it stands), dropped fields out and more at the end."""
    delimiter, quote = dialect.parts
    gone = [k for k, d in enumerate(dropped) if d]

    def one(raw: bytes, values: list[str | None], more: list[str]) -> bytes:
        fields = raw.split(delimiter) if quote is None or quote not in raw else records.raw_fields(raw, delimiter, quote)
        for k, value in enumerate(values[: len(fields)]):
            if value is not None:
                fields[k] = records.write_field(value.encode(), delimiter, quote)
        kept = [f for k, f in enumerate(fields) if k not in gone] if gone else fields
        return delimiter.join([*kept, *(records.write_field(v.encode(), delimiter, quote) for v in more)])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("line", "_new", "_extra")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(ORDINAL), pa.array(done, pa.binary()), batch.column("_changed")], [ORDINAL, "line", "_changed"])

    rows = df.select(ORDINAL, raw.alias("line"), new.alias("_new"), extra.alias("_extra"), "_changed")
    return rows.mapInArrow(render, f"{ORDINAL} bigint, line binary, _changed boolean")


def lines(frame: Frame, dialect: Dialect, transform: Transform | None = None) -> DataFrame:
    """``_ordinal``, ``line binary`` and ``_changed`` (an edit touched it) of every record of the frame."""
    t = transform or Transform()
    spark = frame.df.sparkSession
    raw = F.col(RAW).cast("binary")
    if t.edits and t.edits.cells:
        table = t.edits.table(spark)
        df = frame.df.join(table, F.col(ORDINAL) == F.col("_edited"), "left")
        values = {n: F.coalesce(F.col("_values")[k], col(n).cast("string")) for k, n in enumerate(frame.names)}
        df = df.withColumn("_changed", F.col("_edited").isNotNull()).withColumn(RAW, _edited(raw, F.when(F.col("_edited").isNotNull(), F.col("_values")), dialect)).withColumns(values)
        frame = frame.with_df(df.drop("_edited", "_values"))
        raw = F.col(RAW)
    else:
        frame = frame.with_df(frame.df.withColumn("_changed", F.lit(False)))
    if not t.redact and not t.enrich:
        return frame.df.select(ORDINAL, raw.alias("line"), "_changed")
    redaction.check(t.redact, t.key)
    whole = enriching.enrich(frame, t.enrich)
    rules = {frame.resolve(r.column): r for r in t.redact}
    nothing = F.lit(None).cast("string")
    new = F.array(*(redaction.redact(col(n), rules[n], t.key) if n in rules and rules[n].method != "drop" else nothing for n in frame.names))
    extra = F.array(*(col(d) for d in whole.derived)) if whole.derived else F.array().cast("array<string>")
    dropped = [n in rules and rules[n].method == "drop" for n in frame.names]
    return _rendered(whole.df, F.col(RAW).cast("binary"), new, extra, dropped, dialect)


def header_line(header: bytes | None, frame: Frame, dialect: Dialect, transform: Transform) -> bytes | None:
    """The header record: dropped columns go, derived ones are appended, names are never redacted."""
    if header is None:
        return None
    delimiter, quote = dialect.parts
    gone = {frame.resolve(r.column) for r in transform.redact if r.method == "drop"}
    derived = [f"{frame.resolve(r.column)}.{f}" for r in transform.enrich for f in r.fields()]
    if not gone and not derived:
        return header
    kept = [f for k, f in enumerate(records.raw_fields(header, delimiter, quote)) if k >= len(frame.names) or frame.names[k] not in gone]
    return delimiter.join([*kept, *(records.write_field(d.encode(), delimiter, quote) for d in derived)])


def content_label(edited: bool, transform: Transform) -> str:
    parts = [p for p, on in (("edited", edited), ("redacted", transform.redact), ("enriched", transform.enrich)) if on]
    return "-".join(["records", *parts]) if parts else "raw-records"


def _in_order(rendered: DataFrame, sort: bool) -> Iterator:
    """Rows in record order.  Splits of a file are in order already; only what was joined is sorted."""
    df = rendered.orderBy(ORDINAL) if sort else rendered
    return df.toLocalIterator(prefetchPartitions=True)


class PendingExport:
    """A written but not yet published export: ``commit`` gives it its name, ``abort`` takes it away."""

    def __init__(self, source: Source, output: str | Path, report: dict):
        self.source, self.output, self.report = source, Path(output), report

    def commit(self, manifest: dict | None) -> dict:
        part = temporary(self.output)
        try:
            self.source.ensure_unchanged()
            place = manifests.path_for(self.output)
            self.source.guard(self.output, place)
            if manifest is not None:
                manifests.write(manifest, place)
            os.replace(part, self.output)
        except BaseException:
            self.abort()
            raise
        return self.report

    def abort(self) -> None:
        temporary(self.output).unlink(missing_ok=True)


def write(
    frame: Frame, source: Source, dialect: Dialect, output: str | Path, header: bytes | None = None, terminator: bytes = b"\n",
    transform: Transform | None = None, force: bool = False,
) -> PendingExport:
    """Writes the selected records beside ``output``, hashing on the way."""
    t = transform or Transform()
    output = Path(output)
    source.guard(output, manifests.path_for(output))
    source.ensure_unchanged()
    if output.exists() and not force:
        raise FileExistsError(f"{output} exists; overwriting it has to be asked for")
    part = temporary(output)
    digest, size, n, changed = hashlib.sha256(), 0, 0, set()
    try:
        with open(part, "wb") as f:
            first = header_line(header, frame, dialect, t)
            rows = _in_order(lines(frame, dialect, t), sort=bool(t.enrich or (t.edits and t.edits.cells)))
            if first is not None:
                f.write(first + terminator)
                digest.update(first + terminator)
                size += len(first) + len(terminator)
            for row in rows:
                line = bytes(row.line) + terminator
                f.write(line)
                digest.update(line)
                size, n = size + len(line), n + 1
                if row._changed:
                    changed.add(row[ORDINAL])
    except BaseException:
        part.unlink(missing_ok=True)
        raise
    report = {
        "path": os.path.realpath(output), "name": output.name, "format": "csv", "content": content_label(bool(changed), t), "header": header is not None,
        "terminator": terminator.decode(), "records": n, "size": size, "sha256": digest.hexdigest(), "blake3": None,
    }
    pending = PendingExport(source, output, report)
    pending.changed = changed
    return pending


def operations(frame: Frame, transform: Transform, changed: set[int]) -> list[dict]:
    """Edit, enrich and redact steps, in the order in which a manifest lists them."""
    out = []
    redacted = {frame.resolve(r.column) for r in transform.redact}
    if transform.edits and changed:
        out.append(transform.edits.info(list(frame.names), changed, redacted))
    if transform.enrich:
        out.append(enriching.manifest(frame, transform.enrich))
    if transform.redact:
        out.append({"op": "redact", "policy": {"rules": [r.manifest(frame.index(r.column), transform.key) for r in transform.redact]}})
    return out


def write_dataset(frame: Frame, dialect: Dialect, folder: str, transform: Transform | None = None, terminator: str = "\n", force: bool = False) -> None:
    """A large export as text files written by the tasks, without a header; names sort in record order."""
    rendered = lines(frame, dialect, transform)
    ordered = rendered.repartitionByRange(ORDINAL).sortWithinPartitions(ORDINAL).select(F.col("line").cast("string").alias("value"))
    ordered.write.mode("overwrite" if force else "error").option("lineSep", terminator).text(folder)


def dataset_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``name, size, sha256`` of each part, hashed by the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
