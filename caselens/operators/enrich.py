"""Enrichment: derived columns ``<column>.<field>`` from lookup tables, domains and address ranges."""

from __future__ import annotations

import hashlib
import ipaddress
import os
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mmdb, timestamps
from ..functions.domains import SuffixList, default_list, parts
from ..functions.semantic import V4, trimmed
from .frames import ORDINAL, Frame, col

#: a table is broadcast only if it was measured and has no more rows and bytes; larger ones are joined by shuffle
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def _small(table: DataFrame) -> DataFrame:
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    rows, held = table.limit(BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else table


def last_of_each(table: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row a key: the last one by ``order``.  ``_key`` is the key as it stands."""
    kept = F.max_by(F.struct(*(col(v).cast("string").alias(v) for v in values)), col(order)).alias("_v")
    return table.where(col(key).isNotNull()).groupBy(col(key).cast("string").alias("_key")).agg(kept)


def _attach(frame: Frame, df: DataFrame, column: str, fields: list[tuple[str, Column]], gone: tuple[str, ...]) -> Frame:
    derived = [f"{column}.{name}" for name, _ in fields]
    df = df.withColumns({d: F.coalesce(value.cast("string"), F.lit("")) for d, (_, value) in zip(derived, fields, strict=True)}).drop(*gone)
    return frame.with_df(df, (*frame.derived, *derived))


@dataclass(frozen=True)
class Lookup:
    """Left join with a table by an exact key; the probe is trimmed, the key is not; of equal keys the last one holds."""

    column: str
    table: Frame
    key: str
    values: tuple[str, ...] = ()
    dataset: dict = field(default_factory=dict, compare=False)
    provider: str = "lookup"

    def fields(self) -> list[str]:
        key = self.table.resolve(self.key)
        return [self.table.resolve(v) for v in self.values] or [n for n in self.table.names if n != key]

    def duplicates(self) -> int:
        key = col(self.table.resolve(self.key))
        row = self.table.df.agg(F.count(key), F.count_distinct(key)).first()
        return row[0] - row[1]

    def apply(self, frame: Frame) -> Frame:
        column, names = frame.resolve(self.column), self.fields()
        order = ORDINAL if ORDINAL in self.table.df.columns else self.table.resolve(self.key)
        table = last_of_each(self.table.df, self.table.resolve(self.key), names, order)
        df = frame.df.withColumn("_probe", trimmed(F.coalesce(col(column).cast("string"), F.lit(""))))
        joined = df.join(_small(table), F.col("_probe") == F.col("_key"), "left")
        return _attach(frame, joined, column, [(n, F.col("_v").getField(n)) for n in names], ("_probe", "_key", "_v"))


@dataclass(frozen=True)
class Domain:
    """Registrable domain, suffix and subdomain of a host name."""

    column: str
    suffixes: SuffixList = field(default_factory=default_list)
    provider: str = "domain"

    def fields(self) -> list[str]:
        return ["registrable", "suffix", "subdomain"]

    @property
    def dataset(self) -> dict:
        return {"name": "public-suffix-list", "kind": "psl", "version": self.suffixes.version}

    def apply(self, frame: Frame) -> Frame:
        column = frame.resolve(self.column)
        df = frame.df.withColumn("_parts", parts(trimmed(F.coalesce(col(column).cast("string"), F.lit(""))), self.suffixes))
        return _attach(frame, df, column, [(n, F.col("_parts").getField(n)) for n in self.fields()], ("_parts",))


def ip_number(column: Column) -> Column:
    """IPv4 addresses as numbers, null for anything else."""
    text = trimmed(column)
    bytes_ = F.split(text, r"\.")
    number = sum((bytes_[k].try_cast("bigint") * (1 << 8 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))
    return F.when(text.rlike(rf"\A{V4}\z"), number)


#: leading bits that cells leave out, and cells that a range may have before it is cut into coarser ones
CELL_SHIFTS, RANGE_CELLS = (16, 32, 48), 256


def range_join(df: DataFrame, number: Column, ranges: DataFrame, low: str, high: str, keep: list[str]) -> DataFrame:
    """Left join with ranges that do not overlap: the range that holds the number, if any.

    The ranges become cells of equal leading bits, so the join is an equi-join
    on the cell; ranges wider than a cell are cut at its edges, and very wide
    ones are joined apart by coarser cells, so their number stays small.
    """
    cell = lambda c, shift: F.shiftright(c, shift)
    level = F.lit(CELL_SHIFTS[-1])
    for shift in CELL_SHIFTS[-2::-1]:
        level = F.when(cell(col(high), shift) - cell(col(low), shift) < RANGE_CELLS, shift).otherwise(level)
    placed = ranges.withColumn("_level", level)
    out, hits = df.withColumn("_n", number), []
    for shift in sorted(r[0] for r in placed.select("_level").distinct().collect()):  # three at most
        hit, own = f"_hit{shift}", F.sequence(cell(col(low), shift), cell(col(high), shift))
        table = placed.where(F.col("_level") == shift).select(F.struct(col(low).alias("_low"), col(high).alias("_high"), *(col(k) for k in keep)).alias(hit), F.explode(own).alias("_cell"))
        held = (F.col("_c") == F.col("_cell")) & F.col("_n").between(F.col(f"{hit}._low"), F.col(f"{hit}._high"))
        out = out.withColumn("_c", cell(F.col("_n"), shift)).join(_small(table), held, "left").drop("_cell", "_c")
        hits.append(hit)
    if not hits:
        fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in ranges.select(col(low).alias("_low"), col(high).alias("_high"), *(col(k) for k in keep)).schema)
        return out.withColumn("_hit", F.lit(None).cast(f"struct<{fields}>")).drop("_n")
    return out.withColumn("_hit", F.coalesce(*hits)).drop("_n", *hits)


@dataclass(frozen=True)
class Geo:
    """Country and the like of an address, from a table of ranges ``low, high`` (addresses or numbers) and more columns."""

    column: str
    ranges: DataFrame
    values: tuple[str, ...]
    dataset: dict = field(default_factory=dict, compare=False)
    provider: str = "geoip"

    def fields(self) -> list[str]:
        return list(self.values)

    def _numbers(self) -> tuple[DataFrame, DataFrame]:
        """IPv4 ranges as numbers, and IPv6 ranges as they are."""
        numeric = dict(self.ranges.dtypes)["low"] in ("bigint", "int")
        if numeric:
            return self.ranges, self.ranges.limit(0)
        v4 = self.ranges.withColumns({"low": ip_number(col("low")), "high": ip_number(col("high"))}).where("low IS NOT NULL AND high IS NOT NULL")
        return v4, self.ranges.where(F.col("low").contains(":"))

    def apply(self, frame: Frame) -> Frame:
        column = frame.resolve(self.column)
        v4, v6 = self._numbers()
        text = F.coalesce(col(column).cast("string"), F.lit(""))
        df = range_join(frame.df, ip_number(text), v4, "low", "high", list(self.values))
        wide = _v6_lookup(v6, self.values)
        fields = [(n, F.col("_hit").getField(n).cast("string")) for n in self.values]
        if wide is not None:
            df = df.withColumn("_six", wide(F.when(text.contains(":"), trimmed(text))))
            fields = [(n, F.coalesce(value, F.col("_six").getField(n))) for n, value in fields]
        return _attach(frame, df, column, fields, ("_hit", "_six"))


def _v6_lookup(ranges: DataFrame, values: tuple[str, ...]):
    """An Arrow-batched lookup in sorted IPv6 ranges, or None without any; their number is checked."""
    rows = ranges.select("low", "high", *values).limit(BROADCAST_ROWS + 1).collect()
    if not rows:
        return None
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} IPv6 ranges")
    from bisect import bisect_right

    table = sorted((int(ipaddress.IPv6Address(r["low"])), int(ipaddress.IPv6Address(r["high"])), tuple(str(r[v]) for v in values)) for r in rows)
    lows = [t[0] for t in table]

    @F.pandas_udf(", ".join(f"`{v}` string" for v in values))
    def find(addresses: pd.Series) -> pd.DataFrame:
        def one(address: str | None) -> tuple:
            try:
                number = int(ipaddress.IPv6Address(address or ""))
            except ValueError:
                return (None,) * len(values)
            at = bisect_right(lows, number) - 1
            return table[at][2] if at >= 0 and number <= table[at][1] else (None,) * len(values)

        return pd.DataFrame([one(a) for a in addresses], columns=list(values))

    return find


#: largest address database that is sent to the tasks
DATABASE_BYTES = 512 << 20


@dataclass(frozen=True)
class GeoDatabase:
    """Country, city or network operator of an address, from a MaxMind DB file of checked size."""

    column: str
    path: str
    provider: str = "geoip"

    def _raw(self) -> bytes:
        if Path(self.path).stat().st_size > DATABASE_BYTES:
            raise ValueError(f"{self.path} has more than {DATABASE_BYTES} bytes")
        return Path(self.path).read_bytes()

    def fields(self) -> list[str]:
        return mmdb.FIELDS[mmdb.Database(self._raw()).kind]

    @property
    def dataset(self) -> dict:
        raw = self._raw()
        meta = mmdb.Database(raw).metadata
        told = {"name": Path(self.path).name, "path": os.path.realpath(self.path), "kind": "mmdb", "size": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}
        return told | {"database_type": meta["database_type"], "built": timestamps.iso_text(meta.get("build_epoch", 0))}

    def apply(self, frame: Frame) -> Frame:
        column, names = frame.resolve(self.column), self.fields()
        shared = frame.df.sparkSession.sparkContext.broadcast(self._raw())
        opened: dict[str, mmdb.Database] = {}

        @F.pandas_udf(", ".join(f"`{n}` string" for n in names))
        def find(addresses: pd.Series) -> pd.DataFrame:
            if not opened:
                opened["it"] = mmdb.Database(shared.value)
            database = opened["it"]
            known = {a: mmdb.fields_of(database.kind, database.lookup(a)) for a in addresses.unique()}
            return pd.DataFrame([known[a] for a in addresses], columns=names)

        df = frame.df.withColumn("_geo", find(trimmed(F.coalesce(col(column).cast("string"), F.lit("")))))
        return _attach(frame, df, column, [(n, F.col("_geo").getField(n)) for n in names], ("_geo",))


Rule = Lookup | Domain | Geo | GeoDatabase


def enrich(frame: Frame, rules: list[Rule]) -> Frame:
    """All rules in order: columns are appended rule after rule, field after field; there is a row a record always."""
    for rule in rules:
        frame = rule.apply(frame)
    return frame


def manifest(frame: Frame, rules: list[Rule]) -> dict:
    return {
        "op": "enrich",
        "rules": [
            {"column": frame.index(r.column), "name": frame.resolve(r.column), "provider": r.provider, "derived": [f"{frame.resolve(r.column)}.{f}" for f in r.fields()], "dataset": r.dataset}
            for r in rules
        ],
    }


def parse_lookup(spec: str) -> tuple[str, str, str, tuple[str, ...]]:
    """Column, path, key and values of ``COL=PATH:KEY[:V1,V2]``; a drive letter is part of the path."""
    column, found, rest = spec.partition("=")
    drive = rest[:2] if len(rest) > 2 and rest[1] == ":" and rest[0].isalpha() and rest[2] in "\\/" else ""
    path, *more = rest[len(drive) :].split(":")
    if not found or not column or not path or len(more) not in (1, 2) or not more[0]:
        raise ValueError(f"lookup {spec!r} is not COL=PATH:KEY[:VALUES]")
    return column, drive + path, more[0], tuple(more[1].split(",")) if len(more) == 2 else ()
