"""Searches as predicates: literal, regular expression or exact, over whole records or columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import timestamps
from .frames import FIELDS, ORDINAL, RAW, Frame, col, with_ordinal

KINDS = ("literal", "regex", "exact")


def translate(pattern: str, ignore_case: bool = False) -> str:
    """A linear-time regular expression as one for Java with the same matches.

    ``.`` excludes only line feeds, classes are Unicode, ``$`` is the very end
    unless ``(?m)`` is set, and case folding is Unicode.  Look-around and back
    references are refused, as linear-time engines have none.
    """
    out, i, in_class, multiline = [], 0, 0, bool(re.search(r"\(\?[a-zA-Z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt.isdigit() and nxt != "0" and not in_class or nxt == "k":
                raise ValueError(f"back references are not supported: {pattern!r}")
            if nxt in "GZRX" or nxt in "QE":
                raise ValueError(f"\\{nxt} is not supported: {pattern!r}")
            out.append(c + nxt)
            i += 2
            continue
        if c == "[":
            in_class += 1
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":  # a bracket in first place is a member
                out.append(pattern[i : i + pattern[i:].index("]")] + r"\]")
                i += pattern[i:].index("]") + 1
                continue
        elif c == "]" and in_class:
            in_class -= 1
        elif not in_class:
            if c == "(" and pattern[i + 1 : i + 2] == "?":
                if re.match(r"\(\?(<?[=!]|>)", pattern[i:]):
                    raise ValueError(f"look-around is not supported: {pattern!r}")
                if pattern[i : i + 4] == "(?P<":
                    out.append("(?<")
                    i += 4
                    continue
            elif c in "*+?}" and pattern[i + 1 : i + 2] == "+":
                raise ValueError(f"possessive repetition is not supported: {pattern!r}")
            elif c == "$" and not multiline:
                out.append(r"\z")
                i += 1
                continue
        out.append(c)
        i += 1
    return f"(?dU{'iu' if ignore_case else ''}){''.join(out)}"


@dataclass(frozen=True)
class SearchQuery:
    """What to look for; ``columns`` None means the whole record (or, for exact, any field)."""

    pattern: str
    kind: str = "literal"
    case_insensitive: bool = False
    columns: tuple[str, ...] | None = None
    invert: bool = False

    def check(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind of search {self.kind!r}")
        if not self.pattern and self.kind != "exact":
            raise ValueError("the pattern is empty")
        if self.kind == "regex":
            try:
                re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"\\z", r"\\Z", translate(self.pattern).removeprefix("(?dU)"))))
            except re.error as error:
                raise ValueError(f"invalid regular expression {self.pattern!r}: {error}") from error

    def manifest(self, frame: Frame) -> dict:
        indexes = None if self.columns is None else [frame.index(c) for c in self.columns]
        return {"pattern": self.pattern, "kind": self.kind, "case_insensitive": self.case_insensitive, "columns": indexes, "invert": self.invert}

    def _one(self, value: Column) -> Column:
        if self.kind == "regex":
            return value.rlike(translate(self.pattern, self.case_insensitive))
        literal = "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~" else c for c in self.pattern)
        if self.kind == "exact":
            return value.rlike(rf"(?iu)\A(?:{literal})\z") if self.case_insensitive else value == self.pattern
        return value.rlike(f"(?iu){literal}") if self.case_insensitive else value.contains(self.pattern)

    def predicate(self, frame: Frame) -> Column:
        """True for the records found; never null, so it can be inverted."""
        self.check()
        if self.columns is not None:
            found = [self._one(col(frame.resolve(c)).cast("string")) for c in self.columns]
        elif self.kind == "exact":
            if FIELDS in frame.df.columns:
                found = [F.exists(FIELDS, lambda f: F.coalesce(self._one(f.cast("string")), F.lit(False)))]
            else:
                found = [self._one(col(n).cast("string")) for n in frame.names]
        else:
            raw = F.col(RAW)
            if isinstance(frame.df.schema[RAW].dataType, T.BinaryType):
                # bytes are searched as they are for a plain literal, as text otherwise
                plain = self.kind == "literal" and not self.case_insensitive
                found = [F.contains(raw, F.lit(self.pattern.encode()))] if plain else [self._one(raw.cast("string"))]
            else:
                found = [self._one(raw)]
        any_of = reduce(lambda a, b: a | b, (F.coalesce(f, F.lit(False)) for f in found), F.lit(False))
        return ~any_of if self.invert else any_of


@dataclass(frozen=True)
class OrdinalRange:
    """``count`` records from ``first`` on."""

    first: int
    count: int

    @classmethod
    def of(cls, text: str) -> OrdinalRange:
        first, found, count = text.partition(":")
        if not found:
            raise ValueError(f"range {text!r} is not START:COUNT")
        return cls(int(first.replace("_", "").replace(",", "")), int(count.replace("_", "").replace(",", "")))

    def predicate(self, frame: Frame) -> Column:
        return (F.col(ORDINAL) >= self.first) & (F.col(ORDINAL) < self.first + self.count)


@dataclass(frozen=True)
class TimeRange:
    """Records whose timestamp lies in [``start``, ``end``) Unix seconds; others are left out."""

    column: str
    start: int
    end: int
    year: int | None = None

    def predicate(self, frame: Frame) -> Column:
        name = frame.resolve(self.column)
        at = timestamps.seconds(col(name), frame.df.schema[name].dataType, self.year)
        return F.coalesce((at >= self.start) & (at < self.end), F.lit(False))

    def manifest(self, frame: Frame) -> dict:
        return {
            "column": frame.index(self.column), "name": frame.resolve(self.column), "from": timestamps.iso_text(self.start),
            "to": timestamps.iso_text(self.end), "reference_year": self.year or timestamps.current_year(),
        }


def snapped(start: int, end: int, width: int) -> tuple[int, int]:
    """A dragged interval widened to bucket edges."""
    return start // width * width, -(-end // width) * width


def matches(frame: Frame, query: SearchQuery | OrdinalRange | TimeRange) -> Frame:
    return frame.where(query.predicate(frame))


def first_matches(frame: Frame, query: SearchQuery, n: int) -> tuple[int, Frame]:
    """How many records match, and the first ``n`` of them in order."""
    found = matches(frame, query)
    return found.df.count(), found.with_df(found.df.orderBy(ORDINAL).limit(n))


def neighbours(frame: Frame, ordinal: int) -> dict:
    """Position, previous and next of an ordinal among a frame's records, in one pass."""
    o = F.col(ORDINAL)
    row = frame.df.agg(
        F.count("*").alias("n"), F.sum(F.when(o <= ordinal, 1).otherwise(0)).alias("rank"), F.max(F.when(o < ordinal, o)).alias("before"),
        F.min(F.when(o > ordinal, o)).alias("after"), F.min(o).alias("first"), F.max(o).alias("last"),
    ).first()
    return row.asDict()


def beside(df: DataFrame, key: str) -> DataFrame:
    """``key, before, after``: the previous and next key of every row, by dense numbers, so no task sorts all rows."""
    numbered = with_ordinal(df.select(key), key, "_n")
    before = numbered.select((F.col("_n") + 1).alias("_n"), col(key).alias("before"))
    after = numbered.select((F.col("_n") - 1).alias("_n"), col(key).alias("after"))
    return numbered.join(before, "_n", "left").join(after, "_n", "left").select(key, "before", "after")


def select(frame: Frame, k: int) -> int | None:
    """Ordinal of the ``k``-th record of a frame, from 0: ranges are counted first, so no task sorts all."""
    o = F.col(ORDINAL)
    low, high = frame.df.agg(F.min(o), F.max(o)).first()
    while low is not None and low < high:
        step = max(1, (high - low) // 256)
        counts = frame.df.where(o.between(low, high)).groupBy(((o - low) / step).cast("bigint").alias("b")).count().orderBy("b").collect()
        for b, n in counts:
            if k < n:
                low, high = low + b * step, min(high, low + (b + 1) * step - 1)
                break
            k -= n
        else:
            return None
        if step == 1:
            return low
    return low if low is not None and k == 0 else None
