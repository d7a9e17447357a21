"""Timelines: records by time bucket, gaps filled with zeros."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timestamps
from .frames import Frame, col

# Widths that a timeline may choose, in seconds.
WIDTHS = (1, 5, 10, 30, 60, 300, 600, 900, 1800, 3600, 10_800, 21_600, 43_200, 86_400, 604_800, 2_592_000)
MAX_BUCKETS = 60
# Resolutions that counting falls back to, and the buckets at most that one may need.
RESOLUTIONS, MOST_BUCKETS = (1, 60, 3600, 86_400), 500_000


@dataclass(frozen=True)
class Totals:
    counted: int
    parsed: int
    unparsed: int
    min: int | None
    max: int | None


def at(frame: Frame, column: str, year: int | None = None) -> Column:
    name = frame.resolve(column)
    return timestamps.seconds(col(name), frame.df.schema[name].dataType, year)


def totals_frame(frame: Frame, column: str, year: int | None = None) -> DataFrame:
    """One row ``counted, parsed, unparsed, min, max`` (Unix seconds)."""
    s = F.col("s")
    return frame.df.select(at(frame, column, year).alias("s")).agg(
        F.count("*").alias("counted"), F.count(s).alias("parsed"), (F.count("*") - F.count(s)).alias("unparsed"), F.min(s).alias("min"), F.max(s).alias("max")
    )


def totals(frame: Frame, column: str, year: int | None = None) -> Totals:
    return Totals(**totals_frame(frame, column, year).first().asDict())


def auto_width(low: int | None, high: int | None, target: int = MAX_BUCKETS, resolution: int = 1) -> int:
    """The smallest listed width that spans the range in fewer than ``target`` buckets."""
    if low is None or high is None:
        return resolution
    return next((w for w in WIDTHS if w >= resolution and w % resolution == 0 and max(high - low, 1) // w < target), max(WIDTHS[-1], resolution))


def resolution(low: int | None, high: int | None, most: int = MOST_BUCKETS) -> int:
    """The finest resolution at which the range has no more than ``most`` buckets."""
    if low is None or high is None:
        return RESOLUTIONS[0]
    return next((r for r in RESOLUTIONS if high // r - low // r < most), RESOLUTIONS[-1])


def buckets(frame: Frame, column: str, width: int, year: int | None = None, fill: bool = True) -> DataFrame:
    """``bucket`` (start in Unix seconds) and ``count``, in order; gaps between the first and the last are zero.

    The gaps come from the bounds of the counted buckets, one row, and the
    filled series is as long as the timeline, not as the table.
    """
    counted = frame.df.select(timestamps.bucket(at(frame, column, year), width).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("count"))
    if not fill:
        return counted.orderBy("bucket")
    bounds = counted.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a IS NOT NULL")
    series = bounds.select(F.explode(F.sequence("a", "b", F.lit(width).cast("bigint"))).alias("bucket"))
    return series.join(counted, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")).orderBy("bucket")


def rebucket(counted: DataFrame, width: int) -> DataFrame:
    """Wider buckets from narrower ones; both widths count from the epoch, so none is lost."""
    return counted.groupBy(timestamps.bucket(F.col("bucket"), width).alias("bucket")).agg(F.sum("count").alias("count")).orderBy("bucket")


def timeline(frame: Frame, column: str, width: int | None = None, target: int = MAX_BUCKETS, year: int | None = None) -> tuple[Totals, int, DataFrame]:
    """Totals, the bucket width (chosen where none is given, a multiple of the resolution) and the buckets."""
    found = totals(frame, column, year)
    base = resolution(found.min, found.max)
    width = -(-width // base) * base if width else auto_width(found.min, found.max, target, base)
    return found, width, buckets(frame, column, width, year)
