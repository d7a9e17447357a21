"""Structured Streaming over a folder of new evidence tables.

The batch operators work on a stream as they are: a search is a filter and a
timeline a windowed count.  Late records are counted up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import timestamps
from ..operators.frames import Frame, col, lift
from ..operators.search import SearchQuery, matches


def read(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 100) -> Frame:
    """New Parquet files of a folder as a frame without ordinals."""
    return lift(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder))


def live_search(frame: Frame, query: SearchQuery) -> DataFrame:
    return matches(frame, query).df


def live_timeline(frame: Frame, column: str, width: int, late: str = "10 minutes", year: int | None = None) -> DataFrame:
    """``bucket, count`` (bucket start in Unix seconds), final once the watermark has passed a bucket."""
    name = frame.resolve(column)
    at = F.timestamp_seconds(timestamps.seconds(col(name), frame.df.schema[name].dataType, year))
    stamped = frame.df.withColumn("_at", at).where("_at IS NOT NULL").withWatermark("_at", late)
    counted = stamped.groupBy(F.window("_at", f"{width} seconds")).agg(F.count("*").alias("count"))
    return counted.select(F.unix_timestamp("window.start").alias("bucket"), "count")


def live_counts(frame: Frame, column: str, by: str, width: int, late: str = "10 minutes") -> DataFrame:
    """Value counts for each time bucket."""
    name = frame.resolve(by)
    at = F.timestamp_seconds(timestamps.seconds(col(name), frame.df.schema[name].dataType))
    stamped = frame.df.withColumn("_at", at).where("_at IS NOT NULL").withWatermark("_at", late)
    value = F.coalesce(col(frame.resolve(column)).cast("string"), F.lit(""))
    counted = stamped.where(value != "").groupBy(F.window("_at", f"{width} seconds"), value.alias("value")).agg(F.count("*").alias("count"))
    return counted.select(F.unix_timestamp("window.start").alias("bucket"), "value", "count")


def to_folder(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes a stream to Parquet, exactly once, until all that is there was read."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
