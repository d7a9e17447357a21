"""Charts of counts: bars as text for a terminal, and chart specifications for a front end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import Panel

#: characters of the longest bar
WIDTH = 40


def bars(counted: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of a count with a ``bar`` as long as their share of the largest one; a count above zero has one mark at least."""
    most = counted.agg(F.max("count").alias("_most"))
    length = F.greatest(F.round(F.col("count") * width / F.col("_most")).cast("int"), (F.col("count") > 0).cast("int"))
    return counted.crossJoin(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("█"), length)).drop("_most")  # one row


def specification(panel: Panel, counted: DataFrame) -> dict:
    """A chart of a panel's few rows in the Vega-Lite grammar."""
    rows = [{"value": r.value, "count": r["count"], "other": r.is_other} for r in counted.collect()]
    count = {"field": "count", "type": "quantitative"}
    value = {"field": "value", "type": "nominal", "sort": [r["value"] for r in rows]}
    mark, encoding = ("arc", {"theta": count, "color": value}) if panel.kind == "pie" else ("bar", {"x": count, "y": value})
    return {"title": panel.column, "data": {"values": rows}, "mark": mark, "encoding": encoding}


def timeline_specification(title: str, buckets: DataFrame, most: int = 10_000) -> dict:
    """A chart of a timeline; ``most`` bounds what is collected, wider timelines are refused."""
    rows = [{"bucket": r.bucket * 1000, "count": r["count"]} for r in buckets.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a chart shows {most} buckets at most; choose a wider bucket")
    encoding = {"x": {"field": "bucket", "type": "temporal"}, "y": {"field": "count", "type": "quantitative"}}
    return {"title": title, "data": {"values": rows}, "mark": "bar", "encoding": encoding}
