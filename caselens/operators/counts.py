"""Value counts, distinct counts and dashboard panels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Frame, col

TOP_PANEL, TOP_PIE, TOP_BARS, MAX_PANELS = 12, 7, 10, 6
# Names of columns that are charted first.
VERDICTS = "label labels verdict action result severity status proto protocol class category".split()


@dataclass(frozen=True)
class Totals:
    counted: int
    empty: int
    distinct: int


def _value(frame: Frame, column: str) -> Column:
    return F.coalesce(col(frame.resolve(column)).cast("string"), F.lit(""))


def value_counts(frame: Frame, column: str, top: int | None = 20) -> DataFrame:
    """``value, count``: most frequent first, then by value; empty and missing values are not listed."""
    counted = frame.df.select(_value(frame, column).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("count"))
    return counted if top is None else counted.orderBy(F.desc("count"), "value").limit(top)


def totals(frame: Frame, column: str) -> DataFrame:
    """One row ``counted, empty, distinct``; values are grouped before they are counted, so nothing is gathered by value."""
    by_value = frame.df.select(_value(frame, column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    empty = F.col("value") == ""
    return by_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("counted"),
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.when(~empty, 1)), F.lit(0)).cast("bigint").alias("distinct"),
    )


def value_shares(frame: Frame, column: str, top: int = 20) -> DataFrame:
    """``value, count, share`` of all selected records, empty ones among them."""
    by_value = frame.df.select(_value(frame, column).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    whole = by_value.agg(F.sum("count").alias("counted"))
    listed = by_value.where("value <> ''").orderBy(F.desc("count"), "value").limit(top)
    return listed.crossJoin(F.broadcast(whole)).select("value", "count", (F.col("count") / F.col("counted")).alias("share"))  # one row


def approximate_distinct(frame: Frame, column: str, error: float = 0.008) -> DataFrame:
    """An estimate by HyperLogLog, for columns of nearly unique values."""
    value = _value(frame, column)
    return frame.df.agg(F.approx_count_distinct(F.when(value != "", value), error).alias("distinct"))


def bounded_counts(frame: Frame, column: str, capacity: int = 1 << 16) -> tuple[DataFrame, int]:
    """``value, count`` of at most ``capacity`` values, and the bound of what any count lacks.

    Each task keeps ``capacity`` counters (Misra and Gries); those of sixteen tasks
    are merged by one, in rounds.  A
    count is never above the true one; a value that is not listed occurred
    no more often than the bound.  With no more values than counters all is exact and
    the bound is 0.
    """
    spark = frame.df.sparkSession
    values = frame.df.select(_value(frame, column).alias("value")).where("value <> ''").select("value", F.lit(1).cast("long").alias("count"))
    schema = "value string, count long"
    kept = values.mapInArrow(_counters(capacity), schema)  # a null value has what was taken from every counter
    parts = kept.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        kept = kept.repartition(parts).mapInArrow(_counters(capacity), schema)
    rows = kept.toArrow()  # at most ``capacity`` values, in one partition
    lost = sum(n for v, n in zip(rows["value"].to_pylist(), rows["count"].to_pylist(), strict=True) if v is None)
    return spark.createDataFrame(rows.filter(rows["value"].is_valid())), lost


def _counters(capacity: int):
    def run(batches):
        import pyarrow as pa

        held: dict[str, int] = {}
        lost = 0
        for batch in batches:
            known = batch.column("value").is_valid()
            lost += sum(batch.filter(pa.compute.invert(known)).column("count").to_pylist())
            table = pa.Table.from_batches([batch.filter(known)]).group_by("value").aggregate([("count", "sum")])
            for value, n in zip(table["value"].to_pylist(), table["count_sum"].to_pylist(), strict=True):
                held[value] = held.get(value, 0) + n
            if len(held) > capacity:  # what the first counter beyond the capacity has is taken from all
                least = sorted(held.values(), reverse=True)[capacity]
                held = {v: n - least for v, n in held.items() if n > least}
                lost += least
        yield pa.RecordBatch.from_pydict({"value": pa.array([*held, None], pa.string()), "count": pa.array([*held.values(), lost], pa.int64())})

    return run


def approximate_top(frame: Frame, column: str, top: int = 20, kept: int = 10_000) -> DataFrame:
    """``value, count`` by a sketch of bounded size; counts are estimates."""
    value = _value(frame, column)
    found = frame.df.where(value != "").select(value.alias("value")).agg(F.expr(f"approx_top_k(value, {top}, {max(top, kept)})").alias("t"))
    return found.select(F.explode("t").alias("t")).select(F.col("t.item").alias("value"), F.col("t.count").alias("count"))


def with_other(frame: Frame, column: str, shown: int = TOP_PIE, label: str = "other") -> DataFrame:
    """``value, count, is_other``: the most frequent values and all the rest, empty ones among it, as one row."""
    by_value = frame.df.select(_value(frame, column).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    listed = by_value.where("value <> ''").orderBy(F.desc("count"), "value").limit(shown)
    whole = by_value.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    named = listed.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("m"))
    other = whole.crossJoin(F.broadcast(named)).select(F.lit(label).alias("value"), (F.col("n") - F.col("m")).alias("count"), F.lit(True).alias("is_other"))  # one row each
    return listed.withColumn("is_other", F.lit(False)).unionByName(other.where("count > 0"))


@dataclass(frozen=True)
class Panel:
    column: str
    kind: str  # pie or bars


def panels(profile: list[dict]) -> list[Panel]:
    """Up to six panels for what a profile's columns hold, in column order."""
    picks = []
    for c in profile:
        label, few, name = c["detected"], c["distinct"], c["name"].lower()
        listed = label in ("categorical", "http_status")
        if label == "boolean" or listed and few <= 8:
            picks.append((1, c["index"], c["name"], "pie"))
        elif listed and name in VERDICTS:
            picks.append((1, c["index"], c["name"], "bars"))
        elif listed and few <= 60:
            picks.append((3, c["index"], c["name"], "bars"))
        elif label in ("domain", "url", "email", "ipv4", "ipv6", "ip:port"):
            picks.append((2, c["index"], c["name"], "bars"))
        elif label in ("port", "mac"):
            picks.append((3, c["index"], c["name"], "bars"))
    chosen = sorted(sorted(picks)[:MAX_PANELS], key=lambda p: p[1])
    return [Panel(name, kind) for _, _, name, kind in chosen]


def panel_data(frame: Frame, panel: Panel) -> DataFrame:
    """What a panel shows."""
    if panel.kind == "pie":
        return with_other(frame, panel.column)
    return value_counts(frame, panel.column, TOP_BARS).withColumn("is_other", F.lit(False))
