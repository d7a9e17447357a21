"""Column profiles: what the values of each column look like, over a spread sample or the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantic import classify, trimmed
from .frames import ORDINAL, Frame, col

HEAD, POSITIONS, EACH = 512, 48, 32
EXAMPLES, EXAMPLE_CHARS = 3, 60


def sample_ranges(total: int) -> list[tuple[int, int]]:
    """Record ranges [start, end) of the sample: the head, then short runs spread over the rest."""
    if total <= HEAD + POSITIONS * EACH:
        return [(0, total)]
    starts = [HEAD + (total - HEAD) * (p + 1) // (POSITIONS + 1) for p in range(POSITIONS)]
    return [(0, HEAD)] + [(s, min(total, s + EACH)) for s in starts]


def sample(frame: Frame, total: int | None = None) -> Frame:
    """The records of the sample, by ordinal."""
    total = frame.df.count() if total is None else total
    o, chosen = F.col(ORDINAL), F.lit(False)
    for start, end in sample_ranges(total):
        chosen = chosen | ((o >= start) & (o < end))
    return frame.where(chosen)


def label_counts(frame: Frame, columns: list[str] | None = None) -> DataFrame:
    """``column, label, count``: one pass over all columns."""
    names = columns or [*frame.names, *frame.derived]
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("v")) for n in names))
    values = frame.df.select(F.explode(pairs).alias("p")).select("p.column", "p.v")  # so the rules are compiled once, not once a column
    return values.groupBy("column", classify(F.col("v")).alias("label")).agg(F.count("*").alias("count"))


def sizes(frame: Frame) -> DataFrame:
    """``name, bytes``: the largest size of each column's values, as UTF-8."""
    names = [*frame.names, *frame.derived]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.octet_length(F.coalesce(col(n).cast("string"), F.lit(""))).cast("bigint").alias("bytes")) for n in names))
    return frame.df.select(F.explode(pairs).alias("p")).groupBy("p.name").agg(F.max("p.bytes").alias("bytes"))


def _facts(frame: Frame, names: list[str]) -> DataFrame:
    """One row a column and label: how many, largest size, numeric range, where it was seen first."""
    order = F.col(ORDINAL) if ORDINAL in frame.df.columns else F.lit(0)
    values = F.array(*(F.struct(F.lit(k).alias("index"), F.coalesce(col(n).cast("string"), F.lit("")).alias("v")) for k, n in enumerate(names)))
    rows = frame.df.select(order.alias("o"), F.explode(values).alias("p")).select("o", "p.index", "p.v")
    labelled = rows.withColumn("label", classify(F.col("v"))).withColumn("t", trimmed(F.col("v")))
    number = F.when(F.col("label") == "integer", F.coalesce(F.col("t").try_cast("bigint"), F.lit(-1)))
    return labelled.groupBy("index", "label").agg(
        F.count("*").alias("n"), F.max(F.octet_length("v")).alias("size"), F.min(number).alias("low"), F.max(number).alias("high"), F.min("o").alias("first")
    )


def profile(frame: Frame, whole: bool = False, total: int | None = None) -> list[dict]:
    """A dict for each column: index, name, detected, confidence, sampled, non_empty, distinct, max_len, examples.

    The label is that of most values that are not empty; of equally frequent
    ones the one seen last for the first time.  ``whole`` profiles every record.
    """
    names = [*frame.names, *frame.derived]
    used = frame if whole or ORDINAL not in frame.df.columns else sample(frame, total)
    facts: dict[int, list] = {}
    for r in _facts(used, names).collect():  # columns times labels
        facts.setdefault(r["index"], []).append(r)
    values = F.array(*(F.struct(F.lit(k).alias("index"), trimmed(col(n).cast("string")).alias("t")) for k, n in enumerate(names)))
    kinds = used.df.select(F.explode(values).alias("p")).select("p.index", "p.t").where("t <> ''").distinct().groupBy("index").agg(F.count("*").alias("n"))
    found = {r["index"]: r["n"] for r in kinds.collect()}  # one row a column
    distinct = [found.get(k, 0) for k in range(len(names))]
    order = [F.col(ORDINAL)] if ORDINAL in used.df.columns else []
    head = (used.df.orderBy(*order) if order else used.df).limit(HEAD).select(*(F.substring(trimmed(col(n).cast("string")), 1, 1 << 12).alias(f"c{k}") for k, n in enumerate(names))).collect()
    out = []
    for k, name in enumerate(names):
        rows = facts.get(k, [])
        filled = [r for r in rows if r["label"] != "empty"]
        count = sum(r["n"] for r in filled)
        if filled:
            top = max(filled, key=lambda r: (r["n"], r["first"]))
            label, share = top["label"], top["n"] / count
        else:
            top, label, share = None, "empty", 1.0
        lower = name.lower()
        if label == "integer":
            if "port" in lower and top["low"] >= 0 and top["high"] <= 65535:
                label = "port"
            elif "status" in lower and top["low"] >= 100 and top["high"] <= 599:
                label = "http_status"
        if label == "text" and count >= 20 and distinct[k] <= int(max(10.0, count * 0.05)):
            label = "categorical"
        examples = list(dict.fromkeys(r[k] for r in head if r[k]))[:EXAMPLES]
        out.append(
            {
                "index": k, "name": name, "detected": label, "confidence": share, "sampled": sum(r["n"] for r in rows), "non_empty": count,
                "distinct": distinct[k], "max_len": max((r["size"] for r in rows), default=0), "examples": [e[:EXAMPLE_CHARS] for e in examples],
            }
        )
    return out
