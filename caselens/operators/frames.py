"""Evidence frames: a DataFrame of named text columns with a record ordinal and the record's raw bytes.

``_ordinal`` numbers the records from 0 in source order and ``_raw`` holds each
record as it stood, without its terminator.  In a frame read from a file a
missing field is null and a present empty one is ``''``.  ``lift`` gives any
table these two columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import quoted

ORDINAL, RAW, FIELDS = "_ordinal", "_raw", "_fields"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


@dataclass(frozen=True)
class Frame:
    """``df`` with its data columns in order; ``derived`` ones are computed and are not in ``_raw``."""

    df: DataFrame
    names: tuple[str, ...]
    derived: tuple[str, ...] = ()
    delimiter: str = ","
    quote: str | None = '"'
    options: dict = field(default_factory=dict, compare=False)

    def resolve(self, spec: str | int) -> str:
        """A column by name or index; a number is always an index, and the first of equal names wins."""
        every = (*self.names, *self.derived)
        text = str(spec)
        if text.lstrip("+").isdigit():
            if int(text) >= len(every):
                raise ValueError(f"column {text} is out of range: there are {len(every)}")
            return every[int(text)]
        if text not in every:
            raise ValueError(f"no column named {text!r}; there are: {', '.join(every)}")
        return text

    def index(self, spec: str | int) -> int:
        return (*self.names, *self.derived).index(self.resolve(spec))

    def where(self, condition: Column) -> Frame:
        return replace(self, df=self.df.where(condition))

    def with_df(self, df: DataFrame, derived: tuple[str, ...] | None = None) -> Frame:
        return replace(self, df=df, derived=self.derived if derived is None else derived)


def raw_of(df: DataFrame, names: list[str], delimiter: str = ",", quote: str | None = '"') -> Column:
    """The record as CSV text with as little quoting as it needs; numbers, dates and truth values need none."""
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType) if delimiter in ",;|\t" and quote in ('"', None) else ()

    def field(n: str) -> Column:
        return F.coalesce(col(n).cast("string"), F.lit("")) if isinstance(df.schema[n].dataType, plain) else quoted(col(n), delimiter, quote)

    return F.concat_ws(delimiter, *map(field, names))


def with_ordinal(df: DataFrame, order_by: str, name: str = ORDINAL) -> DataFrame:
    """Dense 0-based numbers in the order of a numeric, date or timestamp key (equal keys by a hash of the row).

    No single task sees all rows: the key's range is cut at approximate
    quantiles, ranges are numbered apart, and the counts of the ranges before
    are added.
    """
    spark = df.sparkSession
    key = df.schema[order_by].dataType.simpleString()
    number = col(order_by).cast("timestamp").cast("double") if key.startswith(("timestamp", "date")) else col(order_by).cast("double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits = sorted(set(df.select(number.alias("k")).approxQuantile("k", [k / parts for k in range(1, parts)], 0.001))) if parts > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= number)) if splits else F.lit(0)
    cut = df.withColumn("_range", F.when(number.isNull(), -1).otherwise(place))
    # one row a range: a window over them is small whatever the table
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    hashed = [c.name for c in df.schema if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()]
    own = F.row_number().over(Window.partitionBy("_range").orderBy(col(order_by), F.xxhash64(*map(col, hashed))))
    numbered = cut.withColumn("_own", own).join(F.broadcast(before), F.col("_range") == F.col("_r"))
    return numbered.withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("bigint")).drop("_range", "_r", "_own", "_before")


def lift(df: DataFrame, columns: list[str] | None = None, order_by: str | None = None, delimiter: str = ",", quote: str | None = '"') -> Frame:
    """Any table as a frame; ``_ordinal`` follows ``order_by``, and is left out without one."""
    names = columns or [c for c in df.columns if c not in (ORDINAL, RAW)]
    if order_by:
        df = with_ordinal(df, order_by)
    return Frame(df.withColumn(RAW, raw_of(df, names, delimiter, quote)), tuple(names), delimiter=delimiter, quote=quote)
