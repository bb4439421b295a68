"""The two array layouts: one column for each position, and offsets with flat data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.batching import with_ordinal


def gathered(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """key and the array of its values in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r[value]).alias(name))


def split_columns(df: DataFrame, array: str, prefix: str, width: int | None = None) -> DataFrame:
    """df with prefix_0, prefix_1 ... instead of the array: null where it is shorter. width: the longest array's length, found if not given."""
    if width is None:
        width = df.agg(F.max(F.size(array))).first()[0] or 0
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(f"{prefix}_{i}") for i in range(max(width, 0))])


def offsets(df: DataFrame, order: str, size: Column) -> DataFrame:
    """order, off_start, off_end: where each row's elements lie in the flat data; a null array takes no room.

    Sums of ranges of the key are added up first, so that no task walks over all rows.
    """
    sized = with_ordinal(df.select(order, F.coalesce(size, F.lit(0)).cast("long").alias("_len")), order).withColumn("_part", F.floor(F.col("_ordinal") / 100_000))
    parts = sized.groupBy("_part").agg(F.sum("_len").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_len").over(Window.partitionBy("_part").orderBy("_ordinal").rowsBetween(Window.unboundedPreceding, 0))
    joined = sized.join(parts.select("_part", before.alias("_before")), "_part").withColumn("off_end", F.col("_before") + inside)
    return joined.select(order, (F.col("off_end") - F.col("_len")).alias("off_start"), "off_end")


def elements(df: DataFrame, key: str, array: str) -> DataFrame:
    """key, pos, element: one row for each element of an array."""
    return df.select(key, F.posexplode(array).alias("pos", "element"))


def tensors(flat: DataFrame, spans: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The arrays back from flat data (order from 0, value) and offsets (key, off_start, off_end); empty spans give empty arrays."""
    each = spans.select(key, F.explode_outer(F.when(F.col("off_end") > F.col("off_start"), F.sequence("off_start", F.col("off_end") - 1))).alias(order))
    joined = each.join(flat, order, "left")
    rows = F.array_sort(F.collect_list(F.when(F.col(order).isNotNull(), F.struct(order, value))))
    return joined.groupBy(key).agg(F.transform(rows, lambda r: r[value]).alias(value))
