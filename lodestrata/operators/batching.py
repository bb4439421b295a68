"""Ordinals, record batches, and ids by first appearance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a record batch.
BATCH = 65_536
#: Rows that a range of the order key should have, which one task sorts and numbers.
RANGE = 1 << 20


def _range_of(key: Column, cuts: list[float]) -> Column:
    """How many cuts lie below key, by halving: a few comparisons a row, however many cuts there are."""
    if not cuts:
        return F.lit(0)
    held = F.lit(np.array(cuts, float))
    steps = F.lit(np.array([1 << i for i in reversed(range(len(cuts).bit_length()))], np.int32))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) < key, at + step).otherwise(at))


def with_ordinal(df: DataFrame, order: str, name: str = "_ordinal") -> DataFrame:
    """df with each row's place (bigint, from 0) in the order of a numeric or time column without repeats.

    The key's quantiles cut it into ranges of about equal size, as many as the rows need. Rows are numbered
    within their range, and what the ranges before it hold is added, so no task sorts more than a range.
    Nulls come first.
    """
    key = F.col(order).cast("double")
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted({c for c in (df.agg(F.percentile_approx(key, shares, 10 * ranges)).first()[0] or []) if c is not None}) if shares else []
    dealt = df.withColumn("_range", F.when(key.isNull(), F.lit(-1)).otherwise(_range_of(key, cuts)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one small row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_range", before.alias("_before")))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return dealt.join(offsets, "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_range", "_before")


def assign_batches(df: DataFrame, order: str, size: int = BATCH, name: str = "batch_id") -> DataFrame:
    """df with _ordinal and the number of each row's batch: size rows in a row."""
    return with_ordinal(df, order).withColumn(name, F.floor(F.col("_ordinal") / size).cast("int"))


def batch_summary(batched: DataFrame, id_col: str) -> DataFrame:
    """batch_id, n_rec, first_id, last_id."""
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rec"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def first_seen(df: DataFrame, keys: list[str], order: Column | str, within: list[str] | None = None, name: str = "code") -> DataFrame:
    """The distinct keys with a dense id from 0 in the order of their first appearance; within: numbered apart for each of these.

    Rows are reduced to one per key before the shuffle. Only the distinct keys of one group meet in a task.
    """
    within = within or []
    order = F.col(order) if isinstance(order, str) else order
    kinds = df.groupBy(*within, *keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy(*within).orderBy("_first") if within else Window.orderBy("_first")
    return kinds.withColumn(name, (F.row_number().over(window) - 1).cast("int"))


def null_padded_union(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, columns by name in the order of first appearance, null where a frame has no such column.

    A column of two types raises, and names both.
    """
    seen: dict[str, str] = {}
    for df in frames:
        for name, kind in df.dtypes:
            if seen.setdefault(name, kind) != kind:
                raise TypeError(f"{name} is both {seen[name]} and {kind}")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
