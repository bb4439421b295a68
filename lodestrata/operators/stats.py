"""Segment statistics: minimum, maximum and counts by batch, the overlap predicate, and field reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _valid(df: DataFrame, field: str) -> Column:
    """The field without NaN, which has no place between a minimum and a maximum."""
    c = F.col(field)
    return F.when(~F.isnan(c), c) if isinstance(df.schema[field].dataType, (T.DoubleType, T.FloatType)) else c


def segment_stats(batched: DataFrame, fields: list[str]) -> DataFrame:
    """batch_id, field, n_records, n_null, min_v, max_v (double) for every batch and scalar field, from one aggregation.

    NaN counts as a record but not for the extremes; a batch without valid values has null extremes.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        v = _valid(batched, f)
        aggs += [F.count_if(F.col(f).isNull()).alias(f"u{i}"), F.min(v).cast("double").alias(f"lo{i}"), F.max(v).cast("double").alias(f"hi{i}")]
    wide = batched.groupBy("batch_id").agg(*aggs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n_records"), F.col(f"u{i}").alias("n_null"), F.col(f"lo{i}").alias("min_v"), F.col(f"hi{i}").alias("max_v")) for i, f in enumerate(fields)])
    return wide.select("batch_id", F.explode(each).alias("s")).select("batch_id", "s.*")


def column_stats(batched: DataFrame, fields: list[str]) -> DataFrame:
    """batch_id, field, n_records, n_elements, n_null, min_v, max_v (double) of every column: extremes of numbers, and of the elements of number arrays.

    n_elements counts the elements of arrays, and the valid values otherwise.
    """
    numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        t, null = batched.schema[f].dataType, F.lit(None).cast("double")
        lo, hi = null, null
        size = F.count(f)
        if isinstance(t, numbers):
            lo, hi = F.min(_valid(batched, f)).cast("double"), F.max(_valid(batched, f)).cast("double")
        elif isinstance(t, T.ArrayType):
            size = F.coalesce(F.sum(F.when(F.col(f).isNotNull(), F.size(f))), F.lit(0))
            if isinstance(t.elementType, numbers):
                own = F.filter(f, lambda x: ~F.isnan(x.cast("double")))
                lo, hi = F.min(F.array_min(own)).cast("double"), F.max(F.array_max(own)).cast("double")
        aggs += [F.count_if(F.col(f).isNull()).alias(f"u{i}"), size.cast("long").alias(f"e{i}"), lo.alias(f"lo{i}"), hi.alias(f"hi{i}")]
    wide = batched.groupBy("batch_id").agg(*aggs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n_records"), F.col(f"e{i}").alias("n_elements"), F.col(f"u{i}").alias("n_null"), F.col(f"lo{i}").alias("min_v"), F.col(f"hi{i}").alias("max_v")) for i, f in enumerate(fields)])
    return wide.select("batch_id", F.explode(each).alias("s")).select("batch_id", "s.*")


def tensor_stats(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """id, min_e, max_e, n_elements of an array column's elements, by row."""
    return df.select(id_col, F.array_min(field).alias("min_e"), F.array_max(field).alias("max_e"), F.size(field).alias("n_elements"))


def overlaps(low: Column, high: Column, a: float, b: float, nulls: Column | None = None, records: Column | None = None) -> Column:
    """Whether the closed interval between a and b (in any order) can meet values between low and high.

    Without extremes the answer is true, unless nulls and records say that there are only nulls.
    """
    known = (F.lit(max(a, b)) >= low) & (high >= F.lit(min(a, b)))
    unknown = F.lit(True) if nulls is None else nulls < records
    return F.when(low.isNull() | high.isNull(), unknown).otherwise(known)


def field_report(batched: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """field, ptype, layout, n (valid rows), n_batches (that have any row), for fields: name -> (ptype, layout)."""
    aggs = [F.count(f).alias(f"n{i}") for i, f in enumerate(fields)]
    one = batched.agg(F.countDistinct("batch_id").alias("b"), *aggs)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("ptype"), F.lit(layout).alias("layout"), F.col(f"n{i}").alias("n"), F.col("b").alias("n_batches")) for i, (f, (p, layout)) in enumerate(fields.items())])
    return one.select(F.explode(each).alias("r")).select("r.*")


def occurrences(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_valid, n_null over all rows."""
    one = df.agg(*[e for i, f in enumerate(fields) for e in (F.count(f).alias(f"v{i}"), F.count_if(F.col(f).isNull()).alias(f"u{i}"))])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v{i}").alias("n_valid"), F.col(f"u{i}").alias("n_null")) for i, f in enumerate(fields)])
    return one.select(F.explode(each).alias("r")).select("r.*")


def compression_fold(stats: DataFrame) -> DataFrame:
    """field, n_columns, u_sz, c_sz, fold: sizes by field from the table of column sizes (field, batch_id, column_no, u_sz, c_sz); fold is 0 without bytes."""
    by_batch = stats.groupBy("field", "batch_id").agg(F.countDistinct("column_no").alias("n"), F.sum("u_sz").alias("u"), F.sum("c_sz").alias("c"))
    whole = by_batch.groupBy("field").agg(F.avg("n").alias("n_columns"), F.sum("u").alias("u_sz"), F.sum("c").alias("c_sz"))
    return whole.withColumn("fold", F.coalesce(F.try_divide(F.col("u_sz"), F.col("c_sz")), F.lit(0.0)))
