"""Pruning: which batches can hold rows that a predicate wants, by statistics, dictionary and Bloom filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import bloom, dictionary, stats

#: Batch numbers are sent to every executor up to so many.
BROADCAST_BATCHES = 1_000_000


def surviving(batched: DataFrame, ranges: dict[str, tuple[float, float]] | None = None, members: dict[str, object] | None = None, hashed: dict[str, object] | None = None, order: str = "_ordinal", bits: int = 4096) -> DataFrame:
    """batch_id of the batches that none of the three tests rules out.

    ranges: field -> closed interval, by minimum and maximum; members: field -> value, by the batch's
    dictionary; hashed: field -> value, by the batch's Bloom filter.
    """
    keep = None
    if ranges:
        found = stats.segment_stats(batched, list(ranges))
        each = reduce(lambda a, b: a | b, [(F.col("field") == f) & ~stats.overlaps(F.col("min_v"), F.col("max_v"), a, b, F.col("n_null"), F.col("n_records")) for f, (a, b) in ranges.items()])
        keep = found.groupBy("batch_id").agg(F.count_if(each).alias("out")).where("out = 0").select("batch_id")
    for f, value in (members or {}).items():
        has = dictionary.contains(dictionary.dictionary(batched, f, order), f, value).where("matches > 0").select("batch_id")
        keep = has if keep is None else keep.join(has, "batch_id", "left_semi")
    for f, value in (hashed or {}).items():
        may = bloom.may_have(batched, f, value, bits, ["batch_id"])
        keep = may if keep is None else keep.join(may, "batch_id", "left_semi")
    return keep if keep is not None else batched.select("batch_id").distinct()


def pruned_scan(batched: DataFrame, batches: DataFrame, exact: Column) -> DataFrame:
    """The rows of those batches that satisfy the exact predicate."""
    few = batches.limit(BROADCAST_BATCHES + 1).count() <= BROADCAST_BATCHES
    return batched.join(F.broadcast(batches) if few else batches, "batch_id", "left_semi").where(exact)
