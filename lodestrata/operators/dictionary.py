"""Value dictionaries by batch: encoding, decoding, membership, and whether a dictionary pays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.batching import first_seen

#: A dictionary pays if fewer than this share of the valid values are distinct: single values, whole arrays.
SCALAR_SHARE, TENSOR_SHARE = 0.2, 0.3


def dictionary(batched: DataFrame, field: str, order: str, within: str | None = "batch_id") -> DataFrame:
    """batch_id, code, field: the valid values of each batch, coded in the order of first appearance. Arrays are values like others."""
    keys = [within] if within else []
    return first_seen(batched.where(F.col(field).isNotNull()), [field], order, keys).select(*keys, "code", field)


def encode(batched: DataFrame, field: str, order: str, within: str | None = "batch_id") -> DataFrame:
    """batched with code, by joining each batch's values with its dictionary; a null has code 0, as validity is kept apart."""
    keys = [within] if within else []
    joined = batched.join(dictionary(batched, field, order, within), [*keys, field], "left")
    return joined.withColumn("code", F.coalesce("code", F.lit(0)))


def decode(encoded: DataFrame, values: DataFrame, field: str, valid: Column | None = None, within: str | None = "batch_id") -> DataFrame:
    """encoded with field looked up by code; valid tells which rows aren't null."""
    keys = [within] if within else []
    joined = encoded.join(values, [*keys, "code"], "left")
    return joined.withColumn(field, F.when(valid, F.col(field))) if valid is not None else joined


def decision(batched: DataFrame, fields: list[str], share: float = SCALAR_SHARE) -> DataFrame:
    """batch_id, field, n_distinct, n_valid, use_dict: a field's values are coded where distinct ones are fewer than the share.

    Values are reduced to distinct ones by an ordinary aggregation of (batch, field, value), which salts
    nothing away: its map side has already joined equal values.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    long = batched.select("batch_id", F.explode(each).alias("e")).select("batch_id", "e.field", "e.v")
    kinds = long.groupBy("batch_id", "field", "v").agg(F.count("v").alias("n"))
    found = kinds.groupBy("batch_id", "field").agg(F.count("v").alias("n_distinct"), F.sum("n").alias("n_valid"))
    return found.withColumn("use_dict", F.col("n_distinct") < share * F.col("n_valid"))


def contains(values: DataFrame, field: str, wanted) -> DataFrame:
    """batch_id, matches: entries of each batch's dictionary that equal wanted (0 or 1)."""
    return values.groupBy("batch_id").agg(F.count_if(F.col(field) == F.lit(wanted)).alias("matches"))


def any_element(array: Column, wanted) -> Column:
    """How many elements equal wanted."""
    return F.size(F.filter(array, lambda x: x == F.lit(wanted)))


def equals_array(array: Column, wanted: list) -> Column:
    """Whether the whole array equals wanted; a prefix doesn't."""
    return array == F.array(*[F.lit(x) for x in wanted])


def starts_with(array: Column, wanted: list) -> Column:
    """Whether the array begins with wanted."""
    return F.slice(array, 1, len(wanted)) == F.array(*[F.lit(x) for x in wanted])


def get(values: DataFrame, code: int, within: str | None = None) -> DataFrame:
    """The entry with that code; no row if there is none."""
    return values.where(F.col("code") == code)
