"""Text functions of the parsers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.batching import first_seen


def string_split(text: Column, delimiters: str = " ", keep_empty: bool = False) -> Column:
    """The parts between any of the delimiter characters, without empty ones; with keep_empty only an empty last one goes."""
    parts = F.split(text, "[" + "".join(re.escape(c) for c in delimiters) + "]")
    if not keep_empty:
        return F.filter(parts, lambda x: x != "")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def atoi(text: Column, kind: str = "long") -> Column:
    """The whole number at the beginning of a text, or 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast(kind), F.lit(0).cast(kind))


def atof(text: Column) -> Column:
    """The number at the beginning of a text, or 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def tag(text: Column) -> Column:
    """A struct tag, tag_type, tag_value of NAME:TYPE:data; data may hold colons."""
    at = lambda i: F.regexp_extract(text, r"^([^:]*):([^:]*):([\s\S]*)$", i)
    return F.struct(at(1).alias("tag"), at(2).alias("tag_type"), at(3).alias("tag_value"))


def string_dictionary(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """token, id: the strings of several columns in one dictionary, by first appearance; within a row the earlier column comes first."""
    each = df.select(order, F.posexplode(F.array(*columns)).alias("slot", "token")).where(F.col("token").isNotNull())
    return first_seen(each, ["token"], F.struct(order, "slot"), name="id").select("token", "id")
