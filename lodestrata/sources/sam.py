"""SAM: tab-separated alignments with optional tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import atoi, string_dictionary, tag
from lodestrata.sources.text import numbered_lines

#: Parts of a read's name between colons, and whether each is a number.
NAME_PARTS = (("NAME-1", False), ("NAME-2", True), ("NAME-3", False), ("NAME-4", True), ("NAME-5", True), ("NAME-6", True), ("NAME-7", True))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, NAME-1 ... NAME-7, FLAG, RNAME, POS, MAPQ, CIGAR, RNEXT, PNEXT, TLEN, BASES, QUAL and tags.

    Header lines (@) are left out. Numbers are what a field begins with, or 0. tags maps a tag's name to
    its type and text; a repeated tag counts where it comes last.
    """
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("p", F.split("value", "\t"))
    at = lambda i: F.get("p", F.lit(i))
    name = lambda i: F.get(F.split(at(0), ":"), F.lit(i))
    names = [(F.when(name(i).isNotNull(), atoi(name(i))) if number else name(i)).alias(n) for i, (n, number) in enumerate(NAME_PARTS)]
    tags = F.transform(F.when(F.size("p") > 11, F.slice("p", F.lit(12), F.size("p"))).otherwise(F.array().cast("array<string>")), tag)
    # A map may not hold a key twice: only the last of equal names stays.
    last = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, i + 2, F.size(tags)), lambda u: u["tag"] == t["tag"]))
    pairs = F.transform(last, lambda t: F.struct(t["tag"].alias("key"), F.struct(t["tag_type"].alias("type"), t["tag_value"].alias("value")).alias("value")))
    return rows.select(
        "path", "line_no", *names,
        atoi(at(1), "int").alias("FLAG"), at(2).alias("RNAME"), atoi(at(3)).alias("POS"), atoi(at(4), "smallint").alias("MAPQ"), at(5).alias("CIGAR"),
        at(6).alias("RNEXT"), atoi(at(7), "int").alias("PNEXT"), atoi(at(8), "int").alias("TLEN"), at(9).alias("BASES"), at(10).alias("QUAL"), F.map_from_entries(pairs).alias("tags"),
    )


def tag_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with a column for each tag: names maps a tag to i (bigint, signed), f (double) or any other type (text)."""
    kinds = {"i": "bigint", "f": "double"}
    return df.select("*", *[F.try_element_at("tags", F.lit(n))["value"].try_cast(kinds.get(t, "string")).alias(n) for n, t in names.items()])


def with_reference_ids(df: DataFrame, order: str = "line_no") -> DataFrame:
    """df with RNAME_id and RNEXT_id from one dictionary over both columns, by first appearance in the order of a column."""
    ids = string_dictionary(df, ["RNAME", "RNEXT"], order)
    for c in ("RNAME", "RNEXT"):
        df = df.join(ids.select(F.col("token").alias(c), F.col("id").alias(f"{c}_id")), c, "left")
    return df
