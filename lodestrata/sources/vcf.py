"""VCF: variants with genotypes by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import atof, atoi, string_dictionary
from lodestrata.sources.text import numbered_lines


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, RNAME, POS, NAME, REF, ALT, QUAL, FILTER, INFO (map) and samples (array of text). Lines that begin with # are left out."""
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("#") & (F.col("value") != "")).withColumn("p", F.split("value", "\t"))
    at = lambda i: F.get("p", F.lit(i))
    entries = F.filter(F.split(F.coalesce(at(7), F.lit("")), ";"), lambda x: (x != "") & (x != "."))
    keys = F.array_distinct(F.transform(entries, lambda x: F.split_part(x, F.lit("="), F.lit(1))))
    info = F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.regexp_replace(F.get(F.filter(entries, lambda x: F.split_part(x, F.lit("="), F.lit(1)) == k), F.lit(0)), "^[^=]*=?", "").alias("value"))))
    samples = F.when(F.size("p") > 9, F.slice("p", F.lit(10), F.size("p"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "path", "line_no", at(0).alias("RNAME"), atoi(at(1)).alias("POS"), at(2).alias("NAME"), at(3).alias("REF"), at(4).alias("ALT"), F.when(at(5) != ".", atof(at(5))).cast("float").alias("QUAL"), at(6).alias("FILTER"), info.alias("INFO"), samples.alias("samples")
    )


def genotypes(variants: DataFrame) -> DataFrame:
    """path, line_no, sample, hap, allele: a row for each allele of each sample; a missing allele is null. The field number GT-k is 2 * sample + hap."""
    each = variants.select("path", "line_no", F.posexplode("samples").alias("sample", "call"))
    alleles = F.split(F.split_part("call", F.lit(":"), F.lit(1)), "[|/]")
    return each.select("path", "line_no", "sample", F.posexplode(alleles).alias("hap", "text")).select("path", "line_no", "sample", "hap", F.col("text").try_cast("smallint").alias("allele"))


def with_ids(variants: DataFrame, order: str = "line_no") -> DataFrame:
    """variants with RNAME_id and FILTER_id, each from a dictionary of its own, by first appearance in the order of a column."""
    for c in ("RNAME", "FILTER"):
        ids = string_dictionary(variants, [c], order)
        variants = variants.join(ids.select(F.col("token").alias(c), F.col("id").alias(f"{c}_id")), c, "left")
    return variants


def genotype_columns(variants: DataFrame, samples: int) -> DataFrame:
    """variants with GT-0, GT-1 ...: two alleles for each of the first samples, null where missing."""
    call = lambda k: F.split(F.split_part(F.coalesce(F.get("samples", F.lit(k)), F.lit("")), F.lit(":"), F.lit(1)), "[|/]")
    return variants.select("*", *[F.get(call(k), F.lit(h)).try_cast("smallint").alias(f"GT-{2 * k + h}") for k in range(samples) for h in (0, 1)])
