"""Numbered lines and tabular text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Up to so many file blocks, their counts are broadcast.
MAX_BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0 in each file), value.

    Lines are counted by file block first; a line's number is what the file's blocks before its own hold,
    and its place in the block. The blocks' counts are sent to every executor if they are few.
    """
    return lines_in_blocks(spark, path)[0].select("path", "line_no", "value")


def lines_in_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """numbered_lines() with first and end, the numbers between which the lines of a line's file block lie (end not included), and whether a task still has its lines in their order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "_first", before.alias("first"), (before + F.col("_n")).alias("end"))
    few = starts.limit(MAX_BLOCKS + 1).count() <= MAX_BLOCKS
    numbered = lines.join(F.broadcast(starts) if few else starts, ["path", "block"])
    return numbered.select("path", (F.col("first") + F.col("_id") - F.col("_first")).alias("line_no"), "value", "first", "end"), few


#: The columns of tab-separated annotation formats.
FORMATS = {
    "bed": [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("name", "string"), ("score", "double"), ("strand", "string")],
    "gff3": [("seqid", "string"), ("source", "string"), ("type", "string"), ("start", "bigint"), ("end", "bigint"), ("score", "string"), ("strand", "string"), ("phase", "string"), ("attributes", "string")],
    "gtf2": [("seqname", "string"), ("source", "string"), ("feature", "string"), ("start", "bigint"), ("end", "bigint"), ("score", "string"), ("strand", "string"), ("frame", "string"), ("attributes", "string")],
}


def tabular(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a BED, GFF3 or GTF2 file; lines that begin with # are left out, missing trailing columns are null."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").rlike("^(track|browser)[ \t]") & (F.trim("value") != ""))
    return rows.select(*[F.get(parts, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(FORMATS[kind])])


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """path, record (from 0), name, seq: a sequence's lines joined. A sequence is gathered in one task, as it becomes one value."""
    lines = numbered_lines(spark, path)
    heads = lines.withColumn("head", F.col("value").startswith(">"))
    window = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    each = heads.withColumn("record", F.sum(F.col("head").cast("int")).over(window) - 1)
    rows = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "value"))))
    return each.groupBy("path", "record").agg(F.max(F.when(F.col("head"), F.substring("value", F.lit(2), F.char_length("value")))).alias("name"), F.array_join(F.transform(rows, lambda r: F.trim(r["value"])), "").alias("seq"))
