"""FASTQ: four lines a record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import string_split
from lodestrata.sources.text import lines_in_blocks


_COLUMNS = "path string, record bigint, name string, BASES string, QUAL string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, record (from 0 in each file), name, BASES, QUAL. A record that the file's end cuts off lacks what is missing.

    A record's lines stand one after the other, so a task puts them together as it reads. Only records that a
    file block's or the file's end cuts, two a block at most, have their lines brought together by a shuffle.
    """
    lines, ordered = lines_in_blocks(spark, path)
    at = F.col("line_no") - F.col("line_no") % 4
    cut = (at < F.col("first")) | (at + 4 > F.col("end"))
    if not ordered:
        return _gathered(lines)
    whole = lines.where(~cut).select(F.when(F.col("line_no") % 4 == 0, F.col("path")).alias("path"), "line_no", "value")
    return whole.mapInArrow(_records, _COLUMNS).withColumn("name", _name(F.col("name"))).unionByName(_gathered(lines.where(cut)))


def _name(line: Column) -> Column:
    return F.regexp_replace(line, "^@", "")


def _gathered(lines: DataFrame) -> DataFrame:
    """The records of lines in any order."""
    of = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    records = lines.groupBy("path", F.floor(F.col("line_no") / 4).cast("long").alias("record"))
    return records.agg(_name(of(0)).alias("name"), of(1).alias("BASES"), of(3).alias("QUAL"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines in their order, every record whole; path stands with its first line."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if left is not None and left.num_rows:
            table = pa.concat_tables([left, table])
        n = table.num_rows // 4 * 4
        left = table.slice(n)
        if n:
            path, line, value = (table.column(c).slice(0, n).combine_chunks() for c in range(3))
            number = line.to_numpy().reshape(-1, 4)
            if (number[:, 0] % 4).any() or (number[:, 1:] != number[:, :1] + [1, 2, 3]).any():
                raise ValueError("the lines of a record don't follow each other")
            rows = [pa.array(range(k, n, 4), pa.int64()) for k in (0, 1, 3)]
            own = [path.take(rows[0]), pa.array(number[:, 0] // 4), *(value.take(r) for r in rows)]
            yield pa.RecordBatch.from_arrays(own, ["path", "record", "name", "BASES", "QUAL"])
    if left is not None and left.num_rows:
        raise ValueError("the lines of a record don't follow each other")


def name_parts(name: Column) -> Column:
    """The parts of a read's name between spaces, dots, colons and slashes: NAME-1, NAME-2 ... as an array."""
    return string_split(name, " .:/")
