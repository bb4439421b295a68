"""Helpers the operators of this subpackage share: column picking, text expressions, stored tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.scratch import new_path

#: ASCII white space, as a character class for Java's regular expressions and as the characters themselves.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters outside these ranges may have a lower-case form that lower() would apply besides A-Z.
_MAY_FOLD = r"[^\x00-\xBF\xDF-\xFF\x{2000}-\x{20CF}\x{3000}-\x{9FFF}\x{AC00}-\x{D7A3}]"
#: The characters beyond ASCII whose lower-case form has ASCII characters.
_TO_ASCII = r"[\x{130}\x{212A}]"


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under internal names: pick(df, id="doc_id").

    Columns are found by position, so names with dots, or names that differ only in case, do no harm;
    where a name occurs more than once the first counts.
    """
    at = {new: df.columns.index(old) for new, old in names.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def packed(df: DataFrame, name: str = "row") -> Column:
    """A whole row as one struct column, whatever its columns are called; unpacked() undoes it."""
    return F.struct(*[F.col(f"c{i}") for i in range(len(df.columns))]).alias(name)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1 and so on."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def may_fold(text: Column) -> Column:
    """False if lower() changes nothing but A-Z in text. The cheaper pattern settles most texts."""
    return text.rlike(r"[^\x00-\xBF]") & text.rlike(_MAY_FOLD)


def translated(text: Column) -> Column:
    """A-Z lower-cased and nothing else, character by character."""
    return F.translate(text, _UPPER, _LOWER)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does it where no other letter can be touched."""
    return F.when(may_fold(text), translated(text)).otherwise(F.lower(text))


def ascii_lower_key(text: Column) -> Column:
    """A string that two texts share exactly if ascii_lower() of them is equal, and that is cheaper to make.

    It is lower() followed by the text's characters beyond ASCII as they were. Where none of these turns
    into ASCII, they stand in the same places of both texts, so the two parts tell all.
    """
    beyond = F.concat(F.lower(text), F.lit("\n"), F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    return F.when(~text.rlike(r"[^\x00-\x7F]"), F.lower(text)).when(text.rlike(_TO_ASCII), F.concat(F.lit("\n"), translated(text))).otherwise(beyond)


def words(text: Column, separators: str = SPACE) -> Column:
    """The runs of characters between separators, as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{separators}+"), "")


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back: what follows starts from files that any executor can read."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_file(*parts: str) -> str:
    """A path below the tokenizer folder, which TOKENIZER_DIR may name."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), *parts)
