"""Reversible column transforms and the rules for combining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.batching import with_ordinal

#: The names of the transforms, compressors first, then encoders.
COMPRESSORS = ("AUTO", "ZSTD", "NONE", "RC_QUAL", "RC_BASES", "RC_ILLUMINA_NAME")
ENCODERS = ("DICT", "DELTA", "DELTA_DELTA", "BASES_2BIT")
MODULUS = 2**32


def valid_order(transforms: list[str]) -> bool:
    """Whether the transforms may follow each other as listed.

    One or none always may. AUTO stands alone; DICT occurs once at most, with no compressor before it and
    no encoder after it. Unknown names raise.
    """
    for t in transforms:
        if t not in COMPRESSORS + ENCODERS:
            raise ValueError(f"unknown transform {t}")
    if len(transforms) < 2:
        return True
    if "AUTO" in transforms or transforms.count("DICT") > 1:
        return False
    if "DICT" not in transforms:
        return True
    at = transforms.index("DICT")
    return not (set(transforms[:at]) & set(COMPRESSORS) or set(transforms[at + 1 :]) & set(ENCODERS))


def _window(order: str, within: str | None) -> Window:
    return (Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))).orderBy(order)


def delta(field: str, order: str, within: str | None = "batch_id") -> Column:
    """Each value less the one before it in its batch (the first less 0), modulo 2^32."""
    c = F.col(field).cast("long")
    return F.pmod(c - F.lag(c, 1, 0).over(_window(order, within)), F.lit(MODULUS))


def prefix_sum(field: str, order: str, within: str | None = "batch_id") -> Column:
    """The running sum modulo 2^32: undoes delta()."""
    return F.pmod(F.sum(F.col(field)).over(_window(order, within).rowsBetween(Window.unboundedPreceding, 0)), F.lit(MODULUS))


def difference(df: DataFrame, field: str, order: str, name: str, times: int = 1, ranges: int = 1_000) -> DataFrame:
    """df with name: field differenced times over, in the order of all rows (the first less 0).

    Differences within a range of the order need that range's rows and the last ones before it, so each
    range also gets copies of the neighbouring range's last rows, and no task sorts the whole table.
    """
    rows = with_ordinal(df, order).withColumn("_part", F.floor(F.col("_ordinal") / ranges).cast("long"))
    inside = F.pmod("_ordinal", F.lit(ranges))
    spread = rows.withColumn("_to", F.explode(F.when(inside >= ranges - times, F.array("_part", F.col("_part") + 1)).otherwise(F.array("_part"))))
    window = Window.partitionBy("_to").orderBy("_ordinal")
    value = F.col(field).cast("long")
    # A term of the difference that lies before the first row is 0.
    signs = {k: (-1) ** k * _choose(times, k) for k in range(times + 1)}
    total = sum((F.lit(s) * F.coalesce(F.lag(value, k).over(window), F.lit(0)) for k, s in signs.items() if k), value)
    return spread.withColumn(name, total).where("_to = _part").drop("_to", "_part", "_ordinal")


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def checksum(text: Column) -> Column:
    """MD5 of a text's or binary's bytes, in hex."""
    return F.md5(text.cast("binary"))


def sha512(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 512)


def batch_checksum(batched: DataFrame, field: str, order: str, separator: str = ",") -> DataFrame:
    """batch_id, digest: the MD5 of a batch's values, joined in order. A batch is bounded, and so is what a task gathers."""
    rows = F.array_sort(F.collect_list(F.struct(order, field)))
    return batched.groupBy("batch_id").agg(F.md5(F.array_join(F.transform(rows, lambda r: r[field]), separator).cast("binary")).alias("digest"))


def bases(text: Column) -> Column:
    """The letters A, C, G, T and N of a text, in upper case."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]", ""))


def two_bit(df: DataFrame, seq: str) -> DataFrame:
    """df with n_bases, codes (a digit 0 to 3 for each base; N is 0) and n_masked (how many are N)."""
    return df.withColumns({"n_bases": F.char_length(seq), "codes": F.translate(seq, "ACGTN", "01230"), "n_masked": F.char_length(seq) - F.char_length(F.replace(seq, F.lit("N"), F.lit("")))})


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pack_bases(df: DataFrame, seq: str) -> DataFrame:
    """df with packed (binary, four bases a byte), n_bases and other (pos, char): all that isn't A, C, G or T as it was, lower case too.

    Built-in functions only: sixteen bases at a time are a number in base four, and eight hexadecimal digits.
    """
    plain = F.translate(F.regexp_replace(seq, "[^ACGT]", "A"), "ACGT", "0123")
    words = F.regexp_extract_all(F.concat(plain, F.repeat(F.lit("0"), F.pmod(-F.char_length(plain), F.lit(16)))), F.lit(".{16}"), F.lit(0))
    digits = F.array_join(F.transform(words, lambda x: F.lpad(F.conv(x, 4, 16), 8, "0")), "")
    packed = F.unhex(F.substring(digits, F.lit(1), F.ceil(F.char_length(seq) / 4).cast("int") * 2))
    other = F.filter(F.transform(F.split(seq, ""), lambda c, i: F.when(~c.isin("A", "C", "G", "T", ""), F.struct(i.alias("pos"), c.alias("char")))), lambda x: x.isNotNull())
    return df.withColumns({"n_bases": F.char_length(seq), "packed": packed, "other": other})


def unpack_bases(df: DataFrame, name: str) -> DataFrame:
    """df with name: the sequence that pack_bases() packed."""
    digits = F.hex("packed")
    words = F.regexp_extract_all(F.concat(digits, F.repeat(F.lit("0"), F.pmod(-F.char_length(digits), F.lit(8)))), F.lit(".{8}"), F.lit(0))
    four = F.array_join(F.transform(words, lambda x: F.lpad(F.conv(x, 16, 4), 16, "0")), "")
    plain = F.translate(F.substring(four, F.lit(1), F.col("n_bases")), "0123", "ACGT")

    def patched(chars: Column) -> Column:
        """The bases before each other character and that character, and what follows the last one."""
        begin = lambda i: F.coalesce(F.get("other", i - 1)["pos"] + 1, F.lit(0))
        parts = F.transform("other", lambda o, i: F.concat(F.array_join(F.slice(chars, begin(i) + 1, o["pos"] - begin(i)), ""), o["char"]))
        last = begin(F.size("other"))
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.col("n_bases") - last, F.lit(0))), ""))

    return df.withColumn(name, F.when(F.size("other") == 0, plain).otherwise(_let(F.split(plain, ""), patched)))
