"""URL filters: longest matching host and path rule, through a blocked Bloom filter and an exact join.

A URL's candidates are the suffixes of its host and the prefixes of its path that a rule could have, by
the numbers of labels and characters that occur among the rules. Each candidate is tested in one block of
256 bits of a Bloom filter over the rules; what passes is joined with the rules themselves, which removes
the false positives.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, pick, table

#: Host, path and verdict of the query's rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Bits of the filter for each rule; words of 32 bits in a block.
BITS_PER_RULE, LANES = 16, 8
#: Filters and rule tables are sent to every executor up to this size, and joined by shuffle beyond it.
BROADCAST_BYTES = 64 << 20


def _host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _block(host: str, path: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(host), F.col(path)), F.lit(blocks)).cast("int")


def _bits(host: str, path: str) -> list[Column]:
    """One bit in each of the block's words, from another hash than the block's."""
    h = F.xxhash64(F.lit(1), F.col(host), F.col(path))
    place = lambda i: F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(i)) for i in range(LANES)]


def bloom(rules: DataFrame, n_rules: int) -> tuple[DataFrame, int]:
    """block, w0 to w7: the blocked Bloom filter over the rules' host and path, and its number of blocks."""
    blocks = 2 ** max(0, ceil(log2(max(1, n_rules) * BITS_PER_RULE / (32 * LANES))))
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits("r_host", "r_path"))]
    return rules.groupBy(_block("r_host", "r_path", blocks).alias("block")).agg(*words), blocks


def _canonical(rules: DataFrame) -> DataFrame:
    own = pick(rules, host="host", path="path", verdict="verdict").where("host <> '' and verdict in ('allow', 'block')")
    own = own.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
    return own.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of pages: id, host, path, rule and verdict.

    rules has the columns host, path and verdict (allow or block). A rule fits its host and all its
    subdomains if the URL's path starts with the rule's; of those that fit the longest counts, and of
    equally long ones that with the longer host. rule is its host and path; where none fits it is null
    and the verdict is default. A URL that is null or has no "://" has an empty host and path, which no
    rule fits. Rules with a null or empty host or another verdict are left out, a null path is empty,
    and of rules with one host and path a block counts. Ids may repeat or be null. Without rules all
    get the default.
    """
    listed = _canonical(rules)
    shape = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 32).alias("size")).first()
    n, size = shape["n"], shape["size"] or 0
    host, path = _host_path(F.col("url"))
    rows = pick(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    if not n:
        return rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.size(F.split("r_host", r"\.")).alias("k")
    shapes = sorted((r["k"], r["m"]) for r in listed.select(labels, F.char_length("r_path").alias("m")).distinct().collect())  # pairs of small numbers

    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in shapes])
    fits = F.filter(pairs, lambda p: (F.col("host") != "") & (p["k"] <= F.size(F.split("host", r"\."))) & (p["m"] <= F.char_length("path")))
    each = F.transform(fits, lambda p: F.struct(F.call_function("substring_index", F.col("host"), F.lit("."), -p["k"]).alias("host"), F.substring(F.col("path"), F.lit(1), p["m"]).alias("path")))
    # A null at the end stands for the URL itself.
    spread = rows.select("id", "host", "path", F.explode(F.array_append(each, F.lit(None))).alias("c")).select("id", "host", "path", F.col("c.host").alias("c_host"), F.col("c.path").alias("c_path"))

    sieve, blocks = bloom(listed, n)
    sieve = F.broadcast(sieve) if blocks * (LANES * 8 + 4) <= broadcast_bytes else sieve
    probe = spread.withColumn("own", F.when(F.col("c_host").isNotNull(), _block("c_host", "c_path", blocks)))
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits("c_host", "c_path"))])
    possible = probe.join(sieve, F.col("own") == F.col("block"), "left").where(F.col("c_host").isNull() | passed)
    exact = F.broadcast(listed) if size <= broadcast_bytes else listed
    found = possible.join(exact, (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path")), "left")
    length = F.char_length("r_host") + F.char_length("r_path")
    best = F.max(F.when(F.col("r_host").isNotNull(), F.struct(length.alias("n"), F.char_length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))))
    judged = found.groupBy("id", "host", "path").agg(best.alias("b"), F.count_if(F.col("c_host").isNull()).alias("rows"))
    out = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def query_rules(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return filter_urls(table(spark, sf_dir, "pages"), query_rules(spark)).withColumnRenamed("id", "page_id")


SQL = rf"""
WITH rules AS (SELECT * FROM (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}) t(h, p, v)),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (page_id)
"""
