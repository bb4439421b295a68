"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks.

Sources get targets by weight; equal blocks of words are handed to sources by the highest quotients, and
each source's blocks to its shards the same way. A shard is a bounded part of a source, chosen by hash;
its documents stand in a seeded order and the words of a quota are whole passes over the shard and then
consecutive blocks of that order from a seeded block on. Texts are never moved, only their sizes.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import numbered, pick, stored, table, words

#: Weights of the sources in the order of their names, repeating; and how often a source may be used.
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words in a block; words and documents that a shard should have at most.
BLOCK, SHARD, SHARD_ROWS = 100, 500_000, 2_048
#: A source is cut into no more shards than this; beyond, its shards grow. One task apportions a source's blocks to its shards.
MAX_SHARDS = 1 << 16
#: More sources than this are refused: their table is worked on in the driver.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """The sizes' sum, shared by weight; no share exceeds repeats times its size, and what is over is shared again.

    A share is the lesser of its cap and of one common level times its weight. The level that uses
    everything up is found by taking out capped shares until none is above its cap.
    """
    caps, left, open_ = [repeats * s for s in sizes], sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        level = Fraction(left, sum(weights[i] for i in open_))
        full = [i for i in open_ if weights[i] * level >= caps[i]]
        if not full:
            for i in open_:
                out[i] = float(weights[i] * level)
            break
        for i in full:
            out[i] = float(caps[i])
            left -= caps[i]
            open_.discard(i)
    return out


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Seats for each share by the highest quotients share / 1, 3, 5 ...; equal quotients go to the earlier share.

    A share s has round(s / d) seats for a divisor d. The least divisor that hands out no seat too many is
    found by halving; it is enlarged by a hair, so that every seat that it gives lies above all that are
    left, and these go one at a time by their quotients.
    """
    own = np.array(shares, float)
    total = own.sum() if len(own) else 0.0
    if seats <= 0 or not total:
        return [0] * len(shares)
    given = lambda d: np.floor(own / d + 0.5)
    low, high = total / (seats + len(own) + 1), 4 * total / seats + own.max() * 4
    while low * (1 + 1e-14) < high:
        mid = (low + high) / 2
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    out = given(high * (1 + 1e-9)).astype(np.int64).tolist()
    heap = [(-s / (2 * n + 1), i) for i, (s, n) in enumerate(zip(shares, out, strict=True))]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-shares[i] / (2 * out[i] + 1), i))
    return out


def _apportion_shards(shards: DataFrame) -> DataFrame:
    """src, shard, words, quota: the blocks that each shard gets of its source's. shards: src, shard, words, blocks (the source's).

    A source has at most MAX_SHARDS shards, and a task works on the few numbers of one source's shards.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        return part.assign(quota=sainte_lague(part["words"].tolist(), int(part["blocks"].iloc[0])))[["src", "shard", "words", "quota"]]

    return shards.groupBy("src").applyInPandas(run, "src string, shard int, words long, quota long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, shard: int = SHARD, shard_rows: int = SHARD_ROWS, seed: int = 10) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken.

    size is the number of the text's words; null and blank texts have none, and none is taken of them.
    Sources are weighed in the order of their code points, a null source last and a source like any
    other. taken is how many of the text's words the mix takes, repeats counted; equal rows (id, text
    and source) are interchangeable, and null ids do no harm. An empty table, or one without words,
    gives targets and takings of zero. Runs with one seed agree, however the rows are dealt out.
    """
    sized = stored(
        pick(docs, id=id_col, text=text_col, source=source_col)
        .select("id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("id"), F.col("text")).alias("order")),
        "sizes",
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = by_source.limit(MAX_SOURCES + 1).collect()  # a table of sources, refused if it isn't small
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [r["source_size"] for r in rows]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeats)
    quotas = sainte_lague(goals, round(sum(sizes) / block))
    # Documents without words take room as well, so rows count as words do.
    shards = [min(MAX_SHARDS, max(1, -(-r["source_size"] // shard), -(-r["n"] // shard_rows))) for r in rows]
    plan = docs.sparkSession.createDataFrame(
        [(r["source"], s, g, min(q, repeats * s // block), k, g >= repeats * s) for r, s, g, q, k in zip(rows, sizes, goals, quotas, shards, strict=True)], "src string, source_size long, target double, blocks long, shards int, full boolean"
    )
    plan = F.broadcast(plan) if len(rows) <= 10_000 else plan
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn("shard", F.pmod(F.xxhash64("order"), F.col("shards")).cast("int")).drop("src")

    parts = dealt.groupBy(F.col("source").alias("src"), "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    quota = _apportion_shards(parts).select("src", F.col("shard").alias("part"), "words", F.least(F.col("quota") * block, F.col("words") * repeats).alias("quota"))
    if sum(shards) <= 100_000:
        quota = F.broadcast(quota)
    joined = dealt.join(quota, F.col("source").eqNullSafe(F.col("src")) & (F.col("shard") == F.col("part")))
    order = Window.partitionBy("source", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = joined.withColumn("lo", F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("hi", F.col("lo") + F.col("size"))
    # A source whose target is all that it may give is used in full, whatever is left over after its last block.
    start = start.withColumn("quota", F.when(F.col("full"), F.col("words") * repeats).otherwise(F.col("quota")))
    passes, rest = F.floor(F.col("quota") / F.greatest("words", F.lit(1))).cast("long"), F.pmod(F.col("quota"), F.greatest("words", F.lit(1)))
    first = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("shard")), F.greatest(F.ceil(F.col("words") / block), F.lit(1))) * block
    placed = start.withColumns({"passes": passes, "rest": rest, "from": first})
    covers = lambda lo, hi: F.greatest(F.least(F.col("hi"), hi) - F.greatest(F.col("lo"), lo), F.lit(0))
    to = F.col("from") + F.col("rest")
    taken = F.col("passes") * F.col("size") + covers(F.col("from"), F.least(to, F.col("words"))) + covers(F.lit(0), to - F.col("words"))
    return placed.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of mix() of which the mix takes words."""
    return mix(docs, id_col, text_col, source_col).where("taken > 0")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
