"""SimHash near-duplicates: fingerprints, links at a small Hamming distance, and their components.

Equal fingerprints are reduced to one first, so groups of copies cost one row. Fingerprints are then cut
into blocks; close ones agree on some of them, whichever bits differ, so a join on these blocks finds
every close pair (pigeonhole), and the Hamming distance is verified in the join. Buckets of that join
that hold very many fingerprints don't make pairs: their fingerprints are linked through the points at
half the distance around them, which takes a fixed number of rows for each, and is exact as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import numbered, pick, stored, table
from lodestrata.llm.components import components

BITS = 64
#: Buckets with more fingerprints than this are linked without making pairs.
DENSE = 128
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Shingles hashed at a time, to bound memory for very long texts.
_CHUNK = 1 << 12


def _hashes(text: str | None, size: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of a text's shingles of size words, repeats included, in pieces of bounded length.

    A-Z is lower-cased; words are runs without ASCII white space. Fewer than size words: the whole
    sequence is the one shingle; no word: none.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined, n = b" ".join(tokens), max(1, len(tokens) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(size, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        m = min(n, k + _CHUNK)
        yield np.array([digest(joined[s:e], seed) for s, e in zip(starts[k:m].tolist(), ends[k + last : m + last].tolist(), strict=True)], np.uint64)


def _majority(bytes_: Iterator[np.ndarray], width: int) -> bytes:
    """The bits set in over half the rows; bytes_: arrays of rows of width bytes."""
    sums, n = np.zeros((width, 8), np.int64), 0
    at = np.arange(width, dtype=np.int64) * 256
    for rows in bytes_:
        n += len(rows)
        if len(rows) < 32 * width // 8:
            sums += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64).reshape(width, 8)
        else:
            sums += np.bincount((rows + at).ravel(), minlength=256 * width).reshape(width, 256) @ _ONES
    return np.packbits((2 * sums > n).ravel(), bitorder="little").tobytes()


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's shingles, as an unsigned number: a bit is set if it is set in over half the hashes. No word: zero."""
    rows = (h.astype("<u8").view(np.uint8).reshape(-1, 8) for h in _hashes(text, size, seed))
    return int.from_bytes(_majority(rows, 8), "little")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """docs' other columns, with the column text replaced by fp: the fingerprint as a signed bigint."""
    at = docs.columns.index("text")
    schema = T.StructType([f for f in docs.schema if f.name != "text"] + [T.StructField("fp", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column(at)], np.uint64).view(np.int64)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(found)], [*(batch.schema.names[i] for i in rest), "fp"])

    return docs.mapInArrow(run, schema)


def n_blocks(n: int, distance: int) -> int:
    """Into how many blocks to cut: the fewest whose keys have more values than there are fingerprints."""
    blocks = distance + 2
    while blocks < distance + 6 and 2 ** ((blocks - distance) * (BITS // blocks)) < n:
        blocks += 1
    return blocks


def _masks(blocks: int, distance: int) -> list[int]:
    """For every choice of blocks - distance blocks, the mask of their bits, as signed numbers."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edge, edge[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
    assert len(masks) == comb(blocks, distance)
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _ball(radius: int) -> list[int]:
    """All masks of at most radius bits, as signed numbers."""
    every = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in every]


def close_links(fps: DataFrame, distance: int = 4, dense: int = DENSE) -> DataFrame:
    """a, b: links between the distinct fingerprints fp that give the components of all pairs within distance.

    Every row links fingerprints that are within distance. From buckets of at most dense fingerprints come
    all close pairs, from larger ones as many links as connect them.
    """
    masks = _masks(n_blocks(fps.count(), distance), distance)
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    entries = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.no", "k.key")
    sizes = entries.groupBy("no", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = stored(entries.join(sizes, ["no", "key"]), "buckets")

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    few = crowd.where(F.col("n") <= dense)
    left, right = few.select("no", "key", F.col("fp").alias("a")), few.select("no", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["no", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    many = crowd.where(F.col("n") > dense).select("fp").distinct()
    return (pairs if many.isEmpty() else pairs.unionAll(links_through_points(many, distance))).distinct()


def links_through_points(many: DataFrame, distance: int) -> DataFrame:
    """a, b: links that connect what all pairs of many (fp) within distance connect, from rows that don't depend on how many are close.

    Two fingerprints within distance have a point that is within half of it from one and within the rest
    from the other, and two that have such a point are within distance. All that have a point are linked
    to one that is within the smaller half of it.
    """
    low, high = distance // 2, distance - distance // 2
    masks, near = F.lit(np.array(_ball(high), np.int64)), F.bit_count(F.col("mask")) <= low
    each = many.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), "fp", near.alias("near"))
    around = each.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("own")).where(F.col("a").isNotNull() & (F.size("own") > 1))
    return around.select("a", F.explode("own").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of docs: id, fp (signed bigint) and component (the smallest id that links reach).

    Null, empty and blank texts have the fingerprint zero and are linked like any other. A null id is
    never the smallest; a component of null ids only has a null component. Rows that repeat an id are
    each returned. An empty table gives an empty table. Other columns of docs don't matter.
    """
    marked = stored(fingerprints(pick(docs, id=id_col, text=text_col), size), "fingerprints")
    kinds = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = stored(components(close_links(kinds.select("fp"), distance)), "roots")
    linked = kinds.join(roots.select(F.col("node").alias("fp"), "root"), "fp").select("fp", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(best, "root").select("fp", "component")
    final = kinds.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return marked.join(final, "fp").select("id", "fp", "component")


# What follows finds texts of a given similarity of shingle sets, which lie further apart than a few of 64 bits.


def layout(n: int, similarity: float, recall: float = 0.9995) -> tuple[int, int, int, int]:
    """Bits in a block, blocks in a word of 64 bits, number of words, and the greatest Hamming distance of a candidate.

    Sets of similarity J (as shares of their union) differ in a share acos(2J / (1 + J)) / pi of the
    bits. There are so many blocks that such texts share one with probability recall; blocks grow with
    the number of texts, so that unrelated ones rarely share one. Sets of a few shingles differ in up to
    a quarter more of the bits (4 of 5 shingles: 0.1875 for 0.1515); the distance allows for that and
    for six standard deviations, as candidates are verified by their sets.
    """
    p = acos(2 * similarity / (1 + similarity)) / pi
    bits = min(BITS, max(16, ceil(log2(max(n, 2))) - 2))
    blocks = ceil(log(1 - recall) / log(1 - (1 - p) ** bits))
    per = BITS // bits
    words = ceil(blocks / per)
    return bits, per, words, _reach(words * BITS, 1.25 * p)


def _reach(bits: int, p: float) -> int:
    """A distance that texts which differ in a share p of the bits don't exceed: six standard deviations beyond the mean."""
    return int(bits * p + 6 * sqrt(bits * p * (1 - p)))


#: Multiplier and shift that make more hashes of a hash (fixed values of the SplitMix64 generator).
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def shingles(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """The set of a text's shingles: their hashes in order, each once."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashes(text, size, seed)]))


def wide_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of words times 64 bits of a set of shingles, from as many hashes of each."""
    step = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_STEP))[None, :]

    def rows() -> Iterator[np.ndarray]:
        for k in range(0, len(own), _CHUNK):
            h = own[k : k + _CHUNK]
            x = h[:, None] + step
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
            x ^= x >> np.uint64(27)
            yield x.astype("<u8").view(np.uint8).reshape(len(h), 8 * words)

    return np.frombuffer(_majority(rows(), 8 * words), "<u8")


#: Pairs whose smaller set has at most so many shingles are found by shared shingles, as few shingles make the bits' share uncertain.
SHORT = 64


def prefix_keys(own: np.ndarray, similarity: float) -> np.ndarray:
    """Negative keys of which two sets of at least the similarity share one, the smaller having at most SHORT shingles; none for larger sets.

    Such sets share one of their first n - ceil(similarity * n) + 1 shingles in the order of hashes.
    """
    n = len(own)
    if not n or n > SHORT / similarity + 1e-9:
        return np.empty(0, np.int64)
    return ((own[: n - ceil(similarity * n - 1e-9) + 1] >> np.uint64(1)) | np.uint64(1 << 63)).view(np.int64)


def wide_fingerprints(docs: DataFrame, size: int, words: int, similarity: float) -> DataFrame:
    """id, mark, kind (a digest of the set of shingles), f (its fingerprint as bigints) and keys (prefix_keys()) of docs' id, mark and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, found, keys = [], [], []
            for x in batch.column(2):
                own = shingles(x.as_py(), size)
                kinds.append(hashlib.blake2b(own.astype("<u8").tobytes(), digest_size=16).digest())
                found.append(wide_fingerprint(own, words).view(np.int64))
                keys.append(prefix_keys(own, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["id", "mark", "kind", "f", "keys"])

    return docs.select("id", "mark", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, mark bigint, kind binary, f array<bigint>, keys array<bigint>")


def forest(nodes: np.ndarray, prints: np.ndarray, distance: int, first: int = 2 * BITS) -> list[tuple[int, int]]:
    """Links (fewer than nodes) that connect what all pairs within distance, and within first in their first two words, connect; a node once reached is compared no more."""
    open_, links = np.arange(len(nodes)), []
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            q = queue.pop()
            apart = np.bitwise_count(prints[open_] ^ prints[q])
            near = (apart.sum(axis=1) <= distance) & (apart[:, :2].sum(axis=1) <= first)
            links += [(int(nodes[q]), int(nodes[x])) for x in open_[near]]
            queue += list(open_[near])
            open_ = open_[~near]
    return links


def verified_forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (fewer than sets) that connect what all pairs of at least the Jaccard similarity connect; sets: arrays of distinct hashes, none empty."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    every = np.unique(np.concatenate(sets))
    own = [np.searchsorted(every, x).astype(np.int32) for x in sets]
    marked, open_, links = np.zeros(len(every), bool), np.arange(len(sets)), []
    del every
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        rest = np.concatenate([own[x] for x in open_]) if len(open_) else own[0][:0]
        while queue and len(open_):
            q = queue.pop()
            marked[own[q]] = True
            common = np.add.reduceat(marked[rest], np.cumsum(sizes[open_]) - sizes[open_], dtype=np.int64)
            marked[own[q]] = False
            near = common >= similarity * (sizes[open_] + sizes[q] - common) - 1e-9
            if near.any():
                links += [(int(nodes[q]), int(nodes[x])) for x in open_[near]]
                queue += list(open_[near])
                rest, open_ = rest[np.repeat(~near, sizes[open_])], open_[~near]
    return links


#: The same as DENSE for wide fingerprints, whose unrelated ones leave about four in a bucket at any size of the input.
WIDE_DENSE = 16
#: Nodes that each node is held against before pairs are made.
LEADS = 8
#: Fingerprints of a dense bucket that are compared in one go with each other or with as many others.
_PART = 2048
#: Characters of a candidate group whose texts are verified in one go with each other or with as many others.
_PART_CHARS = 4 << 20


def candidate_links(kinds: DataFrame, layout_: tuple[int, int, int, int], similarity: float, dense: int) -> DataFrame:
    """a, b: links between the nodes of kinds (node, f, keys) that give the components of all pairs of at least the similarity, and of more.

    In a first step every node is only held against the least few of the nodes that are first in one of its
    buckets, which joins most of a large group of copies at the cost of LEADS rows each. In the second, pairs
    are made of nodes that this has not joined yet, so their number doesn't grow with the square of a group.
    """
    bits, per, words, distance = layout_
    first = _reach(2 * BITS, acos(2 * similarity / (1 + similarity)) / pi)
    mask = (1 << bits) - 1
    block = lambda k: F.shiftrightunsigned(F.get("f", F.lit(k // per)), bits * (k % per)).bitwiseAND(F.lit(mask)) + F.lit(k << bits)
    keys = F.concat(F.array(*[block(k) for k in range(words * per)]), F.col("keys"))
    entries = kinds.select("node", F.get("f", F.lit(0)).alias("s"), F.get("f", F.lit(1)).alias("t"), F.explode(keys).alias("key"))
    entries = entries.where(F.col("key").isNotNull() & F.col("node").isNotNull()).repartition("key")  # one shuffle, which the buckets and the joins share
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "s", "t")).alias("lead")).where("n > 1")
    prints = kinds.select("node", "f")

    # The first 128 bits tell most of the unrelated ones apart; sets found by a shared shingle need no such test.
    def near(s: str, t: str) -> Column:
        return (F.bit_count(F.col("s").bitwiseXOR(F.col(s))) + F.bit_count(F.col("t").bitwiseXOR(F.col(t))) <= first) | (F.col("key") < 0)

    other = (F.col("node") != F.col("lead.node")) & near("lead.s", "lead.t")
    sized = entries.join(buckets, "key").select("key", "node", "s", "t", "n", F.when(other, F.col("lead.node")).alias("lead"))
    # Of a small bucket only those are written that another one there is near, as no other can be in a pair.
    mates = entries.select(F.col("key").alias("key2"), F.col("node").alias("node2"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    mated = (F.col("key") == F.col("key2")) & (F.col("node") != F.col("node2")) & near("s2", "t2")
    paired = sized.where(F.col("n") <= dense).join(mates, mated, "left_semi")
    large = sized.where(F.col("n") > dense).withColumns({"s": F.lit(None).cast("bigint"), "t": F.lit(None).cast("bigint")})
    crowd = stored(paired.unionAll(large), "crowd")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(prints.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").join(prints.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
        apart = sum(F.bit_count(F.get("fa", F.lit(i)).bitwiseXOR(F.get("fb", F.lit(i)))) for i in range(words))
        return both.where(apart <= distance).select("a", "b")

    stars = crowd.where(F.col("lead").isNotNull()).groupBy(F.col("node").alias("b")).agg(F.array_sort(F.collect_set("lead")).alias("leads"))
    stars = stored(verified(stars.select(F.explode(F.slice("leads", 1, LEADS)).alias("a"), "b")), "stars")
    joined = stored(components(stars), "joined")
    few = crowd.where(F.col("n") <= dense).join(joined, "node", "left").select("key", "node", "s", "t", F.coalesce("root", "node").alias("group"))
    few = few.where(F.col("key").isNotNull()).repartition("key")  # shared by both sides
    other = few.select("key", F.col("node").alias("b"), F.col("s").alias("s2"), F.col("t").alias("t2"), F.col("group").alias("group2"))
    pairs = few.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.col("group") != F.col("group2")) & near("s2", "t2"))
    links = stars.unionAll(verified(pairs.select("a", "b").distinct()))
    many = crowd.where(F.col("n") > dense)
    if many.isEmpty():
        return links

    def connect(part: pd.DataFrame) -> pd.DataFrame:
        nodes = part["node"].to_numpy()
        prints = np.stack(part["f"].to_numpy()).astype(np.int64).view(np.uint64)
        return pd.DataFrame(forest(nodes, prints, distance, 2 * BITS if part["key"].iloc[0] < 0 else first), columns=["a", "b"], dtype="int64")

    thick = many.select("key", "node", F.ceil(F.col("n") / _PART).cast("int").alias("parts"))
    thick = thick.withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    thick = thick.join(prints, "node").select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "f")
    return links.unionAll(thick.groupBy("key", "i", "j").applyInPandas(connect, "a long, b long"))


def verified_links(own: DataFrame, roots: DataFrame, size: int, similarity: float, part_chars: int = _PART_CHARS) -> DataFrame:
    """a, b: links between texts of own (node, text) under the same root (node, root) that connect what all pairs of sets of at least the similarity connect."""

    def connect(part: pa.Table) -> pa.Table:
        sets = [shingles(x.as_py(), size) for x in part["text"]]
        some = [k for k, x in enumerate(sets) if len(x)]
        links = verified_forest(part["node"].to_numpy()[some], [sets[k] for k in some], similarity)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    texts = own.join(roots, "node").select("root", "node", F.coalesce("text", F.lit("")).alias("text"))
    sums = own.select("node", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(roots, "node")
    parts = sums.groupBy("root").agg(F.greatest(F.ceil(F.sum("chars") / part_chars), F.lit(1)).cast("int").alias("parts"))
    each = texts.join(parts, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.select("root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "text")
    return each.groupBy("root", "i", "j").applyInArrow(connect, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, dense: int = WIDE_DENSE, part_chars: int = _PART_CHARS) -> DataFrame:
    """id, mark, component: for every row of docs with an id, the smallest id that links of at least the similarity reach from its text.

    The similarity is the Jaccard coefficient of the sets of shingles; fingerprints give the candidates,
    and every link is verified. Ids are of any type that has an order; mark is a hash of the text, so rows
    that repeat an id are each judged by their own. Texts without words are equal. Fingerprints of buckets
    with more than dense, and texts of large groups of candidates, are compared part by part, which takes
    bounded memory and gives fewer links than documents; the same two tests hold for every pair.
    """
    own = pick(docs, id=id_col, text=text_col).where(F.col("id").isNotNull()).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    plan = layout(own.count(), similarity)
    marked = stored(wide_fingerprints(own, size, plan[2], similarity), "fingerprints")
    # Numbers that are written down once stand for the kinds of texts.
    first = F.min(F.struct("id", "mark")).alias("first")
    kinds = stored(marked.groupBy("kind", "f", "keys").agg(first).select(F.monotonically_increasing_id().alias("node"), "kind", "f", "keys", "first"), "kinds")
    near = stored(components(candidate_links(kinds, plan, similarity, dense)), "candidates")
    named = kinds.join(near.select("node"), "node").select("node", F.col("first.id").alias("k_id"), F.col("first.mark").alias("k_mark"))
    texts = own.join(named, (F.col("id") == F.col("k_id")) & (F.col("mark") == F.col("k_mark"))).groupBy("node").agg(F.first("text").alias("text"))
    roots = stored(components(verified_links(texts, near, size, similarity, part_chars)), "roots")
    linked = kinds.select("node", "kind", F.col("first.id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = linked.groupBy("root").agg(F.min("least").alias("component"))
    return marked.select("id", "mark", "kind").join(linked.join(best, "root").select("kind", "component"), "kind").select("id", "mark", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, of which each group of similar_groups() keeps the document with the smallest id.

    Rows without an id stay. Rows that repeat an id are judged by their own text; equal ones all stay or all go.
    """
    gone = similar_groups(docs, id_col, text_col, size, similarity).where("id <> component").select("id", "mark").distinct()
    at, text = docs.columns.index(id_col), docs.columns.index(text_col)
    kept = numbered(docs).join(gone, (F.col(f"c{at}") == F.col("id")) & (F.xxhash64(F.coalesce(f"c{text}", F.lit(""))) == F.col("mark")), "left_anti")
    return kept.toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
