"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import stored

#: Rounds after which something must be wrong: each is expected to remove a fixed share of the nodes.
MAX_ROUNDS = 100
#: So many links, counted first, are finished in one task, whose memory they bound.
LAST = 1 << 17


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links that one task gets."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """node, root: every node of links (two bigint columns) with one node of its component, the same for all of it.

    While there are more than last links, a round gives every node the neighbour (or itself) that comes
    first in an order shuffled anew by the round's number, and replaces nodes by these. The shuffled
    order makes chains shrink by a share of their nodes a round, whatever their labels, so n nodes take
    O(log n) rounds. What is left is finished in one task. Every round's tables are written to the
    shared folder; only the number of links left comes to the driver. Nulls, and nodes that are linked
    with nothing but themselves, are left out.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    maps, left, turn = [], edges.count(), 0
    while left > last:
        if turn == MAX_ROUNDS:
            raise RuntimeError(f"{left} links left after {turn} rounds")
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionAll(edges.select("b", "a"))
        order = lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c))
        first = both.groupBy("node").agg(F.min(F.struct(order("next").alias("o"), F.col("next").alias("n"))).alias("m"))
        own = F.struct(order("node").alias("o"), F.col("node").alias("n"))
        step = stored(first.select("node", F.least(F.col("m"), own)["n"].alias("to")), "step")
        maps.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        left, turn = edges.count(), turn + 1
    found = edges.coalesce(1).mapInArrow(_finish, "node bigint, root bigint")
    # A step's nodes are all that its round had; those that it maps to stand for them from then on.
    for step in reversed(maps):
        found = step.join(found.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
