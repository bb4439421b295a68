import random
import re
from collections import defaultdict

import pytest
from lodestrata.llm import mixing


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes, weights, repeats=3):
    """Fill in small steps of exact fractions: share what is left among the sources that aren't full."""
    from fractions import Fraction

    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), [i for i, s in enumerate(sizes) if s]
    while left and open_:
        total = sum(weights[i] for i in open_)
        step = min(Fraction(repeats * sizes[i] - out[i]) / weights[i] for i in open_)
        step = min(step, left / total)
        for i in open_:
            out[i] += step * weights[i]
        left -= step * total
        open_ = [i for i in open_ if out[i] < repeats * sizes[i]]
    return [float(x) for x in out]


def brute_seats(shares, seats):
    out = [0] * len(shares)
    for _ in range(seats):
        i = max(range(len(shares)), key=lambda k: (shares[k] / (2 * out[k] + 1), -k))
        out[i] += 1
    return out


def test_targets():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, rng.randint(0, 30), rng.randint(0, 3000)]) for _ in range(n)]
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_seats():
    rng = random.Random(2)
    for _ in range(200):
        shares = [float(rng.choice([0, 1, 7, rng.randint(1, 500)])) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 120)
        assert mixing.sainte_lague(shares, seats) == (brute_seats(shares, seats) if any(shares) else [0] * len(shares))


def test_shards_follow_the_highest_quotients(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(4):
        words = [rng.randint(0, 400) for _ in range(rng.randint(1, 9))]
        blocks = rng.randint(0, 60)
        rows += [(f"s{s}", k, w, blocks) for k, w in enumerate(words)]
        want[f"s{s}"] = brute_seats([float(w) for w in words], blocks if any(words) else 0)
    got = mixing._apportion_shards(spark.createDataFrame(rows, "src string, shard int, words long, blocks long")).collect()
    for s, seats in want.items():
        assert [r["quota"] for r in sorted((r for r in got if r["src"] == s), key=lambda r: r["shard"])] == seats


def test_skewed_shards(spark):
    """One shard of half the words beside many small ones: rounding shares to their neighbours isn't enough."""
    rng = random.Random(4)
    tables = [([94900] + [51] * 100, 1000), ([10**6] + [1] * 50, 777), ([3, 1] * 40, 61), ([0, 0, 5], 9), ([rng.randint(0, 10 ** rng.randint(1, 6)) for _ in range(300)], 2000)]
    rows = [(f"s{k}", i, w, n) for k, (own, n) in enumerate(tables) for i, w in enumerate(own)]
    got = mixing._apportion_shards(spark.createDataFrame(rows, "src string, shard int, words long, blocks long")).collect()
    for k, (own, n) in enumerate(tables):
        found = [r["quota"] for r in sorted((r for r in got if r["src"] == f"s{k}"), key=lambda r: r["shard"])]
        assert found == brute_seats([float(w) for w in own], n)
    assert max(r["quota"] for r in got if r["src"] == "s0") == 930


def brute_mix(df, block, shard, shard_rows, seed=10):
    """(id, source, size, taken) of all rows, one word of each pass at a time; only the seeded hashes come from Spark."""
    from pyspark.sql import functions as F

    rows = [(r["doc_id"], r["source"], size(r["text"]), r["o"], r["m"]) for r in df.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("o"), F.xxhash64(F.xxhash64(F.lit(seed), "doc_id", "text")).alias("m")).collect()]
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r[2] for r in rows if r[1] == s) for s in names]
    goals = brute_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    quotas = brute_seats(goals, round(sum(sizes) / block)) if any(goals) else [0] * len(names)
    out = []
    for s, whole, goal, blocks in zip(names, sizes, goals, quotas, strict=True):
        own = [r for r in rows if r[1] == s]
        n = max(1, -(-whole // shard), -(-len(own) // shard_rows))
        dealt = [sorted((r for r in own if r[4] % n == k), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2])) for k in range(n)]
        held = [k for k in range(n) if dealt[k]]
        totals = [sum(r[2] for r in dealt[k]) for k in held]
        seats = brute_seats([float(t) for t in totals], min(blocks, 3 * whole // block)) if any(totals) else [0] * len(held)
        starts = df.sparkSession.createDataFrame([(s, k) for k in range(n)], "s string, k int").select("k", F.xxhash64(F.lit(seed), "s", "k").alias("h")).collect()
        start = {r["k"]: r["h"] for r in starts}
        for k, total, q in zip(held, totals, seats, strict=True):
            quota = 3 * total if goal >= 3 * whole else min(q * block, 3 * total)
            takes = [quota // total if total else 0] * total
            begin = (start[k] % max(1, -(-total // block))) * block
            for x in range(quota % total if total else 0):
                takes[(begin + x) % total] += 1
            at = 0
            for r in dealt[k]:
                out.append((str(r[0]), str(s), r[2], sum(takes[at : at + r[2]])))
                at += r[2]
    return sorted(out)


@pytest.mark.parametrize("block, shard, shard_rows", [(10, 500, 10**6), (7, 10**6, 5), (100, 10**6, 10**6)])
def test_taken_against_brute_force(docs, odd, block, shard, shard_rows):
    for df in (docs, odd):
        got = mixing.mix(df, block=block, shard=shard, shard_rows=shard_rows).collect()
        assert sorted((str(r["id"]), str(r["source"]), r["size"], r["taken"]) for r in got) == brute_mix(df, block, shard, shard_rows)


def check(df, block, shard):
    got = mixing.mix(df, block=block, shard=shard).collect()
    text = {}
    rows = df.select("doc_id", "text", "source").collect()
    assert sorted((str(r["doc_id"]), str(r["source"]), size(r["text"])) for r in rows) == sorted((str(r["id"]), str(r["source"]), r["size"]) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    goals = brute_targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for s, n, goal in zip(names, sizes, goals, strict=True):
        assert {(r["source_size"], round(r["target"], 6)) for r in by[s]} == {(n, round(goal, 6))}
        assert abs(sum(r["taken"] for r in by[s]) - goal) <= block * (2 + n // shard)  # a shard may be too small for its last block
    return text, got


def test_mix(docs):
    _, first = check(docs, 10, 500)
    _, again = check(docs.repartition(7), 10, 500)
    assert sorted(map(str, first)) == sorted(map(str, again))
    check(docs, 7, 1_000_000)


def test_odd_rows_and_empty(odd, empty):
    check(odd, 1, 3)
    assert mixing.mix(empty).count() == 0
    assert {r["taken"] for r in mixing.mix(odd.where("text is null")).collect()} == {0}
