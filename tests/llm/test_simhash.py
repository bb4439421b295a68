import random
from itertools import combinations

import pytest
import xxhash
from lodestrata.llm import simhash
from lodestrata.llm.components import components


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    above = {n: n for n in nodes}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        above[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprints(corpus):
    for _, text, *_ in corpus:
        assert simhash.fingerprint(text) == brute_print(text)


def test_components_against_brute_force(docs, corpus):
    prints = {i: brute_print(t) for i, t, *_ in corpus}
    want = groups(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in prints}


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_links_of_dense_buckets(spark, dense):
    rng = random.Random(dense)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(60)}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = [tuple(r) for r in simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, dense).collect()]
    mod = 2**64
    assert all(((a ^ b) % mod).bit_count() <= 4 for a, b in links)
    want = groups(signed, [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % mod).bit_count() <= 4])
    assert groups(signed, links) == want


def test_masks_leave_no_pair_out():
    for blocks in (6, 7, 8):
        masks = [m % 2**64 for m in simhash._masks(blocks, 4)]
        rng = random.Random(blocks)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("last", [0, 1 << 17])
def test_components_of_chains(spark, last):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 200), (7, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), last=last).collect()}
    assert set(got) == set(range(41)) | set(range(100, 110))
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 110)}) == 1 and got[0] != got[100]


def test_odd_rows_and_empty(odd, empty):
    got = sorted((str(r["id"]), r["component"]) for r in simhash.near_duplicates(odd).collect())
    assert got == [("1", 1), ("3", 3), ("3", 3), ("5", 5), ("5", 5), ("None", 3)]
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "3", "5", "5", "None"]


def similar(a, b, size=5):
    grams = lambda t: {tuple(w[i : i + size]) for w in [t.lower().split()] for i in range(max(1, len(w) - size + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_ids_of_any_type_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text), ("a", text + " end"), ("c", "another text of some words that stands alone"), ("a", "a text of its own under an id that repeats"), (None, text), ("d", None), ("e", " ")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(df).collect()))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[4], rows[5]]))


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_through_points(spark, distance):
    import random

    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    got = [tuple(r) for r in simhash.links_through_points(spark.createDataFrame([(f,) for f in signed], "fp long"), distance).collect()]
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(apart(a, b) <= distance for a, b in got)

    def groups(links):
        top = {f: f for f in signed}

        def find(x):
            return x if top[x] == x else find(top[x])

        for a, b in links:
            top[find(a)] = find(b)
        return {frozenset(f for f in signed if find(f) == r) for r in {find(f) for f in signed}}

    assert groups(got) == groups([(a, b) for a in signed for b in signed if apart(a, b) <= distance])


@pytest.mark.parametrize("dense", [2, 128])
def test_similar_groups(spark, dense):
    """Edited copies are found, unrelated texts stay apart; with tiny buckets the part-by-part way gives the same."""
    rng = random.Random(1)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, planted = {}, []
    for g in range(25):
        base = make(150)
        texts[g] = " ".join(base)
        for c in range(3):
            words = list(base)
            for p in rng.sample(range(150), 2):
                words[p] = "edited"
            i = 100 + 10 * g + c
            texts[i] = " ".join(words)
            if similar(texts[g], texts[i]) >= 0.85:
                planted.append((g, i))
    for i in range(500, 560):
        texts[i] = " ".join(make(120))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_groups(df, dense=dense).collect()}
    missed = [p for p in planted if got[p[1]] != got[p[0]]]
    assert len(planted) > 60 and len(missed) <= 1
    assert all(got[i] == i for i in range(500, 560)) and all(got[g] == g for g in range(25))
    kept = simhash.drop_near_duplicates(df).count()
    assert 85 <= kept <= 87


def test_forest_connects_like_all_pairs():
    import numpy as np

    rng = random.Random(3)
    rows = [[rng.getrandbits(6) for _ in range(2)] for _ in range(120)]
    prints = np.array(rows, np.uint64)
    links = simhash.forest(np.arange(120), prints, 2)
    want = [(a, b) for a, b in combinations(range(120), 2) if sum((x ^ y).bit_count() for x, y in zip(rows[a], rows[b], strict=True)) <= 2]
    assert groups(range(120), links) == groups(range(120), want) and len(links) < 120


def jaccard_groups(texts, limit=0.8):
    return groups(texts, [(a, b) for a, b in combinations(texts, 2) if similar(texts[a], texts[b]) >= limit])


@pytest.mark.parametrize("dense", [1, 16])
def test_a_repeated_phrase_neither_links_nor_parts(spark, dense):
    """Sets of shingles decide: a phrase that unrelated texts repeat links nothing, and a copy without the repeats is linked."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(30000)}" for _ in range(n)]
    phrase, texts = make(8), {}
    for k in range(12):
        base = make(700)
        texts[2 * k] = " ".join(base + phrase * 35)
        texts[2 * k + 1] = " ".join(base)
    want = jaccard_groups(texts)
    assert want == {i: i - i % 2 for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["id"]: r["component"] for r in simhash.similar_groups(df, dense=dense, part_chars=3000).collect()} == want


def test_all_pairs_at_the_threshold(spark):
    """Pairs of exactly 0.8, long and short, against all pairs by brute force."""
    rng = random.Random(12)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = {}
    for k in range(300):
        n = 9 * (1 + k % 30)
        base = make(n + 4)
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[: n + 4 - n // 9] + make(n // 9))
    for k in range(300, 360):
        base = make(9)
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(base[:8])
    want = {i: i - i % 2 for i in texts}
    assert all(similar(texts[i], texts[i + 1]) == 0.8 for i in range(0, 720, 2))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: r["component"] for r in simhash.similar_groups(df).collect()}
    missed = [i for i in want if got[i] != want[i]]
    assert all(got[i] in (i, want[i]) for i in want) and len(missed) <= 1


def test_buckets_are_stored_without_those_that_nothing_is_near(spark, monkeypatch):
    """Of small buckets only rows with a near one in the bucket are written, of large ones all; links connect all close pairs of a bucket."""
    rng = random.Random(5)
    prints = [[rng.getrandbits(64) for _ in range(2)] for _ in range(160)]
    for i in range(0, 120, 3):  # in one small bucket, but unrelated
        for j in (1, 2):
            prints[i + j][0] = prints[i + j][0] >> 16 << 16 | prints[i][0] & 0xFFFF
    for i in range(120, 140, 2):  # close pairs
        prints[i + 1] = [prints[i][0] ^ 1 << rng.randrange(64), prints[i][1] ^ 1 << rng.randrange(64)]
    for i in range(141, 160):  # one large bucket
        prints[i][1] = prints[i][1] & (1 << 48) - 1 | prints[140][1] >> 48 << 48
    first = simhash._reach(128, 0.1515)
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True))
    buckets = {}
    for i, f in enumerate(prints):
        for k in range(8):
            buckets.setdefault((k, f[k // 4] >> 16 * (k % 4) & 0xFFFF), []).append(i)
    shared = {k: b for k, b in buckets.items() if len(b) > 1}
    want = {(v + (k << 16), i) for (k, v), b in shared.items() for i in b if len(b) > 16 or any(i != j and apart(i, j) <= first for j in b)}
    assert 0 < len(want) < sum(map(len, shared.values())) - 60

    tables, store = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, what: tables.setdefault(what, store(df, what)))
    rows = [(i, [x - 2**64 if x >> 63 else x for x in f], []) for i, f in enumerate(prints)]
    kinds = spark.createDataFrame(rows, "node long, f array<bigint>, keys array<bigint>")
    links = [tuple(r) for r in simhash.candidate_links(kinds, (16, 4, 2, 30), 0.8, 16).collect()]
    stored = [(r["key"], r["node"]) for r in tables["crowd"].collect()]
    assert len(stored) == len(want) and set(stored) == want
    near = [(a, b) for bucket in shared.values() for a, b in combinations(bucket, 2) if apart(a, b) <= 30]
    assert len(near) >= 10 and groups(range(160), links) == groups(range(160), near)
