import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestrata.llm import lattice
from lodestrata.llm.common import data_file

MODEL = data_file("piece_bpe_32k.model")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


def all_segmentations(word, pieces):
    if not word:
        return [1.0]
    return [math.exp(pieces[word[:i]]) * rest for i in range(1, len(word) + 1) if word[:i] in pieces for rest in all_segmentations(word[i:], pieces)]


def toy():
    weights = {b"a": 4, b"b": 2, b"ab": 3, b"aba": 1, b" ": 2, b" a": 5, b"ba": 1}
    total = sum(weights.values())
    return {k: math.log(v / total) for k, v in weights.items()}


def run(words, pieces, counts=None):
    """Log probabilities of words and expected counts of pieces."""
    own = lattice.Pieces(pieces)
    lp, into = np.empty(len(words)), np.zeros(len(own.names))
    counts = np.array(counts or [1] * len(words), float)
    for chunk in lattice.chunks(np.array([len(w) for w in words]), lattice.edge_array(words, own)):
        lp[chunk.rows], share = chunk.forward(own.first)
        chunk.expected(share, counts[chunk.rows], into)
    return lp, dict(zip(own.names, into, strict=True))


def test_forward_sums_all_segmentations():
    pieces, words = toy(), [b" a", b" abab", b" babaabab", b" bbbb", b" aaaaaaaaaa", b" ", b""]
    lp, _ = run(words, pieces)
    for w, got in zip(words, lp, strict=True):
        assert got == pytest.approx(math.log(sum(all_segmentations(w, pieces))))


def ways(w, pieces):
    if not w:
        yield ()
    for i in range(1, len(w) + 1):
        if w[:i] in pieces:
            yield from ((w[:i], *rest) for rest in ways(w[i:], pieces))


def brute_expected(words, counts, pieces):
    out = Counter()
    for w, n in zip(words, counts, strict=True):
        each = [(math.exp(sum(pieces[x] for x in way)), way) for way in ways(w, pieces)]
        for p, way in each:
            for x in way:
                out[x] += n * p / sum(q for q, _ in each)
    return out


def test_expected_counts():
    pieces, words, counts = toy(), [b" ababab", b" a", b" bababa"], [2, 5, 1]
    _, got = run(words, pieces, counts)
    want = brute_expected(words, counts, pieces)
    assert {k: v for k, v in got.items() if v} == pytest.approx(dict(want))


def test_no_way_through_and_long_words():
    lp, got = run([b" c", b" ab"], toy())
    assert lp[0] == float("-inf") and math.isfinite(lp[1]) and all(math.isfinite(v) for v in got.values())
    assert math.isfinite(run([b" " + b"ab" * 20_000], toy())[0][0])
    words = [b"ab" * 50_000] * 3 + [b"a"] * 5000
    sizes = [len(c.rows) for c in lattice.chunks(np.array([len(w) for w in words]), lattice.edge_array(words, lattice.Pieces(toy())))]
    assert sum(sizes) == 5003 and max(sizes) <= lattice.CHUNK and list(lattice.chunks(np.zeros(0), None)) == []


def test_steps_raise_the_likelihood_until_they_settle(spark):
    pieces, words, counts = toy(), ["ababab", "a", "ba", "bbbb"], [3, 9, 4, 1]
    own = lattice.Pieces(pieces)
    built = lattice.lattices(spark.createDataFrame(list(zip(words, counts, strict=True)), "word string, count long"), own)
    likely, was = [], pieces
    for steps in range(1, 7):
        logs, end = lattice.fit(spark, built, 2, own, steps)
        now = dict(zip(own.names, logs, strict=True))
        want = brute_expected([b" " + w.encode() for w in words], counts, was)
        weights = {p: want[p] + lattice.PRIOR * math.exp(pieces[p]) for p in pieces}
        total = sum(weights.values()) + 3
        if steps <= 3:  # later steps may have settled
            assert now == pytest.approx({p: math.log(w / total) for p, w in weights.items()})
        likely.append(sum(n * math.log(sum(all_segmentations(b" " + w.encode(), now))) for w, n in zip(words, counts, strict=True)))
        was = now
    assert likely[2] >= likely[1] - 1e-6
    assert sum(math.exp(v) for v in now.values()) + math.exp(end) == pytest.approx(1)


def test_frequent_words(spark):
    rows = [(f"w{i}", i % 50, 0.0) for i in range(500)] + [("x" * 40, 1000, 0.0)]
    df = spark.createDataFrame(rows, "word string, count long, lp double")
    for head in (0, 7, 100, 10_000):
        got = lattice.frequent(df, head)
        least = min((r["count"] for r in got), default=10**9)
        assert len(got) <= head and all(len(r["word"]) < 40 and r["count"] > 0 for r in got)
        assert {r["word"] for r in got} == {w for w, n, _ in rows if n >= least and len(w) < 40}
    assert len(got) == 490


def brute_base(rows):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, out(i), len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


@needs_model
@pytest.mark.parametrize("head", [5, 1 << 17])
def test_scores(docs, corpus, head):
    rows = [(i, t) for i, t, *_ in corpus]
    got = sorted(lattice.score(docs, MODEL, head=head).collect(), key=lambda r: r["id"])
    for r, w in zip(got, brute_base(rows), strict=True):
        assert tuple(r)[:5] == w[:5]
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    by = {r["id"]: r["score"] for r in got}
    assert by[60] == pytest.approx(by[0]) and by[110] == by[111] == pytest.approx(by[112])
    # A text of shuffled letters is less likely than the text.
    assert by[110] > by[113] > by[0]


@needs_model
def test_the_model_prefers_the_corpus(spark, corpus):
    import random

    rng = random.Random(0)
    rows = [(i, t) for i, t, *_ in corpus if t]
    mixed = [(10_000 + 7 * i, "".join(rng.sample(t, len(t)))) for i, t in rows[:40]]
    df = spark.createDataFrame([*rows, *mixed], "doc_id long, text string")
    got = {r["id"]: r["score"] / r["n_tokens"] for r in lattice.score(df, MODEL).collect()}
    assert sum(got[10_000 + 7 * i] < got[i] for i, _ in rows[:40]) >= 38


def brute_scores(rows, first, prior=lattice.PRIOR):
    """The whole model over (id, text) rows by plain recursions, a word at a time: scores in log10, by row."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not out(i) for w in (t or "").encode().lower().split())
    ends = sum(not out(i) for i, _ in rows)
    longest = max(map(len, first))

    def both(word, p):
        """Forward and backward sums at all places of a word."""
        n = len(word)
        edges = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if word[i:j] in p]
        f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j in edges:
            f[j] += f[i] * p[word[i:j]]
        for i, j in sorted(edges, reverse=True):
            b[i] += p[word[i:j]] * b[j]
        return f, b, edges

    p, before = {k: math.exp(v) for k, v in first.items()}, None
    for _ in range(lattice.STEPS):
        seen, likely = Counter(), 0.0
        for w, n in counts.items():
            word = b" " + w
            f, b, edges = both(word, p)
            likely += n * math.log(f[-1])
            for i, j in edges:
                seen[word[i:j]] += n * f[i] * p[word[i:j]] * b[j] / f[-1]
        weights = {k: seen[k] + prior * math.exp(v) for k, v in first.items()}
        total = sum(weights.values()) + ends + 1
        p, end = {k: v / total for k, v in weights.items()}, (ends + 1) / total
        if before is not None and likely - before <= lattice.SETTLED * abs(before):
            break
        before = likely
    end /= end + sum(v for k, v in p.items() if k[:1] == b" ")
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    logs = {w: math.log10((counts[w] + max(1, v) * both(b" " + w, p)[0][-1]) / (n + max(1, v))) for w in {w for _, t in rows for w in (t or "").encode().lower().split()}}
    last = math.log10((ends + max(1, v) * end) / (n + max(1, v)))
    return [sum(logs[w] for w in (t or "").encode().lower().split()) + last for _, t in rows]


@needs_model
@pytest.mark.parametrize("head", [5, 1 << 17])
def test_scores_end_to_end(spark, corpus, odd, head):
    first = lattice.vocabulary(MODEL)
    assert sum(math.exp(v) for v in first.values()) == pytest.approx(1)
    rows = [(i, t) for i, t, *_ in corpus]
    for data in (rows, [(r["doc_id"], r["text"]) for r in odd.collect()]) if head > 5 else (rows[:30], [(9, "held out")]):
        got = lattice.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), MODEL, head=head).collect()
        want = brute_scores(data, first)
        key = lambda r: (str(r[0]), r[1])
        for (i, x), (j, y) in zip(sorted(((r["id"], r["score"]) for r in got), key=key), sorted(((i, s) for (i, _), s in zip(data, want, strict=True)), key=key), strict=True):
            assert i == j and x == pytest.approx(y, rel=1e-6)


@needs_model
def test_the_corpus_helps_held_out_texts(spark, corpus):
    """What is learned grows with the corpus: more training texts make held-out ones likelier."""
    rows = [(i, t) for i, t, *_ in corpus[:60] if t]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    held = [r for r in rows if out(r[0])]
    few = held + [r for r in rows if not out(r[0])][:3]
    score = lambda data: sum(r["score"] for r in lattice.score(spark.createDataFrame(data, "doc_id long, text string"), MODEL).collect() if r["held_out"])
    assert held and score(rows) > score(few) + 10


@needs_model
def test_odd_rows_and_empty(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lattice.score(odd, MODEL).collect()
    key = lambda r: (str(r[0]), r[2], r[3])
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(brute_base(rows), key=key), strict=True):
        assert r[:5] == w[:5] and r[5] == pytest.approx(w[5])
    assert lattice.score(empty, MODEL).count() == 0
