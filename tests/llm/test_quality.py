import random
import re
from collections import Counter

from lodestrata.llm import quality
from lodestrata.llm.common import pick


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics(docs, odd, spark):
    more = spark.createDataFrame([(1, "a b c d e f g h i a b c d e f g h"), (2, "x " * 9), (3, "a b c #*$%&|<>"), (4, "l\nl\n \nl\nm"), (5, "a b c d e f g h\u000ba b c d e f g h a b c d e f g h")], "doc_id long, text string")
    for df in (docs, odd, more):
        got = quality.statistics(pick(df, id="doc_id", text="text")).collect()
        want = sorted((str(r["doc_id"]), *brute(r["text"])) for r in pick(df, doc_id="doc_id", text="text").collect())
        assert sorted((str(r["id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 400))), ["en", "de"][i % 2], f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, " ".join(rng.choice(vocabulary) + "***" for _ in range(100)), "en", "s0") for i in range(20)]
    rows += [(2000 + i, "too short", "en", "s0") for i in range(5)] + [(3000, " ".join(rng.choice(vocabulary) for _ in range(60)), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["id"]: r["kept"] for r in quality.quality(df).collect()}
    assert len(kept) == len(rows)
    assert sum(not kept[i] for i in range(600)) == 0 and kept[3000]
    assert not any(kept[i] for i in kept if 1000 <= i < 3000)
    out = quality.keep_quality(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i in kept if kept[i])


def test_estimates_resist_a_cluster_of_outliers(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    good = rng.normal([1.6, 0.3, 0.3, 0.3], [0.2, 0.1, 0.1, 0.1], (400, 4))
    bad = rng.normal([2.5, 1.2, 1.0, 1.0], 0.01, (80, 4))
    rows = [(0, "g", "s", *map(float, x)) for x in [*good, *bad]]
    df = spark.createDataFrame(rows, "level int, g_lang string, g_source string, f0 double, f1 double, f2 double, f3 double")
    fit = quality.mcd(df, True).collect()[0]
    assert fit["n"] == 480
    assert np.allclose([fit[f"m{i}"] for i in range(4)], good.mean(axis=0), atol=0.03)


def test_distance_is_mahalanobis(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    a = rng.normal(size=(4, 4))
    cov = a @ a.T
    names = {f"s{i}{j}": float(cov[i, j]) for i in range(4) for j in range(i + 1)} | {f"m{i}": 0.5 * i for i in range(4)} | {f"f{i}": float(i * i) for i in range(4)}
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in names.items()])
    got = quality._whitened(df).select(quality._distance()).first()[0]
    x = np.array([i * i - 0.5 * i for i in range(4)])
    want = x @ np.linalg.inv(cov + np.diag(np.square(quality.FLOORS))) @ x
    assert abs(got - want) < 1e-9 * max(1, want)


def test_odd_rows_and_empty(odd, empty):
    assert quality.quality(odd).count() == odd.count()
    assert quality.quality(empty).count() == 0
    assert quality.keep_quality(empty).columns == empty.columns


def test_spread_of_the_texts_decides(spark):
    """Floors don't swamp the estimates: some six per cent of symbols go where no text has any, and stay where many do."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]

    def make(share):
        return " ".join(rng.choice(vocabulary) + ("|" if rng.random() < share else "") for _ in range(rng.randint(200, 400)))

    rows = [(i, make(0), "en", "plain") for i in range(150)] + [(1000 + i, make(0.35), "en", "plain") for i in range(5)]
    rows += [(2000 + i, make(rng.uniform(0, 0.5)), "en", "menus") for i in range(150)]
    got = {r["id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i]["kept"] for i in range(1000, 1005)) and sum(not got[i]["kept"] for i in range(150)) == 0
    assert sum(not got[i]["kept"] for i in range(2000, 2150)) <= 7
    middle = sorted(got[i]["distance2"] for i in range(150))[75]
    assert 0.1 < middle < 7
