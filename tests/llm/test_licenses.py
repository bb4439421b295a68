import re
from collections import Counter

from lodestrata.llm import licenses
from pyspark.sql import functions as F


def brute(text, templates, threshold):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: Counter(zip(w, w[1:], strict=False))
    lines = (text or "").split("\n")
    spans = {(i, i) for i in range(len(lines))}
    filled = [bool(words(x)) for x in lines]
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            if all(filled[a : b + 1]) and (a == 0 or not filled[a - 1]) and (b == len(lines) - 1 or not filled[b + 1]):
                spans.add((a, b))
    if any(filled):
        spans.add((filled.index(True), len(filled) - 1 - filled[::-1].index(True)))
    out = set()
    for a, b in spans:
        x = grams(words("\n".join(lines[a : b + 1])))
        for name, t in templates.items():
            y = grams(words(t))
            total = sum(x.values()) + sum(y.values())
            score = 2 * sum((x & y).values()) / total if total else 0.0
            if score >= threshold and x and y:
                out.add((name, round(score, 9), a, b))
    return sorted(out)


def texts():
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    words = mit.split()
    third = len(words) // 3
    return [
        "some prose here\nReleased under the MIT License.\nmore prose",
        "\n".join([" ".join(words[:third]), " ".join(words[third : 2 * third]), " ".join(words[2 * third :])]),
        f"intro\n\n{gpl}\n\noutro of the text\nreleased UNDER the mit license!",
        mit.replace("Software", "Program", 3) + "\n" + gpl,
        f"{' '.join(words[:third])}\n\n{' '.join(words[third:])}",
        None, "", " \n\t\n", "one", "Licensed under CC BY 4.0.", "x " * 3000, "the the the the",
    ]


def test_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, texts()[0]), (0, texts()[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("matches", F.lit(1))
    for threshold in (0.8, 0.5):
        got = sorted((str(r["id"]), sorted((m["license"], round(m["dice"], 9), m["first_line"], m["last_line"]) for m in r["matches"])) for r in licenses.scan(df, threshold=threshold).collect())
        assert got == sorted((str(i), brute(t, licenses.TEMPLATES, threshold)) for i, t in rows)
    assert sum(bool(brute(t, licenses.TEMPLATES, 0.8)) for t in texts()) >= 5


def test_bounds_leave_nothing_out():
    templates = {f"t{n}": " ".join(f"w{k}" for k in range(n)) for n in range(2, 60)}
    known = licenses.Templates(templates, 0.8)
    for n in range(2, 60):
        text = " ".join(f"w{k}" for k in range(n))
        assert sorted((m[0], round(m[1], 9), m[2], m[3]) for m in known.find(text)) == brute(text, templates, 0.8)


def test_empty_and_corpus(docs, empty):
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs, {}).where("size(matches) > 0").count() == 0
    assert licenses.scan(docs).count() == docs.count()


def best_windows(text, templates, threshold):
    """The best coefficient of any run of words, by template."""
    w, out = licenses.normalised(text), {}
    for name, t in templates.items():
        y = licenses.bigrams(licenses.normalised(t))
        scores = [licenses.dice(licenses.bigrams(w[a:b]), y) for a in range(len(w)) for b in range(a + 2, min(len(w), a + 3 * y.total()) + 1)]
        if (best := max(scores, default=0.0)) >= threshold:
            out[name] = round(best, 9)
    return out


def embedded_texts():
    mit = licenses.TEMPLATES["MIT"].split()
    filler = " ".join(f"filler{k}" for k in range(500))
    cut = [" ".join(mit[:60]), " ".join(mit[60:95]), " ".join(mit[95:])]
    return [
        f"{filler}\n\n{cut[0]}\n\n{cut[1]}\n\n{cut[2]}\n\n{filler}",
        "Copyright 2020 by somebody else. Released under the MIT License. See the file for more of it and so on.",
        f"{filler}\n{cut[0]}\n{cut[1]}\n{cut[2]}\n{filler}",
    ]


def test_licences_inside_longer_texts(spark):
    assert all(not brute(t, licenses.TEMPLATES, 0.8) for t in embedded_texts())
    df = spark.createDataFrame(list(enumerate(embedded_texts())), "doc_id long, text string")
    got = {r["id"]: [tuple(m) for m in r["matches"]] for r in licenses.scan(df, embedded=True).collect()}
    assert got == {0: [("MIT", 1.0, 2, 6)], 1: [("MIT-statement", 1.0, 0, 0)], 2: [("MIT", 1.0, 1, 3)]}


def test_windows_are_the_best_of_all():
    import random

    rng, hit = random.Random(3), 0
    templates = {"a": "b c d e f g h i", "b": "b c b c d", "c": "x y z", "d": "h g f e d c b a b c d"}
    for _ in range(300):
        base = " ".join(rng.choice([*templates.values(), "q q r", "b c", "d e x"]) for _ in range(4)).split()
        text = " ".join(x for x in base if rng.random() > 0.1)
        for threshold in (0.8, 0.5):
            got: dict = {}
            for name, score, *_ in licenses.Templates(templates, threshold).windows(text):
                got[name] = max(got.get(name, 0.0), round(score, 9))
            assert got == best_windows(text, templates, threshold)
            hit += len(got)
    assert hit > 300
