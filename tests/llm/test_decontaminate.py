import hashlib
import re

import pytest
from lodestrata.llm.common import pick
from lodestrata.llm.decontaminate import contamination, decontaminate

PATTERN = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=lambda r: ((r[0] is None, r[0]), r[1:]))


def run(docs, items, **how):
    got = contamination(pick(docs, id="doc_id", text="text"), pick(items, item="item_id", text="text"), **how).collect()
    return sorted(((r["id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=lambda r: ((r[0] is None, r[0]), r[1:]))


@pytest.fixture(scope="module")
def items(spark, corpus):
    long = [corpus[k][1] for k in (0, 3, 5)]
    rows = [(0, long[0]), (1, long[1]), (10, long[2][:200]), (2, "One, two"), (3, None), (4, "..."), (5, "alpha"), (6, "x " * 20), (7, "ÄTA beta"), (None, "tau UPSILON phi"), (9, "äta Gamma")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_brute_force(docs, corpus, items, limit):
    want = brute([(i, t) for i, t, *_ in corpus], [tuple(r) for r in items.where("item_id is not null").collect()])
    assert run(docs, items.where("item_id is not null"), broadcast_bytes=limit) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_odd_rows_and_empty(odd, empty, items, docs):
    some = items.where("item_id = 5").unionAll(odd.selectExpr("100L", "text").limit(1))
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in some.collect()])
    assert run(odd, some) == want
    assert run(empty, items) == []
    assert [r[2:] for r in run(docs, items.limit(0))] == [(0, "")] * docs.count()


def test_decontaminate_keeps_columns(odd, spark):
    items = spark.createDataFrame([(1, "another text of the id")], "item_id long, text string")
    out = decontaminate(odd, items)
    assert out.columns == odd.columns
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in odd.collect() if r["text"] != "another text of the id")


def test_one_in_twenty(spark):
    from lodestrata.llm.decontaminate import is_contaminated
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 20), (1, 21), (0, 0)], "h long, n long")
    assert [r[0] for r in df.select(is_contaminated(F.col("h"), F.col("n"))).collect()] == [True, False, False]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_capital_sigma(spark, limit):
    """Its lower-case form depends on what stands around it, so that of a text and those of its words may differ."""
    docs = [(1, "Α.Σ. και"), (2, "η ΟΔΟΣ.Α και"), (3, "ΟΔΟΣ: α"), (4, "οδος οδοσ"), (5, "ς σ")]
    items = [(1, "Σ"), (2, "ΟΔΟΣ"), (3, "ΟΔΟΣ'Α"), (4, "οδοσ"), (5, "Α Σ")]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit)
    assert got == brute(docs, items)
    assert [r[3] for r in got] == ["1,5", "2,3", "2", "4", ""]


def test_long_texts_lose_no_passage(spark):
    """A passage in a long text is less than one word in twenty and still rejects it; a short item's word doesn't."""
    filler = " ".join(f"w{i}" for i in range(2000))
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler} single {filler}"), (3, filler), (4, "single"), (5, None), (6, f"{filler} {' '.join(item.split()[:12])}")]
    items = spark.createDataFrame([(1, item), (2, "single"), (None, "five words of one item")], "item_id long, text string")
    docs = spark.createDataFrame([*rows, (7, f"{filler} five words of one item")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate(docs, items).collect()) == [2, 3, 5, 6]
    got = {r["id"]: (r["n_hit"], r["longest"], r["items"]) for r in contamination(pick(docs, id="doc_id", text="text"), pick(items, item="item_id", text="text")).collect()}
    assert got[1] == (20, 13, ["1"]) and got[2] == (1, 1, ["2"]) and got[7] == (5, 5, []) and got[5] == (0, 0, [])
