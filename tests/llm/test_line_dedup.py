import hashlib
import re

from lodestrata.llm.line_dedup import line_dedup
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(rows, min_chars=10, min_docs=2):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    order = lambda i: (i is None, i)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def run(df, **how):
    got = line_dedup(df, **how).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("s")).collect()
    return sorted(map(tuple, got), key=lambda r: ((r[0] is None, r[0]), r[1:]))


def test_brute_force(docs, corpus):
    rows = [(i, t) for i, t, *_ in corpus]
    assert run(docs) == brute(rows)
    assert sum(r[2] for r in brute(rows)) > 30


def test_three_documents(docs, corpus):
    assert run(docs, min_docs=3) == brute([(i, t) for i, t, *_ in corpus], min_docs=3)


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd) == brute(rows)


def test_columns_and_empty(odd, empty):
    out = line_dedup(odd)
    assert out.columns == ["doc_id", "text", "lang", "source", "pos", "c.0", "n_lines", "n_dropped"]
    assert line_dedup(empty).count() == 0


def test_other_letters_keep_their_case(spark):
    rows = [(1, "ÄRGER über alles"), (2, "ärger über alles"), (3, "ÄRGER ÜBER alles"), (4, "ÄRGER über ALLES"), (5, "Kelvin degrees"), (6, "kelvin degrees"), (7, "İstanbul ist gross"), (8, "İSTANBUL IST GROSS")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)


def test_common_lines_are_dealt_out(docs, corpus, monkeypatch):
    from lodestrata.llm import line_dedup as module

    monkeypatch.setattr(module, "HOT_LINES", 3)
    monkeypatch.setattr(module, "HOT_SHARE", 10**9)
    rows = [(i, t) for i, t, *_ in corpus]
    assert run(docs) == brute(rows)
    assert run(docs, min_docs=3) == brute(rows, min_docs=3)


def test_without_counts_columns_stay(odd):
    out = line_dedup(odd, counts=False)
    assert out.columns == odd.columns
    assert sorted(str((r["doc_id"], r["n_lines"], r["c.0"])) for r in out.collect()) == sorted(str((r["doc_id"], r["n_lines"], r["c.0"])) for r in odd.collect())
