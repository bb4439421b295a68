import re

from lodestrata.llm import common
from pyspark.sql import functions as F


def test_lower_case_of_ascii_only(spark):
    texts = ["", "ABC xyz", "ÄÖÜ ß A", "İI K K", "ΣΑΣ Σ", "日本 ABC", "𝐀Ⓐ Z", "ǅ É", "a\nB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert [r[0] for r in df.select(common.ascii_lower(F.col("t"))).collect()] == want


def test_keys_tell_what_lower_case_tells(spark):
    texts = ["äbÄ", "Äbä", "ÄBä", "ÄBÄ", "äbä", "Kk", "kK", "kk", "KK", "İi", "iİ", "abc", "ABC", "aΣ", "AΣ", "aς", "aσ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(common.ascii_lower_key(F.col("t"))).collect()]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert all((got[i] == got[j]) == (low[i] == low[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_words_and_columns(spark):
    df = spark.createDataFrame([("  a\x0bb \t", 1, 2)], "`t.x` string, T int, t int")
    assert common.pick(df, a="t.x", b="t").select(common.words(F.col("a")), "b").first() == (["a", "b"], 2)
    assert [r[0] for r in spark.createDataFrame([(None,), (" ",)], "t string").select(common.words(F.col("t"))).collect()] == [[], []]
