"""Each stage of the pipeline on its own input, against brute force or its operator's decisions."""

import corpus_pipeline
import pytest
from lodestrata.llm import decontaminate, quality
from lodestrata.llm.common import pick


@pytest.fixture(scope="module")
def documents(spark, corpus):
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def folder(spark, documents, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, corpus[114][1][:3000]), (2, "one two")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, documents, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near-duplicates", "benchmark decontamination", "mixing"]
    docs = documents
    kept = {r["id"] for r in quality.quality(docs).where("kept").collect()}
    docs = stages["quality rules"](spark, docs, folder)
    assert set(ids(docs)) == kept and docs.columns == documents.columns
    cut = stages["line dedup"](spark, docs, folder)
    assert ids(cut) == ids(docs) and cut.columns == documents.columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    held = [line.strip(" \t\n\x0b\x0c\r") for r in cut.collect() for line in set(r["text"].split("\n"))]
    long = [x for x in held if len(x) >= 10]
    assert len(long) == len(set(long))
    alone = stages["near-duplicates"](spark, docs, folder)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stay = set(ids(alone))
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert stay <= set(first.values())
    assert all(i in stay for i in first.values() if i < 60)
    clean = stages["benchmark decontamination"](spark, alone, folder)
    found = decontaminate.contamination(pick(alone, id="doc_id", text="text"), pick(spark.read.parquet(f"{folder}/benchmark.parquet"), item="item_id", text="text"))
    bad = {r["id"] for r in found.collect() if r["n_hit"] and 20 * r["n_hit"] >= r["n_words"]}
    assert set(ids(clean)) == stay - bad and bad == {114}
    mixed = stages["mixing"](spark, clean, folder)
    assert mixed.where("taken <= 0 or taken > 3 * size").count() == 0 and set(ids(mixed)) <= set(ids(clean))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and out.count() > 10
