"""Benchmark decontamination: which words of a document lie inside passages of benchmark items.

A prefix-filtered set join with the threshold set to full containment. An item's windows are sets of
shingles; a window can only occur in a text that has its rarest shingle, so the necessary prefix of each
window is that one shingle. The shingles of all texts are joined with these prefixes; the shingle's place
in the window gives the only place where the window can start (positional bound), the text's end bounds
it further (length bound), and the words of the window are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, may_fold, numbered, pick, stored, table, translated, words

#: What isn't a digit, a letter a-z or a non-ASCII character.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same, before A-Z is lower-cased.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words in a window, and in the shingles that make up its set.
WINDOW, SHINGLE = 13, 5
#: The prefixes are sent to every executor if they are no larger than this; beyond, they are shuffled.
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _key_case(text: Column) -> Column:
    """lower() of a text or of one of its words, the same for both: only a capital sigma's form depends on what stands around it."""
    return F.translate(F.lower(text), "\u03c2", "\u03c3")


def _shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(size)])


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item, window: every run of size words of each item (columns item, text), or all its words if it has fewer but some."""
    own = items.select("item", _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return own.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, size).alias("window")).distinct()


def prefixes(found: DataFrame) -> DataFrame:
    """size, shingle, at, window, items: each distinct window with its rarest shingle and the place of that in the window.

    Shingles are hashes of words in lower() with one form of the sigma, which is cheaper than the
    lower-casing of A-Z alone and leaves no match out; the windows are compared exactly.

    Rarity is the number of windows that hold a shingle; ties go to the smaller hash. A window of fewer
    words than a shingle is its own shingle. A shingle that a window repeats counts where it comes first.
    """
    kinds = found.groupBy("window").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    size = F.least(F.size("window"), F.lit(SHINGLE)).alias("size")
    each = kinds.select("window", F.transform("window", _key_case).alias("low"), size, F.explode(F.sequence(F.lit(0), F.size("window") - F.least(F.size("window"), F.lit(SHINGLE)))).alias("at"))
    value = F.lit(None).cast("long")
    for k in range(1, SHINGLE + 1):
        value = F.when(F.col("size") == k, _shingle("low", F.col("at"), k)).otherwise(value)
    each = each.withColumn("shingle", value)
    often = each.select("size", "shingle", "window").distinct().groupBy("size", "shingle").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(often, ["size", "shingle"]).groupBy("window").agg(F.min(F.struct("n", "shingle", "at", "size")).alias("b"))
    return kinds.join(best, "window").select("b.size", "b.shingle", "b.at", "window", "items")


def contamination(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs (columns id, text): id, mark (a hash of the text), n_words, n_hit, longest, items (sorted, as strings).

    items has the columns item and text. n_hit counts the words of the text that lie inside any
    occurrence of any window of an item; longest is the number of words of the longest such window, 0
    without any. The windows of an item without an id hit like others, but it isn't among the items.
    """
    index = stored(prefixes(windows(items)), "prefixes")
    sizes = [r["size"] for r in index.select("size").distinct().collect()] or [SHINGLE]  # SHINGLE numbers at most
    weight = index.agg(F.sum(F.length(F.array_join("window", " ")) * 4 + F.length(F.array_join("items", " ")) + 64)).first()[0] or 0

    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("id", F.xxhash64(text).alias("mark"), words(F.when(may_fold(text), _key_case(text)).otherwise(F.lower(text)), SEPARATORS).alias("w"), F.when(may_fold(text), words(text, RAW_SEPARATORS)).alias("raw"))
    # One more place than words: its row stands for the text itself, whether anything is found or not.
    places = split.select("id", "mark", "w", "raw", F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "word")).withColumn("n", F.size("w"))
    end = F.col("pos") == F.col("n")
    key = lambda k: F.when(F.col("pos") + k <= F.col("n"), _shingle("w", F.col("pos"), k))
    if len(sizes) == 1:
        keyed = places.withColumn("k", F.lit(sizes[0])).withColumn("key", key(sizes[0]))
    else:  # short items bring shorter shingles: a place then has a key for each size, in one pass over the texts
        each = F.array(*[F.struct(F.lit(k).alias("k"), key(k).alias("key")) for k in sizes])
        own_keys = F.explode(F.when(end, F.slice(each, 1, 1)).otherwise(F.filter(each, lambda e: e["key"].isNotNull())))
        keyed = places.withColumn("e", own_keys).select("id", "mark", "w", "raw", "pos", "n", "e.k", "e.key")
    # Where lower() may have changed more than A-Z, the text's words as they were are compared.
    run = lambda array: F.slice(array, F.col("pos") - F.col("at") + 1, F.size("window"))
    same = F.when(F.col("raw").isNull(), run("w") == F.col("window")).otherwise(translated(F.array_join(run("raw"), " ")) == F.array_join("window", " "))
    fits = (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.size("window") <= F.col("n"))
    meets = (F.col("key") == F.col("shingle")) & (F.col("k") == F.col("size")) & fits
    if weight <= broadcast_bytes:
        hit = keyed.join(F.broadcast(index), meets & same, "left").where(F.col("window").isNotNull() | end)
    else:
        # Too many prefixes for every executor: places and prefixes meet by key, and the windows are compared where the texts are.
        near = keyed.where("key is not null").select("id", "mark", "pos", "n", "k", "key").join(index, meets)
        near = near.select(F.col("id").alias("i"), F.col("mark").alias("m"), "pos", "at", "window", "items").distinct()
        joined = split.dropDuplicates(["id", "mark"]).join(near, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")))
        true = joined.where(same).select("id", "mark", "pos", F.size("w").alias("n"), "at", "window", "items")
        hit = true.unionByName(places.where(end).select("id", "mark", "pos", "n"), allowMissingColumns=True)
    # A row without a window only says that there is such a text; one at the end may do so and have none.
    lo, found = F.col("pos") - F.col("at"), F.col("window").isNotNull()
    rows = hit.select("id", "mark", "n", F.when(found, lo).alias("lo"), F.when(found, lo + F.size("window")).alias("hi"), F.col("items").alias("own"), end.cast("long").alias("texts"))

    # Rows of one text, by where their window starts: each adds the words that no earlier one reaches.
    before = Window.partitionBy("id", "mark").orderBy(F.col("lo").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    grown = rows.withColumn("new", F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.lit(0))), F.lit(0)))
    by_text = grown.groupBy("id", "mark").agg(
        F.max("n").alias("n_words"), F.sum(F.coalesce("new", F.lit(0))).alias("n_hit"), F.coalesce(F.max(F.col("hi") - F.col("lo")), F.lit(0)).alias("longest"), F.array_distinct(F.flatten(F.collect_set("own"))).alias("items"), F.sum("texts").alias("texts")
    )
    copies = by_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("texts").cast("int"))))
    return copies.select("id", "mark", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "longest", F.sort_array("items").alias("items"))


#: Of a contaminated text, at least one word in so many is hit.
ONE_IN = 20


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = ONE_IN) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that hold a passage of items.

    A text goes if a window of at least SHINGLE words occurs in it, however long it is, or if it is
    contaminated. Items of fewer words (a single common word, say) only count by the share of words hit.
    Null and empty texts have no words and stay, as do all texts if items is empty. Rows are judged by
    their text, so ids may repeat or be null. Items with a null or blank text have no window.
    """
    found = contamination(pick(docs, id=id_col, text=text_col), pick(items, item=item_col, text=item_text))
    bad = found.where((F.col("longest") >= SHINGLE) | is_contaminated(F.col("n_hit"), F.col("n_words"))).select("id", "mark").distinct()
    i, t = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = numbered(docs)
    kept = rows.join(bad, F.col(f"c{i}").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(f"c{t}", F.lit(""))) == F.col("mark")), "left_anti")
    return kept.toDF(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = contamination(pick(docs, id="doc_id", text="text"), pick(items, item="item_id", text="text"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


#: Rows of the benchmark are few; the words of the documents are joined with them window by window.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s:s + 12] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS k FROM win),
runs AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT runs.doc_id, runs.s, runs.k, win.item_id FROM runs JOIN (SELECT item_id, array_to_string(x, ' ') AS x, len(x) AS k FROM win) win ON runs.x = win.x AND runs.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, k, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
