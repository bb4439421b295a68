"""Line dedup: lines that several documents share stay in one document only.

Main path, DataFrame functions only: explode the lines of every text, reduce each to the digest of its
normalised form, count distinct documents per digest (partial sums before the shuffle), join the digests
over the threshold back to the lines, and rebuild each text from the positions that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import SPACE_CHARS, ascii_lower_key, numbered, stored, table


def _digest(key: Column) -> Column:
    """128 bits of SHA-256: short to shuffle, and no two keys are confused, whoever wrote them."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def _lines(src: DataFrame, min_chars: int) -> DataFrame:
    exploded = src.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    key = F.trim(F.col("line"), F.lit(SPACE_CHARS))
    # Lower-casing A-Z changes no length, so short keys go before it.
    return exploded.where(F.char_length(key) >= min_chars).select("id", "mark", "pos", _digest(ascii_lower_key(key)).alias("digest"))


#: A digest with more lines than this, and with more than one in so many of all shared lines, is dealt over several tasks.
HOT_LINES, HOT_SHARE = 1_000, 100_000


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """digest, keep, n: the digests found in at least min_docs documents, with the smallest id that holds each and their number of lines."""
    found = [F.min("id").alias("keep"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")]
    if min_docs > 2:
        by_doc = lines.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("own"))
        kinds = by_doc.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("docs"), F.sum("own").alias("n"))
        return kinds.where(F.col("docs") >= min_docs).select("digest", "keep", "n")
    several = (F.col("keep") != F.col("most")) | (F.col("nulls") & F.col("keep").isNotNull())
    return lines.groupBy("digest").agg(*found).where(several).select("digest", "keep", "n")


def _drops(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """id, mark, drops: the places of the lines that go.

    The lines of a very common digest would meet in one task; each such digest is copied into parts, and its
    lines are dealt over these. At most HOT_SHARE digests are that common, so they are few enough to broadcast.
    """
    shared = stored(shared, "shared-lines")
    limit = max(HOT_LINES, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    parts = F.ceil(F.col("n") / limit).cast("int")
    hot = F.broadcast(shared.where(F.col("n") > limit).select(F.col("digest").alias("hot"), parts.alias("parts")))
    part = F.pmod(F.xxhash64("id", "mark", "pos"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = lines.join(hot, F.col("digest") == F.col("hot"), "left").select("id", "mark", "pos", "digest", part.alias("part"))
    copies = shared.select("digest", "keep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    gone = dealt.join(copies, ["digest", "part"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    return gone.groupBy(F.col("id").alias("d_id"), F.col("mark").alias("d_mark")).agg(F.collect_set("pos").alias("drops"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, counts: bool = True) -> DataFrame:
    """All rows and columns of docs, the texts without repeated lines, and with counts two columns more: n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of at least min_chars
    characters that at least min_docs documents hold keep all their lines in the document with the
    smallest id, and lose them in the others.

    Null or empty text: one empty line, so "". A null id is a document of its own that sorts last. Rows
    that repeat an id are one document; each of them is returned. A document may repeat its own lines.
    With counts, input columns called n_lines or n_dropped are replaced; without, they stay as they are.
    An empty table gives an empty table.
    """
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    whole = numbered(docs).withColumns({"id": F.col(f"c{at_id}"), "text": F.coalesce(F.col(f"c{at_text}"), F.lit(""))}).withColumn("mark", F.xxhash64("text"))
    lines = _lines(whole.select("id", "mark", "text"), min_chars)
    drops = _drops(lines, shared_lines(lines, min_docs))

    joined = whole.join(drops, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("mark") == F.col("d_mark")), "left")
    n_lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("drops"))
    # The array of lines is bound to a variable once, so that it isn't split again for each position.
    rebuilt = F.get(F.transform(F.array(F.split("text", "\n")), lambda line: F.array_join(F.transform(stay, lambda i: F.get(line, i)), "\n")), F.lit(0))
    out = joined.withColumn("n_lines", n_lines.cast("long")).withColumn("kept", F.when(F.col("drops").isNull(), F.col("text")).otherwise(rebuilt))
    columns = [F.col("kept" if i == at_text else f"c{i}").alias(name) for i, name in enumerate(docs.columns) if not counts or name not in ("n_lines", "n_dropped")]
    return out.select(*columns, *([F.col("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []))


def recounted(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the column that counts the text's characters, if there is one, counted again."""
    if chars_col not in docs.columns:
        return docs
    at, text, rows = docs.columns.index(chars_col), docs.columns.index(text_col), numbered(docs)
    return rows.withColumn(f"c{at}", F.char_length(f"c{text}").cast(docs.schema[at].dataType)).toDF(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keep FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keep AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
