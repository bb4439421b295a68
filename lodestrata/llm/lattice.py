"""Language-model scoring with a subword lattice: all segmentations of a text weigh in.

A word's lattice has the pieces of an existing tokenizer vocabulary and, for words of the training texts,
the whole word as one more edge. The vocabulary's scores give first probabilities of the pieces; expected
piece counts over all training words, weighted by all segmentations, give better ones, step by step until
the likelihood settles. How often the corpus has a word gives the whole word's probability, and what that
leaves over goes to the pieces, so what is learned grows with the corpus. A text's probability is the
product of its words' marginal probabilities, each summed over all segmentations by a forward recursion on
logarithms, and of its end.

Words are counted over the whole corpus first, and lattices are built once for every distinct word; the
recursions of words of like length run side by side. The most frequent words, a bounded
number of short ones, go to every executor; the others come from a join with the table of all words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, data_file, pick, stored, table, words

#: Texts whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: At most so many words, of at most so many bytes each, are sent to every executor.
HEAD, HEAD_BYTES = 1 << 17, 32
#: Weight of the first probabilities against one expected count.
PRIOR = 500.0
#: Expectation steps end when the logarithm of the likelihood gains less than this share, or after so many.
SETTLED, STEPS = 1e-3, 20
#: Words, and cells of the table of words and places, of a chunk whose recursions run side by side.
CHUNK, CELLS = 4096, 1 << 17
LN10 = math.log(10)
#: An edge of a lattice: how far its end lies beyond that of the edge before it, its length in bytes, and its piece.
EDGE = np.dtype([("step", "u1"), ("back", "u1"), ("piece", "<u4")])


def vocabulary(path: str) -> dict[bytes, float]:
    """Piece -> log probability, from a SentencePiece model's pieces and scores.

    A leading mark of a word's start becomes a space, which no word contains. Scores that aren't log
    probabilities (merge ranks, as in BPE models) are turned into Zipf's law over the ranks. All single
    bytes are pieces, so every word has a segmentation.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    scores = [sp.get_score(i) for i in range(sp.get_piece_size())]
    ranks = min(scores) < -1000
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or not piece:
            continue
        raw = piece.replace("▁", " ", 1).encode() if piece.startswith("▁") else piece.encode()
        if "▁" in raw.decode() or b" " in raw[1:] or raw.lower() != raw:
            continue
        weight = 1 / (10 - scores[i]) if ranks else math.exp(scores[i])
        found[raw] = found.get(raw, 0.0) + weight
    least = min(found.values(), default=1.0)
    for b in range(256):
        found.setdefault(bytes([b]), least)
    total = sum(found.values())
    return {k: math.log(v / total) for k, v in found.items()}


class Pieces:
    """A vocabulary as numbers: a piece's place in the list of probabilities, and -1 for what is only the end of a piece."""

    def __init__(self, pieces: dict[bytes, float]) -> None:
        self.names = list(pieces)
        self.first = np.array([pieces[p] for p in self.names], float)
        self.number = {p[i:]: -1 for p in pieces for i in range(1, len(p))} | {p: k for k, p in enumerate(self.names)}

    def edges(self, word: bytes, steps: list[int], backs: list[int], numbers: list[int]) -> None:
        """Appends every piece in word, by end: how far its end lies beyond the one before it, its length and its number.

        Where a string is no end of a piece, nothing longer that ends like it is either.
        """
        get, last = self.number.get, 0
        for j in range(1, len(word) + 1):
            for i in range(j - 1, -1, -1):
                if (k := get(word[i:j])) is None:
                    break
                if k >= 0:
                    steps.append(j - last)
                    backs.append(j - i)
                    numbers.append(k)
                    last = j


def edge_array(own: list[bytes], pieces: Pieces) -> pa.Array:
    """The edges of each word's lattice, as binary values."""
    steps: list[int] = []
    backs: list[int] = []
    numbers: list[int] = []
    ends = [0]
    for w in own:
        pieces.edges(w, steps, backs, numbers)
        ends.append(len(numbers))
    flat = np.empty(len(numbers), EDGE)
    flat["step"], flat["back"], flat["piece"] = steps, backs, numbers
    return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.array(ends) * EDGE.itemsize).astype(np.int32)), pa.py_buffer(flat.tobytes())])


class Chunk:
    """The lattices of some words, by their places in a batch: edges by where they end, then by word."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray, levels: np.ndarray, word: np.ndarray, back: np.ndarray, piece: np.ndarray) -> None:
        self.rows, self.lengths, self.levels, self.word, self.back, self.piece = rows, lengths, levels, word, back, piece

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word over all its segmentations, and for each edge its share of what arrives where it ends."""
        places, n = len(self.levels), len(self.lengths)
        alpha = np.full((places, n), -np.inf)
        alpha[0] = 0.0
        share, at = np.zeros(len(self.word)), 0
        for j in range(1, places):
            to = at + int(self.levels[j])
            word, score = self.word[at:to], logs[self.piece[at:to]]
            terms = alpha[j - self.back[at:to], word] + score
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            if len(begin):
                top = np.maximum.reduceat(terms, begin)
                top[np.isneginf(top)] = 0.0
                many = np.diff(begin, append=len(word))
                each = np.exp(terms - np.repeat(top, many))
                sums = np.add.reduceat(each, begin)
                with np.errstate(divide="ignore"):
                    alpha[j, word[begin]] = top + np.log(sums)
                share[at:to] = each / np.repeat(np.where(sums > 0, sums, 1.0), many)
            at = to
        return alpha[self.lengths, np.arange(n)], share

    def expected(self, share: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Adds the expected number of each piece, over all segmentations of all words that often.

        From the last place backwards: how probable it is that a segmentation passes a place, times an
        edge's share of what arrives there, is the edge's probability, and adds to that of the place where it starts.
        """
        passes = np.zeros((len(self.levels), len(self.lengths)))
        passes[self.lengths, np.arange(len(self.lengths))] = counts
        to = len(self.word)
        for j in range(len(self.levels) - 1, 0, -1):
            at = to - int(self.levels[j])
            if to > at:
                word, mass = self.word[at:to], passes[j, self.word[at:to]] * share[at:to]
                np.add.at(passes, (j - self.back[at:to], word), mass)
                into += np.bincount(self.piece[at:to], weights=mass, minlength=len(into))
            to = at


def chunks(sizes: np.ndarray, edges: pa.Array) -> Iterator[Chunk]:
    """The lattices of a batch of words of so many bytes, those of like length together, in chunks of bounded size."""
    n = len(sizes)
    if not n:
        return
    ends = np.frombuffer(edges.buffers()[1], np.int32)[edges.offset : edges.offset + n + 1].astype(np.int64)
    raw = edges.buffers()[2]
    flat = (np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)).view(EDGE)
    many = np.diff(ends) // EDGE.itemsize
    word, total = np.repeat(np.arange(n), many), np.cumsum(flat["step"].astype(np.int64))
    before = np.concatenate([[0], total])[np.cumsum(many) - many]
    end = total - before[word]

    order, begin = np.argsort(sizes, kind="stable"), [0]
    long = sizes[order].tolist()
    for k, size in enumerate(long):
        if k - begin[-1] == CHUNK or k > begin[-1] and (k - begin[-1] + 1) * size > CELLS:
            begin.append(k)
    begin.append(n)
    chunk, place = np.empty(n, np.int64), np.empty(n, np.int64)
    for c, (x, y) in enumerate(zip(begin, begin[1:], strict=False)):
        chunk[order[x:y]], place[order[x:y]] = c, np.arange(y - x)
    sort = np.lexsort((place[word], end, chunk[word]))
    cuts = np.searchsorted(chunk[word][sort], np.arange(len(begin)))
    for c, (x, y) in enumerate(zip(begin, begin[1:], strict=False)):
        own = sort[cuts[c] : cuts[c + 1]]
        rows = order[x:y]
        yield Chunk(rows, sizes[rows], np.bincount(end[own], minlength=long[y - 1] + 1), place[word[own]], flat["back"][own].astype(np.int64), flat["piece"][own].astype(np.int64))


def is_held_out(id_: Column) -> Column:
    """A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """word, count: how often each word of any text (columns id, text) occurs in the training texts; 0 for words of held-out texts only."""
    each = docs.select((~is_held_out(F.col("id"))).cast("long").alias("train"), F.explode(words(ascii_lower(F.coalesce("text", F.lit(""))))).alias("word"))
    return each.groupBy("word").agg(F.sum("train").alias("count"))


def lattices(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """word, count, size, edges: the lattices of all words of counts (word, count), each behind a space; size in bytes."""
    sent = counts.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [b" " + w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            sizes, at = np.array([len(w) for w in own], np.int32), 0
            while at < len(own):  # a few thousand words, or fewer very long ones
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CELLS)) + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(sizes[at:to]), edge_array(own[at:to], sent.value)], ["word", "count", "size", "edges"])
                at = to

    return counts.mapInArrow(run, "word string, count long, size int, edges binary")


def fit(spark: SparkSession, built: DataFrame, ends: int, pieces: Pieces, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, by expectation steps over all training words of built (lattices()) and ends texts."""
    logs, end, size, before = pieces.first, 0.0, len(pieces.names), None
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            into, likely = np.zeros(size), 0.0
            for batch in batches:
                counts = batch.column(0).to_numpy().astype(float)
                for chunk in chunks(batch.column(1).to_numpy(), batch.column(2)):
                    own = counts[chunk.rows]
                    lp, share = chunk.forward(sent.value)
                    chunk.expected(share, own, into)
                    likely += float(np.where(own > 0, own * lp, 0.0).sum())
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int64()), pa.array([*into[some].tolist(), likely], pa.float64())], ["piece", "n"])

        # At most as many rows as the vocabulary has pieces.
        got = built.where("count > 0").select("count", "size", "edges").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        sent.unpersist()
        seen = np.zeros(size)
        for r in got:
            if r["piece"] >= 0:
                seen[r["piece"]] = r["n"]
        likely = sum(r["n"] for r in got if r["piece"] < 0)
        weights = seen + PRIOR * np.exp(pieces.first)
        total = weights.sum() + ends + 1
        logs, end = np.log(weights / total), math.log((ends + 1) / total)
        if before is not None and likely - before <= SETTLED * abs(before):
            break
        before = likely
    return logs, end


def token_logs(lp: np.ndarray, counts: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Natural logarithm of each token's probability: its edge as a whole, counted in the corpus, and all its segmentations.

    Of total training tokens of so many kinds, a token that was seen c times has c parts in total + kinds
    as a whole; the pieces share the other kinds' parts. Without training tokens the pieces have all.
    """
    kinds = max(1, kinds)
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(counts), math.log(kinds) + lp) - math.log(total + kinds)


def lexicon_of(built: DataFrame, logs: np.ndarray, total: int, kinds: int) -> DataFrame:
    """word, count, lp: all words of built with the natural logarithm of their marginal probability."""
    sent = built.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lp = np.empty(batch.num_rows)
            for chunk in chunks(batch.column(2).to_numpy(), batch.column(3)):
                lp[chunk.rows] = chunk.forward(sent.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(token_logs(lp, batch.column(1).to_numpy().astype(float), total, kinds))], ["word", "count", "lp"])

    return built.mapInArrow(run, "word string, count long, lp double")


def frequent(lexicon: DataFrame, head: int) -> list:
    """At most head of the most frequent short training words: all that occur oftener than some number.

    The number comes from how many words there are by the size of their count, so no task sends more than what is kept.
    """
    short = lexicon.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("count") > 0))
    step = F.floor(F.log2("count") * 64).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in short.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, least = head, None
    for s, n in sizes:
        if n > room:
            break
        room, least = room - n, s
    return [] if least is None else short.where(step >= least).collect()


def score(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words, A-Z lower-cased, and one end. base_score is the add-one unigram score over
    whole words, score the lattice's; both are log10. Null and empty texts have the end only. A null id
    is a training text's. Rows that repeat an id are texts of their own, and all of them are counted.
    Without training texts all counts are 0 and the pieces keep the vocabulary's probabilities. The
    probabilities of all texts sum up to 1.
    """
    spark = docs.sparkSession
    own = pick(docs, id=id_col, text=text_col)
    counts = stored(word_counts(own), "words")
    ends = own.where(~is_held_out(F.col("id"))).count()
    shape = counts.agg(F.sum("count").alias("n"), F.count_if(F.col("count") > 0).alias("v")).first()
    total, kinds = (shape["n"] or 0) + ends, shape["v"] + (ends > 0)
    pieces = Pieces(vocabulary(vocabulary_path))
    built = stored(lattices(counts, pieces), "lattices")
    logs, end = fit(spark, built, ends, pieces)
    # A text ends, or goes on with a piece that starts a word: the end's share of these.
    starts = np.logaddexp.reduce([s for p, s in zip(pieces.names, logs, strict=True) if p[:1] == b" "], initial=-np.inf)
    end = float(token_logs(np.array([end - np.logaddexp(end, starts)]), np.array([float(ends)]), total, kinds)[0])
    lexicon = stored(lexicon_of(built, logs, total, kinds), "lexicon")

    known = {r["word"].encode("utf-8", "surrogatepass"): (r["lp"], math.log10(r["count"] + 1)) for r in frequent(lexicon, head)}
    sent, base_end = spark.sparkContext.broadcast(known), math.log10(ends + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over frequent words and no word, and a row for each other word."""
        often = sent.value
        for batch in batches:
            marks, rest, n, k, base, lp = [], [], [], [], [], []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = Counter((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
                size, seen, b, s, others = 1, int(ends > 0), base_end, end, []
                for word, tf in tokens.items():
                    size += tf
                    if hit := often.get(word):
                        seen += tf
                        s += tf * hit[0]
                        b += tf * hit[1]
                    else:
                        others.append((word, tf))
                # The text's own row joins with no word; its key is spread like words are.
                for w, x in [(f" {mark}", None), *((w.decode("utf-8", "surrogatepass"), tf) for w, tf in others)]:
                    marks.append(mark)
                    rest.append(w)
                    n.append(size if x is None else x)
                    k.append(seen if x is None else None)
                    base.append(b if x is None else None)
                    lp.append(s if x is None else None)
                if len(marks) > 50_000:
                    yield rows(marks, rest, n, k, base, lp)
                    marks, rest, n, k, base, lp = [], [], [], [], [], []
            yield rows(marks, rest, n, k, base, lp)

    def rows(marks: list, rest: list, n: list, k: list, base: list, lp: list) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((marks, rest, n, k, base, lp), types, strict=True)], ["mark", "token", "n", "known", "base", "lp"])

    mark = F.xxhash64(F.col("id"), F.coalesce("text", F.lit("")), F.col("id").isNull())
    split = own.select(mark.alias("mark"), "text").mapInArrow(run, "mark long, token string, n long, known long, base double, lp double")
    met = split.join(lexicon.select(F.col("word").alias("token"), "count", F.col("lp").alias("word_lp")), "token", "left")
    is_text = F.col("known").isNotNull()
    by_text = met.groupBy("mark").agg(
        F.count_if(is_text).alias("copies"),
        F.sum(F.when(is_text, F.col("n"))).alias("n"),
        F.sum(F.when(is_text, F.col("known")).when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.when(is_text, F.col("base")).otherwise(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 1))).alias("base"),
        F.sum(F.when(is_text, F.col("lp")).otherwise(F.col("n") * F.col("word_lp"))).alias("lp"),
    )
    # Equal rows (id and text) were summed up together.
    one = lambda c: F.col(c) / F.col("copies")
    sums = by_text.select(F.col("mark").alias("_mark"), one("n").cast("long").alias("n_tokens"), one("known").cast("long").alias("n_known"), one("base").alias("base"), one("lp").alias("lp"))
    ids = own.select("id", mark.alias("mark"))
    out = ids.join(sums, F.col("mark") == F.col("_mark"))
    return out.select(
        "id", is_held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(total + kinds + 1)).alias("base_score"), (F.col("lp") / LN10).alias("score")
    )


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(table(spark, sf_dir, "documents"), data_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
