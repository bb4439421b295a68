"""Quality rules: base rules of one text, then robust multivariate outliers among texts of a kind.

Each text gets a vector of transformed statistics. For every language and source the minimum covariance
determinant estimate finds the centre and scatter of the densest share of its texts, by concentration
steps from several starts until the determinants settle, and texts far away in Mahalanobis distance are rejected. Everything is DataFrame
functions: statistics are computed inside the row, and a step is one grouped aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import SPACE, numbered, pick, stored, table, words

#: Characters that count as symbols, for Java's regular expressions.
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: The share of a group that its estimate rests on, how often it is refined at most, and the change of the determinant's logarithm that ends it.
SHARE, STEPS, SETTLED = 0.75, 12, 1e-3
#: Beside the median and the moments of all, so many starts from the moments of a tenth of the texts.
TENTHS = 2
#: Groups with fewer texts than this use their language's estimate, or else that of all texts.
MIN_GROUP = 50
#: Standard deviations below which a statistic doesn't count as narrower, by feature, for estimates that no others are given for; judge() takes those of floors().
FLOORS = (0.12, 0.06, 0.15, 0.15)
#: Median and rejection bound of the squared distance: quantiles 0.5 and 0.99999 of chi-square with 4 degrees of freedom.
CHI_MEDIAN, CHI_BOUND = 3.3567, 28.4733
FEATURES = ("f0", "f1", "f2", "f3")
#: Up to so many groups, their estimates are sent to every executor.
BROADCAST_GROUPS = 20_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column, size: int) -> Column:
    """Words inside windows whose hash occurs twice or more; hashes: one per place where a window starts."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        """The places, in order, of the windows that equal a neighbour in the sorted array s."""
        same = F.transform(s, lambda x, j: F.when((F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])), x["i"]))
        return F.sort_array(F.array_compact(same))

    def covered(p: Column) -> Column:
        """A window adds its words up to where the next one starts."""
        return F.aggregate(F.transform(p, lambda at, j: F.least(F.coalesce(F.get(p, j + 1) - at, F.lit(size)), F.lit(size))), F.lit(0), lambda a, x: a + x)

    return _let(placed, lambda s: _let(starts(s), covered))


def statistics(docs: DataFrame) -> DataFrame:
    """docs' other columns with text replaced by n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint)."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(*rest, text.alias("t"), words(text).alias("w"))
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    at = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("g", F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("h"), i + k) for k in range(WINDOW)])))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    whole = hashed.withColumn("lines", lines)
    n = {
        "n_words": F.size("w"),
        "word_chars": F.char_length(F.array_join("w", "")),
        "n_symbols": F.regexp_count("t", F.lit(SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct("g")) < F.size("g"), _repeated(F.col("g"), WINDOW)).otherwise(F.lit(0)),
    }
    return whole.select(*rest, *[c.cast("long").alias(k) for k, c in n.items()], F.size("lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics: log word length, and shares on the arcsine scale, which evens out their variance."""
    share = lambda a, b: F.asin(F.sqrt(F.least(a / F.greatest(b, F.lit(1)), F.lit(1.0))))
    return [
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        share(F.col("n_symbols"), F.col("word_chars")),
        share(F.col("n_dup_lines"), F.col("n_lines")),
        share(F.col("n_repeat_words"), F.col("n_words")),
    ]


def floors(good: DataFrame) -> tuple[float, ...]:
    """By feature, the standard deviation that counting alone gives the middle text of good, all groups pooled.

    A share of n on the arcsine scale has the variance 1 / (4n) whatever the share, n being characters,
    lines, or windows' worth of words; the logarithm of a mean word length about the same of its words. A
    source whose texts all agree (most have no symbol or repeat) must not reject what chance can give.
    """
    sizes = (F.col("n_words"), F.col("word_chars"), F.col("n_lines"), F.col("n_words") / WINDOW)
    middle = good.agg(*[F.percentile_approx(F.greatest(n.cast("double"), F.lit(1.0)), F.lit(0.5), F.lit(2000)) for n in sizes]).first()
    return tuple(FLOORS if middle[0] is None else (0.5 / n**0.5 for n in middle))


def _whitened(fits: DataFrame, least: tuple[float, ...] = FLOORS) -> DataFrame:
    """fits with w00, w10 ...: the inverse of the Cholesky factor of the covariances, whose variances have those of least added so that it exists.

    Every element is a column of its own, so that none is written out again in the next.
    """
    p = len(FEATURES)
    minus = lambda terms, start: reduce(lambda a, b: a - b, terms, start)
    for i in range(p):
        for j in range(i + 1):
            left = minus([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.col(f"s{i}{j}") + F.lit(least[i] ** 2 if i == j else 0.0))
            fits = fits.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}{j}"))
    for i in range(p):
        for j in range(i + 1):
            fits = fits.withColumn(f"w{i}{j}", (F.lit(1.0) if i == j else minus([F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)], F.lit(0.0))) / F.col(f"l{i}{i}"))
    return fits.drop(*[f"l{i}{j}" for i in range(p) for j in range(i + 1)])


def _distance() -> Column:
    """The squared Mahalanobis distance of the features from the estimate beside them."""
    p = range(len(FEATURES))
    parts = [reduce(lambda a, b: a + b, [F.col(f"w{i}{j}") * (F.col(FEATURES[j]) - F.col(f"m{j}")) for j in p if j <= i]) for i in p]
    return reduce(lambda a, b: a + b, [F.pow(x, F.lit(2.0)) for x in parts])


#: A group: level 0 is a language and source, 1 a language, 2 all texts.
KEYS = ("level", "g_lang", "g_source")


def _beside(rows: DataFrame, groups: DataFrame, few: bool, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows joined with what groups have for their keys; sent to every executor if the groups are few."""
    mine = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(F.broadcast(mine) if few else mine, on).drop(*[f"_{k}" for k in keys])


def mcd(rows: DataFrame, few: bool, share: float = SHARE, steps: int = STEPS, least: tuple[float, ...] = FLOORS) -> DataFrame:
    """By KEYS: n, means, whitening and scale of the minimum covariance determinant estimate of the features.

    There are several starts: the median of each feature with its spread around it, the moments of all
    texts, and those of a few tenths of the texts by a hash. Every step takes the share of each group that
    is nearest to the present estimate, and estimates anew from these, until the determinant settles; starts
    that have settled take no part in further steps. Of a
    group's starts the one with the smallest determinant counts. scale makes the median distance of all
    texts of a group what it would be for normal ones, and is never under 1, so a group that is tighter
    than the floors, or has constant features, rejects no more.
    """
    p, keys = range(len(FEATURES)), (*KEYS, "start")
    quarter = lambda i, q: F.percentile_approx(FEATURES[i], F.lit(q), F.lit(2000))
    moments = [F.avg(FEATURES[i]).alias(f"m{i}") for i in p] + [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"s{i}{j}") for i in p for j in p if j <= i]
    logdet = -2 * reduce(lambda a, b: a + b, [F.log(F.col(f"w{i}{i}")) for i in p])
    whole = lambda fits: stored(_whitened(fits, least).withColumn("logdet", logdet), "estimates")
    first = rows.groupBy(*KEYS).agg(*[quarter(i, 0.5).alias(f"m{i}") for i in p], *[F.pow((quarter(i, 0.75) - quarter(i, 0.25)) / 1.349, F.lit(2.0)).alias(f"s{i}{i}") for i in p])
    for i in p:
        for j in range(i):
            first = first.withColumn(f"s{i}{j}", F.lit(0.0))
    first = first.withColumn("start", F.lit(0)).unionByName(rows.groupBy(*KEYS).agg(*moments).withColumn("start", F.lit(1)))
    part = rows.withColumn("start", F.pmod(F.xxhash64(*FEATURES), F.lit(10)).cast("int") + 2).where(F.col("start") < 2 + TENTHS)
    fits = whole(first.unionByName(part.groupBy(*keys).agg(*moments)))
    settled = F.coalesce(F.abs(F.col("logdet") - F.col("was")) <= SETTLED, F.lit(True))
    ended = []
    for _ in range(steps):
        near = _beside(rows, fits.withColumn("was", F.col("logdet")), few).withColumn("d2", _distance()).select(*keys, *FEATURES, "d2", "was")
        cut = near.groupBy(*keys).agg(F.percentile_approx("d2", F.lit(share), F.lit(2000)).alias("cut"))
        moved = whole(_beside(near, cut, few, keys).where("d2 <= cut").groupBy(*keys).agg(*moments, F.max("was").alias("was")))
        ended.append(moved.where(settled).drop("was"))
        fits = moved.where(~settled).drop("was")
        if fits.isEmpty():
            break
    fits = reduce(DataFrame.unionByName, [*ended, fits])
    numbers = [c for c in fits.columns if c not in (*keys, "logdet")]
    best = fits.groupBy(*KEYS).agg(F.min_by(F.struct(*numbers), F.struct("logdet", "start")).alias("best"))
    fits = stored(best.select(*KEYS, "best.*"), "estimates")
    mid = _beside(rows, fits, few).groupBy(*KEYS).agg(F.percentile_approx(_distance(), F.lit(0.5), F.lit(2000)).alias("mid"), F.count(F.lit(1)).alias("n"))
    return _beside(fits, mid.select(*KEYS, "n", F.greatest(F.col("mid") / CHI_MEDIAN, F.lit(1.0)).alias("scale")), few)


def judge(stats: DataFrame, bound: float = CHI_BOUND, min_group: int = MIN_GROUP) -> DataFrame:
    """stats (with lang, source and the statistics) with base_failed, distance2 and kept.

    Estimates rest on the texts that pass the base rules. A text is held against the estimate of its
    language and source, or that of its language where the group has fewer than min_group such texts,
    or that of all texts where the language has too few as well, or none: then it is kept.
    """
    full = stored(stats.withColumn("base_failed", base_failed()).withColumns(dict(zip(FEATURES, features(), strict=True))), "statistics")
    # The steps read the features many times: alone, they are a small part of the texts' table.
    good = stored(full.where(~F.col("base_failed")).select("lang", "source", *FEATURES), "features")
    none = F.lit(None).cast("string")
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    levels = F.array(*[F.struct(F.lit(no).alias("level"), (lang if no < 2 else none).alias("g_lang"), (source if no < 1 else none).alias("g_source")) for no in range(3)])
    groups = good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.withColumn("g", F.explode(levels)).groupBy("g.level", "g.g_lang", "g.g_source").agg(F.sum("n").alias("n"))
    sizes = stored(sizes.where(F.col("n") >= min_group), "groups")
    few = sizes.count() <= BROADCAST_GROUPS
    rows = _beside(good.select(F.explode(levels).alias("g"), *FEATURES).select("g.*", *FEATURES), sizes.drop("n"), few)
    fits = stored(mcd(rows, few, least=floors(full.where(~F.col("base_failed")))), "estimates")

    # Of a text's groups that have an estimate, the first counts.
    out, p = full, range(len(FEATURES))
    numbers = [*[f"m{i}" for i in p], *[f"w{i}{j}" for i in p for j in range(i + 1)], "scale"]
    for no in range(3):
        mine = fits.where(F.col("level") == no).select(F.col("g_lang").alias("_l"), F.col("g_source").alias("_s"), F.struct(*numbers).alias(f"e{no}"))
        on = F.lit(True)
        if no < 2:
            on = lang.eqNullSafe(F.col("_l"))
        if no < 1:
            on = on & source.eqNullSafe(F.col("_s"))
        if no < 2:
            out = out.join(F.broadcast(mine) if few else mine, on, "left").drop("_l", "_s")
        else:
            whole = mine.first()  # one row: the estimate of all texts
            out = out.withColumn("e2", F.struct(*[F.lit(whole["e2"][c]).alias(c) for c in numbers]) if whole else F.lit(None).cast(fits.select(F.struct(*numbers).alias("e")).schema["e"].dataType))
    chosen = out.withColumn("e", F.coalesce("e0", "e1", "e2")).drop("e0", "e1", "e2").select("*", *[F.col(f"e.{c}").alias(c) for c in numbers])
    judged = chosen.withColumn("distance2", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= bound)
    return judged.select(*stats.columns, "base_failed", "distance2", kept.alias("kept"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, lang, source, the statistics, base_failed, distance2 and kept.

    Null, empty and blank texts have no words and fail the base rules. Null languages and sources are
    groups like any other. Ids may repeat or be null. An empty table gives an empty table.
    """
    return judge(statistics(pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col)))


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs, all columns, that quality() keeps. The texts are written down once with their statistics, and not shuffled."""
    at = {c: docs.columns.index(c) for c in (text_col, lang_col, source_col)}
    row = F.struct(*[F.col(f"c{i}") for i in range(len(docs.columns))]).alias("row")
    whole = numbered(docs).select(row, F.col(f"c{at[text_col]}").alias("text"), F.col(f"c{at[lang_col]}").alias("lang"), F.col(f"c{at[source_col]}").alias("source"))
    kept = judge(statistics(whole)).where("kept")
    return kept.select("row.*").toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
