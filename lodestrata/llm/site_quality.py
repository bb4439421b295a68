"""Quality classifier with site priors: hierarchical empirical Bayes.

A logistic model of a document's own statistics gives its evidence. Sites form a hierarchy: all, host,
host and path. Every level's share of good documents is estimated by grouped sums and shrunk toward the
level above it, the more the fewer documents it has; how much is estimated from the spread between the
sites of a level. A document's posterior combines its evidence with its path's share; shares are
estimated again from the posteriors until they settle, as weak evidence alone would make all sites look
alike. In the end each document's own part is taken out of its site's shares.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import pick, stored, table

#: The model is fitted to at most so many labelled documents, those that come first by a hash of their id.
MAX_LABELLED = 20_000
#: Labelled documents whose crc32 of the id leaves remainder 0 are held out of the fit.
FOLDS = 5
#: Weight decay of the fit, and its steps.
DECAY, STEPS = 1.0, 25
#: Documents below this posterior go. A share of this many documents stands in where sites don't differ at all.
CUT, MOST_SHRINKAGE = 0.5, 1e6
BROADCAST_SITES = 100_000
#: Shares are estimated until they change by less than this for the mean document, or so often.
SETTLED, ROUNDS = 2e-3, 12
_WORD, _ODD = re.compile(r"\S+"), re.compile(r"[^\w\s.,;:'\"()?-]")


def features(text: str | None) -> list[float]:
    """Statistics that don't depend on language: lengths, shares of characters, and repetition. All finite, also of empty texts."""
    text = text or ""
    words, lines = _WORD.findall(text), [x for x in text.split("\n") if x.strip()]
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)),
        min(4.0, np.log1p(len(text) / n)),
        np.sqrt(len(_ODD.findall(text)) / n),
        np.sqrt(sum(c.isupper() for c in text) / chars),
        np.sqrt(sum(c.isdigit() for c in text) / chars),
        np.sqrt(1 - len(set(lines)) / max(1, len(lines))),
        np.sqrt(max(counts.values(), default=0) / n),
        np.log1p(len(counts)) - np.log1p(len(words)),
        np.sqrt(sum(k for k in pairs.values() if k > 1) / n),
        np.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n),
        float(len(words) < 20),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the first for the constant) of a logistic model, by Newton's steps. Without rows all weights are 0."""
    if not len(x):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
    w, decay = np.zeros(z.shape[1]), np.diag([1e-3] + [DECAY] * x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - decay @ w
        w = w + np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + decay, gradient)
    return mean, scale, w


def with_features(docs: DataFrame) -> DataFrame:
    """docs with the column text replaced by x, the array of its statistics."""
    at = docs.columns.index("text")
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([[float(v) for v in features(t.as_py())] for t in batch.column(at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), x], [*(f.name for f in rest), "x"])

    return docs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", x array<double>")


def first_rows(labelled: DataFrame, most: int) -> list:
    """The first rows of labelled (x, label, o, id) by o, id and x, at most so many; equal rows all count.

    How many there are by the leading 16 bits of o tells which of them are needed, so tasks send few others.
    """
    lead = F.shiftright("o", 48)
    sizes = sorted((r["s"], r["n"]) for r in labelled.groupBy(lead.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    last, total = None, 0
    for last, n in sizes:
        total += n
        if total >= most:
            break
    if last is None:
        return []
    kinds = labelled.where(lead <= last).groupBy("o", "id", "x", "label").agg(F.count(F.lit(1)).alias("n"))
    found: list = []
    for r in kinds.orderBy("o", "id", "x").limit(most).collect():
        found += [r] * min(r["n"], most - len(found))
    return found


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(q / (1 - q))


def strength(between: float, within: float, df_between: float, df_within: float, effective: float) -> float:
    """How many documents the level above counts for: the variance within sites over that between them, one at least.

    between and within: sums of squares with their degrees of freedom; effective: how many documents' worth of
    spread the sum between holds (the usual analysis of variance of groups of unequal size). Sites of one
    document have nothing within, and lean on the variance pooled from all others. Where the sites don't
    spread more than chance, or nothing can be told, the level above counts for everything.
    """
    if df_within <= 0 or df_between <= 0 or effective <= 0:
        return MOST_SHRINKAGE
    inside = within / df_within
    spread = (between - df_between * inside) / effective
    return min(MOST_SHRINKAGE, max(1.0, inside / spread)) if spread > 0 else MOST_SHRINKAGE


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """By site (_h, _p): sums and numbers of its path and host, how strongly a path is drawn to its host (_m) and a host to all (_k); and the overall share.

    rows has host, path and p, the probability that the document is good. Null hosts and paths are sites.
    """
    paths = stored(rows.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).alias("n"), F.sum(F.pow("p", F.lit(2.0))).alias("sq")), "paths")
    by_host = [F.sum("good").alias("h_good"), F.sum("n").alias("h_n"), F.sum("sq").alias("h_sq"), F.sum(F.pow("good", F.lit(2.0)) / F.col("n")).alias("mid"), F.count(F.lit(1)).alias("paths"), F.sum(F.pow("n", F.lit(2.0))).alias("n2")]
    hosts = stored(paths.groupBy("host").agg(*by_host), "hosts")
    own = F.pow("h_good", F.lit(2.0)) / F.col("h_n")
    sums = [F.sum("h_good"), F.sum("h_n"), F.sum(F.col("h_sq") - F.col("mid")), F.sum(F.col("mid") - own), F.sum(own), F.sum("paths"), F.count(F.lit(1)), F.sum(F.col("n2") / F.col("h_n")), F.sum(F.pow("h_n", F.lit(2.0)))]
    good, n, in_paths, of_paths, of_hosts, n_paths, n_hosts, n2_paths, n2_hosts = (float(x or 0) for x in hosts.agg(*sums).first())
    overall = good / n if n else 0.5
    m = strength(of_paths, in_paths, n_paths - n_hosts, n - n_paths, n - n2_paths)
    k = strength(of_hosts - (good * good / n if n else 0.0), in_paths + of_paths, n_hosts - 1, n - n_hosts, n - n2_hosts / n if n else 0.0)
    small = hosts.select(F.col("host").alias("_host"), F.col("h_good").alias("_h_good"), F.col("h_n").alias("_h_n"))
    joined = paths.join(small, F.col("host").eqNullSafe(F.col("_host")))
    sites = joined.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("good").alias("_good"), F.col("n").alias("_n"), "_h_good", "_h_n", F.lit(m).alias("_m"), F.lit(k).alias("_k"))
    return stored(sites, "sites"), overall


def _path_share(overall: Column) -> Column:
    """A path's share of good documents, drawn to its host's, which is drawn to the overall one."""
    host = (F.col("_h_good") + F.col("_k") * overall) / (F.col("_h_n") + F.col("_k"))
    return (F.col("_good") + F.col("_m") * host) / (F.col("_n") + F.col("_m"))


def _at_site(rows: DataFrame, sites: DataFrame, few: bool) -> DataFrame:
    """rows (host, path) with what sites have for them; sent to every executor if the sites are few."""
    return rows.join(F.broadcast(sites) if few else sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of docs: id, evidence (the model's probability), host_share, path_share, posterior and kept.

    Both shares are those of the other documents of the host and of the path, so that no document's
    evidence counts twice; the host's is shrunk toward the overall share, the path's toward the host's. A
    document alone on its host has the overall share. labels has the id and a
    label 0 or 1; null labels and ids are left out, and an id with several labels counts as its mean,
    rounded down. Null, empty and very long texts have finite statistics. Null hosts and paths are sites
    of their own. Without labels every evidence is a half. Ids may repeat or be null.
    """
    own = pick(docs, id=id_col, text=text_col, host=host_col, path=path_col)
    full = stored(with_features(own.select("id", "text", F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"))), "features")
    known = pick(labels, label_id=id_col, label=label_col).where("label_id is not null and label in (0, 1)").groupBy("label_id").agg(F.floor(F.avg("label")).alias("label"))
    labelled = full.join(known, F.col("id") == F.col("label_id")).where(~held_out(F.col("id"))).select("x", "label", F.xxhash64("id").alias("o"), "id")
    sample = first_rows(labelled, max_labelled)
    mean, scale, w = fit(np.array([r["x"] for r in sample], float).reshape(len(sample), -1) if sample else np.zeros((0, len(features("")))), np.array([float(r["label"]) for r in sample]))

    terms = [F.lit(float(w[i + 1])) * F.greatest(F.least((F.get("x", F.lit(i)) - F.lit(float(mean[i]))) / F.lit(float(scale[i])), F.lit(8.0)), F.lit(-8.0)) for i in range(len(mean))]
    scored = full.withColumn("p", 1 / (1 + F.exp(-sum(terms, F.lit(float(w[0])))))).select("id", "host", "path", "p")
    sites, base = site_posteriors(scored)
    few = sites.count() <= BROADCAST_SITES
    # A document's odds: its own, and its site's against those of all, on which the evidence rests.
    posterior = lambda share: 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(share) - _logit(F.lit(base)))))
    overall, share, n = base, _path_share(F.lit(base)), F.col("_n")
    for _ in range(ROUNDS):
        now, level = site_posteriors(_at_site(scored, sites, few).select("host", "path", posterior(share).alias("p")))
        was = sites.select(F.col("_h").alias("w_h"), F.col("_p").alias("w_p"), share.alias("was"))
        share = _path_share(F.lit(level))
        moved = now.join(F.broadcast(was) if few else was, F.col("_h").eqNullSafe(F.col("w_h")) & F.col("_p").eqNullSafe(F.col("w_p"))).agg((F.sum(n * F.abs(share - F.col("was"))) / F.sum(n)).alias("m")).first()["m"]
        before, sites, overall, last = sites, now, level, overall
        if (moved or 0.0) <= SETTLED:
            break
    # The sums of the last round hold each document's posterior of the round before: that is what is taken out.
    mine = _at_site(scored, before, few).withColumn("q", posterior(_path_share(F.lit(last)))).select("id", "host", "path", "p", "q")
    others = lambda good, n, by, above: (F.col(good) - F.col("q") + F.col(by) * above) / (F.col(n) - 1 + F.col(by))
    combined = _at_site(mine, sites, few).withColumn("host_share", others("_h_good", "_h_n", "_k", F.lit(overall)))
    combined = combined.withColumn("path_share", others("_good", "_n", "_m", F.col("host_share")))
    return combined.withColumn("posterior", posterior(F.col("path_share"))).select("id", F.col("p").alias("evidence"), "host_share", "path_share", "posterior", (F.col("posterior") >= CUT).alias("kept"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, evidence, host_share, path_share, posterior, kept. A document's source is its host, its language the path."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
