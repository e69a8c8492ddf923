"""Quality scores by hierarchical empirical Bayes.

Three levels of evidence meet on the scale of log odds:

* Document.  A logistic classifier over measures of the whole text, fitted on a bounded sample of labelled rows.
* Host.  The share of good documents of a host: its labels, and the classifier's probabilities where there are none,
  shrunk towards the global share by a Beta prior.
* Path.  The same for a part of the host, shrunk towards the host's share.

The strength of each prior (in documents) is itself estimated from all sites by moments: how much the shares of
sites differ beyond what their sizes explain, paths within their hosts.  A sparse site thus takes its parent's share, a
large one keeps its own.  Neither a document nor a copy of its text counts in the shares that it is judged by.  Sites
are only ever aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, saved

MEASURES = ("log_words", "symbols", "upper", "digits", "marked_words", "distinct_words", "distinct_lines", "top_word", "word_length", "short_words")
#: Labelled rows that the classifier is fitted on, at most, and its ridge penalty.
SAMPLE_ROWS, RIDGE = 20_000, 1e-3


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256)
    upper = (code >= 65) & (code <= 90)
    digit = (code >= 48) & (code <= 57)
    usual = upper | ((code >= 97) & (code <= 122)) | digit | (code >= 128) | np.isin(code, [9, 10, 13, 32, 33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63])
    return ~usual, upper, digit


_ODD, _UPPER, _DIGIT = _classes()


def measures(text: str | None) -> list[float]:
    """MEASURES of one whole text; zeros for null or empty."""
    if not text or not (words := text.split()):
        return [0.0] * len(MEASURES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, total = len(words), raw.sum()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" or w[-2:] in ("!!", "??"))
    return [
        np.log1p(n), raw[_ODD].sum() / total, raw[_UPPER].sum() / total, raw[_DIGIT].sum() / total, marked / n, len(counts) / n,
        len(set(lines)) / max(1, len(lines)), max(counts.values()) / n, min(total / n, 30) / 10, sum(c for w, c in counts.items() if len(w) < 3) / n,
    ]


@dataclass
class Classifier:
    """Standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[1:] + self.weights[0], -12, 12)


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Newton's method; with one class only (or no rows) the intercept alone says the smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        d = len(MEASURES)
        return Classifier(np.zeros(d), np.ones(d), np.concatenate([[np.log(share / (1 - share))], np.zeros(d)]))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], 1)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.full(len(w), RIDGE * len(y))
        ridge[0] = 1e-9
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows ``*keep, x``: the measures of every whole text."""
    cols = docs.select("text", *keep)
    names = [f.name for f in cols.schema.fields[1:]]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[1:]) + "x array<double>"

    def run(batch: pa.RecordBatch) -> dict:
        x = [measures(t) for t in batch.column(0).to_pylist()]
        return {n: batch.column(i + 1) for i, n in enumerate(names)} | {"x": pa.array(x, pa.list_(pa.float64()))}

    return map_batches(cols, run, schema, [*names, "x"])


def _odds(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def prior_strength(sites: DataFrame, *by: str) -> DataFrame:
    """One row ``mean, strength``: the documents that the Beta prior over sites (good, n) counts for, by moments.

    With ``by`` sites are compared within their groups only.  Variance v of the shares between sites, beyond binomial
    noise: strength = m (1 - m) / v - 1, from 1 to 10,000.
    """
    total = sites.groupBy(*by).agg(F.sum("good").alias("g"), F.sum("n").alias("t"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"))
    m = F.col("g") / F.col("t")
    between = F.col("gg") - F.col("t") * m * m - (F.col("k") - 1) * m * (1 - m)
    all_ = total.agg(F.sum("g").alias("g"), F.sum("t").alias("t"), F.sum(F.col("t") * m * (1 - m)).alias("noise"), F.sum(between).alias("between"), F.sum(F.col("t") - F.col("nn") / F.col("t")).alias("free"))
    spread = F.try_divide(F.greatest(F.lit(0.0), F.col("between")), F.col("free"))
    strength = F.coalesce(F.try_divide(F.try_divide("noise", "t"), spread) - 1, F.lit(10_000.0))
    return all_.select((F.col("g") / F.col("t")).alias("mean"), F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), strength)).alias("strength"))


def score(docs: DataFrame, labels: DataFrame, *, host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """Quality of every document: rows ``doc_id, evidence, host_share, path_share, quality, keep``.

    ``labels`` has doc_id and quality (0 or 1); rows with nulls there are unlabelled, and of several labels the smallest
    counts.  ``host`` and ``path`` default to the source and to the language within it; null is a site like others.
    ``quality`` is the probability of being good, ``keep`` whether it reaches ``threshold``.  A null or empty text has
    measures of 0; null ids are unlabelled; repeated rows are scored alike.  Without labels every score is 1/2.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("label"))
    rows = docs.select("doc_id", "text", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.xxhash64("text").alias("copy"))
    x = saved(measured(rows, "doc_id", "host", "path", "copy").join(known, "doc_id", "left"))
    sample = x.where("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "label").limit(SAMPLE_ROWS).toArrow()
    data = np.array(sample["x"].to_pylist(), np.float64).reshape(-1, len(MEASURES))
    model = fit(data, np.array(sample["label"].to_pylist(), np.float64))

    def judge(batch: pa.RecordBatch) -> dict:
        odds = model.log_odds(np.array(batch.column(5).to_pylist(), np.float64).reshape(-1, len(MEASURES)))
        return {n: batch.column(i) for i, n in enumerate(("doc_id", "host", "path", "copy", "label"))} | {"evidence": odds}

    judged = map_batches(x.select("doc_id", "host", "path", "copy", "label", "x"), judge, "doc_id bigint, host string, path string, copy bigint, label double, evidence double")
    judged = saved(judged.withColumn("good", F.coalesce("label", 1 / (1 + F.exp(-F.col("evidence"))))))
    sums = [F.sum("good").alias("good"), F.sum("n").alias("n")]
    copies = judged.withColumn("n", F.lit(1)).groupBy("host", "path", "copy").agg(*sums)
    paths = saved(copies.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*sums)
    top, deep = prior_strength(hosts).first(), prior_strength(paths, "host").first()
    mean, strong, strong_path = (top["mean"], top["strength"], deep["strength"]) if top["mean"] is not None else (0.5, 1.0, 1.0)
    sites = paths.withColumnsRenamed({"good": "path_good", "n": "path_n"}).join(hosts.withColumnsRenamed({"good": "host_good", "n": "host_n"}), "host")
    own = copies.withColumnsRenamed({"good": "own_path", "n": "own_path_n"})
    # A text that a host has once is all of its copies; only for others are the copies' sums joined.
    repeated = own.join(copies.groupBy("host", "copy").agg(F.sum("good").alias("own_host"), F.sum("n").alias("own_host_n")).where("own_host_n > 1"), ["host", "copy"])
    both = judged.join(sites, ["host", "path"]).join(repeated, ["host", "path", "copy"], "left")
    less = lambda name, other: F.coalesce(F.col(name), other)
    both = both.withColumn("host_share", (F.col("host_good") - less("own_host", F.col("good")) + strong * F.lit(mean)) / (F.col("host_n") - less("own_host_n", F.lit(1)) + strong))
    both = both.withColumn("path_share", (F.col("path_good") - less("own_path", F.col("good")) + strong_path * F.col("host_share")) / (F.col("path_n") - less("own_path_n", F.lit(1)) + strong_path))
    odds = F.col("evidence") + _odds(F.col("path_share")) - _odds(F.lit(float(mean)))
    both = both.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return both.select("doc_id", "evidence", "host_share", "path_share", "quality", (F.col("quality") >= threshold).alias("keep"))
