"""Document quality by hierarchical empirical Bayes: text evidence with host and path posteriors.

A logistic classifier on the shape of a text gives the evidence of a document.  It
is fitted on ``SAMPLE_LABELS`` labelled documents at most, those with the smallest
id hashes.  The evidence of all documents is added up by path and by host.  A host
posterior is the host's mean shrunk toward the global one, a path posterior the
path's mean shrunk toward its host's posterior, without the document at hand; how
strongly is estimated from the spread of the means (method of moments), so sparse
sites lean on their prior.  A document's quality combines the odds of its evidence
with those of its path in place of the global odds.

Sums per site are combined before any shuffle and joined back as one row per
site; a hot host is one row on that side.  Columns of a site are named by the
caller; a null host or path is a site of its own.

Null and empty texts are judged by their empty shape, very long ones by their whole
shape.  Repeated rows count repeatedly.  A document at even odds is kept; of labels
with equal id hashes the smaller id is sampled first.  Without labels of both kinds the evidence is the global share alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapwise.llm.arrow import map_batches
from lapwise.llm.rows import hash_below
from lapwise.session import cut

SAMPLE_LABELS = 20_000
RIDGE = 1.0
NEWTON_STEPS = 12
# Evidence is kept within these odds, so that no document is judged by its text alone or against any evidence.
MOST_LOG_ODDS = 12.0
# Bounds of the prior weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6
KEEP_AT = 0.5

FEATURES = (
    "upper", "digits", "symbols", "shouts", "punctuation", "spaces", "lines", "other",
    "word_length", "distinct_words", "repeated_neighbours", "distinct_lines", "log_words",
)
_KINDS = np.full(256, 7)
for _kind, _characters in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!", ".,;:?'\"()-", " ", "\n")):
    _KINDS[[ord(c) for c in _characters]] = _kind
_KINDS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 8
_KINDS[128:] = 8


def shape(text: str | None) -> list[float]:
    """The features of one text."""
    data = (text or "").encode("utf-8", "replace")
    kinds = np.zeros(9, np.int64)
    for start in range(0, len(data), 1 << 20):
        histogram = np.bincount(np.frombuffer(data, np.uint8, min(1 << 20, len(data) - start), start), minlength=256)
        np.add.at(kinds, _KINDS, histogram)
    words, lines = data.split(), [line for line in data.split(b"\n") if line.strip()]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        *(kinds[:8] / max(len(data), 1)).tolist(),
        sum(map(len, words)) / n / 10,
        len(set(words)) / math.sqrt(n) / 10,
        same / n,
        len(set(lines)) / n_lines,
        math.log1p(len(words)) / 10,
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.clip(x @ self.weights[1:] + self.weights[0], -MOST_LOG_ODDS, MOST_LOG_ODDS)


def fit(features: np.ndarray, labels: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton's method."""
    width = features.shape[1]
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Classifier(np.zeros(width), np.ones(width), np.array([math.log(share / (1 - share)), *[0.0] * width]))
    mean, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    x = np.concatenate([np.ones((len(labels), 1)), (features - mean) / scale], axis=1)
    weights, penalty = np.zeros(width + 1), RIDGE * np.eye(width + 1)
    penalty[0, 0] = 1e-6
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - penalty @ weights
        curvature = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        weights = weights + np.linalg.solve(curvature, gradient)
    return Classifier(mean, scale, weights)


def measured(docs: DataFrame, sites: tuple[Column, Column], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``host``, ``path`` and ``shape`` of every row, written once."""
    host, path = sites
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path")
    )

    def shapes(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([shape(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "host", "path")], values], ["id", "host", "path", "shape"])

    schema = f"id {dict(rows.dtypes)['id']}, host string, path string, shape array<double>"
    return cut(map_batches(rows, shapes, schema), "quality-shapes")


def train(shapes: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of a bounded sample of ``labels`` (``id``, ``good``)."""
    usable = labels.where("good IS NOT NULL").select("id", "good")
    # Labels with low hashes, a few times the sample, so that what is ordered does not grow with the labels.
    low = usable.where(hash_below(F.col("id"), F.lit(4.0 * SAMPLE_LABELS / max(usable.count(), 1))))
    labelled = shapes.select("id", "shape").join(low, "id")
    sample = labelled.orderBy(F.xxhash64("id"), "id", "good", "shape").limit(SAMPLE_LABELS).collect()
    features = np.array([r["shape"] for r in sample], float).reshape(-1, len(FEATURES))
    return fit(features, np.array([float(r["good"]) for r in sample]))


def _clipped_odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(bounded / (1 - bounded))


def _weight(groups: DataFrame, center: Column) -> float:
    """Documents that the prior weighs: the variance within against that of the means (method of moments)."""
    row = groups.where("n > 1").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - center, 2)).alias("between"),
        F.sum(F.col("n") * F.col("n")).alias("n_squares"),
    ).first()
    if not row["k"] or row["k"] < 2 or row["n"] <= row["k"]:
        return MOST_WEIGHT
    within = row["within"] / (row["n"] - row["k"])
    spread = (row["between"] - (row["k"] - 1) * within) / max(row["n"] - row["n_squares"] / row["n"], 1e-9)
    return MOST_WEIGHT if spread <= 0 else min(max(within / spread, LEAST_WEIGHT), MOST_WEIGHT)


def classify(shapes: DataFrame, classifier: Classifier) -> DataFrame:
    """``id``, ``evidence``, ``host_quality``, ``path_quality``, ``quality`` and ``kept`` of every row."""
    shared = shapes.sparkSession.sparkContext.broadcast(classifier)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        features = np.array(batch.column("shape").to_pylist(), float).reshape(-1, len(FEATURES))
        odds = shared.value.log_odds(features)
        kept = [batch.column(c) for c in ("id", "host", "path")]
        return pa.RecordBatch.from_arrays([*kept, pa.array(odds), pa.array(1 / (1 + np.exp(-odds)))], ["id", "host", "path", "odds", "p"])

    schema = f"id {dict(shapes.dtypes)['id']}, host string, path string, odds double, p double"
    judged = cut(map_batches(shapes, judge, schema), "quality-evidence")

    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")]
    paths = cut(judged.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    everything = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    overall = (everything["total"] + 1) / (everything["n"] + 2) if everything["n"] else 0.5
    host_weight = _weight(hosts, F.lit(overall))
    host_means = hosts.select("host", F.col("n").alias("host_n"), F.col("total").alias("host_total"))
    host_of_path = F.col("path_host").eqNullSafe(F.col("host"))
    sites = paths.withColumnRenamed("host", "path_host").join(host_means, host_of_path).drop("host")
    path_weight = _weight(sites, F.col("host_total") / F.col("host_n"))

    sites = sites.select("path_host", F.col("path").alias("site_path"), "n", "total", "host_n", "host_total")
    same_site = F.col("host").eqNullSafe(F.col("path_host")) & F.col("path").eqNullSafe(F.col("site_path"))
    # Without the document itself, so that its evidence counts once.
    host_quality = (F.col("host_total") - F.col("p") + host_weight * overall) / (F.col("host_n") - 1 + host_weight)
    path_quality = (F.col("total") - F.col("p") + path_weight * F.col("host_quality")) / (F.col("n") - 1 + path_weight)
    joined = judged.join(sites, same_site).withColumn("host_quality", host_quality).withColumn("path_quality", path_quality)
    total_odds = F.col("odds") + _clipped_odds(F.col("path_quality")) - _clipped_odds(F.lit(overall))
    quality = 1 / (1 + F.exp(-total_odds))
    return joined.select("id", F.col("p").alias("evidence"), "host_quality", "path_quality", quality.alias("quality")).withColumn(
        "kept", F.col("quality") >= KEEP_AT
    )


def quality_classifier(docs: DataFrame, labels: DataFrame, sites: tuple[Column, Column]) -> DataFrame:
    """Quality of every document of ``docs``, learned from ``labels`` (``id``, ``good``)."""
    shapes = measured(docs, sites)
    return classify(shapes, train(shapes, labels))
