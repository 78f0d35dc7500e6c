"""Language identification by the nearest of several centroids per language.

A text is a vector of its letter n-grams (one to three letters of a word with its
edges, hashed to ``DIMENSIONS``), with logarithmic frequencies times the inverse
document frequency, scaled to length one.  Document frequencies cover all
learning documents.  Centroids come from spherical k-means on a sample of each
language, the ``SAMPLE_PER_LANGUAGE`` documents with the smallest id hashes; a
prediction is the language of the centroid with the largest cosine.  A centroid
also has a radius, the cosine that all but ``REJECTED_SHARE`` of its sample
reach: a text outside the radius of its centroid is marked as rejected.

Only text and language of the learning documents are used.  A null text or one
without a letter is ``und`` with score 0, and so is every text when there is
nothing to learn from.  Documents are predicted one by one, so repeated rows need
no care; they count repeatedly when learning.  Of centroids with equal cosines the
first by language counts.  A very long text is counted whole, in pieces of 2^18
characters; a word that a piece ends in counts as two.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapwise.llm.arrow import map_batches
from lapwise.llm.rows import hash_below, packed
from lapwise.session import cut

DIMENSIONS = 4_096
SAMPLE_PER_LANGUAGE = 800
CENTROIDS_PER_LANGUAGE = 4
KMEANS_ROUNDS = 8
MOST_BROADCAST_LANGUAGES = 10_000
REJECTED_SHARE = 0.005
UNKNOWN = "und"
# Letters that are looked at together; longer texts are counted piece by piece.
_PIECE = 1 << 18


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, with every run of other characters than letters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    small = points < 128
    letter = np.where(small, (points >= 97) & (points <= 122), True)
    if not small.all():
        other = points[~small]
        kinds, at = np.unique(other, return_inverse=True)
        letter[~small] = np.array([chr(k).isalpha() for k in kinds])[at]
    marked = np.where(letter, points, 0)
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] > 0) | (marked[:-1] > 0)
    return marked[keep]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams; None without a letter."""
    total = np.zeros(DIMENSIONS, np.int64)
    if not text:
        return None
    for start in range(0, len(text), _PIECE):
        points = np.concatenate([[0], _letters(text[start : start + _PIECE]), [0]]).astype(np.uint64)
        one, two, three = points, points[:-1] * np.uint64(0x1F123BB5) + points[1:], None
        three = two[:-1] * np.uint64(0x5851F42D) + points[2:]
        for number, grams in enumerate((one[one > 0], two[(points[:-1] > 0) | (points[1:] > 0)], three[points[1:-1] > 0])):
            mixed = (grams + np.uint64(number + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
            total += np.bincount(mixed.astype(np.int64), minlength=DIMENSIONS)
    return total if total.any() else None


def vector(total: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(total) * idf
    length = np.linalg.norm(weighted)
    return (weighted / length if length else weighted).astype(np.float32)


@dataclass
class Model:
    """Inverse document frequencies, and languages, unit centroids and radii row by row."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        total = counts(text)
        if total is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ vector(total, self.idf)
        best = int(cosines.argmax())
        score = float(min(max(cosines[best], 0.0), 1.0))
        return self.languages[best], score, bool(cosines[best] < self.radii[best])


def _document_frequencies(learning: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that contain each hashed n-gram, and all documents; one row per dimension reaches the driver."""

    def partial(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [c for t in batch.column("text").to_pylist() if (c := counts(t)) is not None]
        present = np.zeros(DIMENSIONS + 1, np.int64)
        for total in found:
            present[:-1] += total > 0
        present[-1] = len(found)
        at = np.nonzero(present)[0]
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(present[at])], ["dimension", "n"])

    summed = map_batches(learning.select("text"), partial, "dimension long, n long").groupBy("dimension").agg(F.sum("n").alias("n"))
    frequencies = np.zeros(DIMENSIONS + 1, np.int64)
    for row in summed.collect():
        frequencies[row["dimension"]] = row["n"]
    return frequencies[:-1], int(frequencies[-1])


def _clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and radii by spherical k-means, started at the vectors farthest from each other."""
    chosen = [int((vectors @ vectors.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        nearest = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(nearest.argmin()))
    centroids = vectors[chosen]
    for _ in range(KMEANS_ROUNDS):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        means = np.stack([vectors[nearest == c].mean(axis=0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    cosines = vectors @ centroids.T
    nearest = cosines.argmax(axis=1)
    radii = [float(np.quantile(own, REJECTED_SHARE)) if len(own := cosines[nearest == c, c]) else 1.0 for c in range(len(centroids))]
    return centroids.astype(np.float32), np.array(radii, np.float32)


def learn(learning: DataFrame) -> Model:
    """The model of documents (``id``, ``text``, ``lang``).

    What reaches the driver is one row per dimension and a few centroids per language.
    """
    frequencies, n = _document_frequencies(learning)
    idf = np.log((1 + n) / (1 + frequencies)) + 1
    # Documents with low hashes, a few times the sample, so that what meets does not grow with the corpus.
    usable = learning.select("lang", "id", "text").where("text IS NOT NULL")
    share = cut(
        usable.groupBy("lang").agg((F.lit(4.0 * SAMPLE_PER_LANGUAGE) / F.count(F.lit(1))).alias("share")), "language-shares"
    )
    # One row per language: with more of them than there are languages the texts are joined by a shuffle.
    shares = F.broadcast(share) if share.count() <= MOST_BROADCAST_LANGUAGES else share
    low = usable.join(shares, "lang").where(hash_below(F.col("id"), F.col("share")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    numbered = low.withColumn("rank", F.row_number().over(order))
    sample = cut(numbered.where(F.col("rank") <= F.lit(SAMPLE_PER_LANGUAGE)).select("lang", "text"), "language-sample")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, c) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()) if (c := counts(t)) is not None]
        values = [vector(c, idf).tolist() for _, c in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, _ in found], pa.string()), pa.array(values, pa.list_(pa.float32()))], ["lang", "vector"]
        )

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        centroids, radii = _clusters(np.stack(group["vector"].to_numpy()).astype(np.float32), CENTROIDS_PER_LANGUAGE)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centroid": list(centroids.tolist()), "radius": radii})

    clustered = (
        map_batches(sample, vectors, "lang string, vector array<float>")
        .groupBy("lang")
        .applyInPandas(cluster, "lang string, centroid array<float>, radius float")
        .collect()
    )
    clustered.sort(key=lambda r: (r["lang"], r["centroid"]))
    centroids = np.array([r["centroid"] for r in clustered], np.float32).reshape(-1, DIMENSIONS)
    return Model(idf, [r["lang"] for r in clustered], centroids, np.array([r["radius"] for r in clustered], np.float32))


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (cosine) and ``rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs).selectExpr(f"row.`{id_column}` AS id", f"row.`{text_column}` AS text")

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        languages, scores, rejected = zip(*map(shared.value.predict, batch.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(languages), pa.array(scores, pa.float64()), pa.array(rejected)],
            ["id", "lang_pred", "score", "rejected"],
        )

    return map_batches(rows, predict, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, rejected boolean")
