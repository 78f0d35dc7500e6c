"""Language identification and the quality classifier against plain computations."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from lapwise.llm import language_id, quality_classifier as qc

_WRAP = (1 << 64) - 1


def _ngrams(text):
    """Numbers of the hashed n-grams of a text, as often as they occur."""
    out = []
    for start in range(0, len(text or ""), 1 << 18):
        word = []
        for c in text[start : start + (1 << 18)].lower() + " ":
            if "a" <= c <= "z" or (ord(c) > 127 and c.isalpha()):
                word.append(ord(c))
                continue
            if word:
                padded = [0, *word, 0]
                out += [(x + 1) for x in word]
                out += [a * 0x1F123BB5 + b + 2 for a, b in zip(padded, padded[1:])]
                out += [(a * 0x1F123BB5 + b) * 0x5851F42D + c3 + 3 for a, b, c3 in zip(padded, padded[1:], padded[2:])]
            word = []
    return [(n * 0x9E3779B97F4A7C15 & _WRAP) >> 52 for n in out]


def _vector(text, idf):
    counts = defaultdict(int)
    for n in _ngrams(text):
        counts[n] += 1
    weighted = {n: math.log1p(c) * idf[n] for n, c in counts.items()}
    length = math.sqrt(sum(x * x for x in weighted.values()))
    return {n: x / length for n, x in weighted.items()}


def test_language_equals_plain_cosines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    learning = docs.where("id % 3 <> 0")
    model = language_id.learn(learning)
    # inverse document frequencies cover all learning documents with a letter
    frequencies, n = defaultdict(int), 0
    for r in learning.collect():
        found = set(_ngrams(r["text"]))
        n += bool(found)
        for gram in found:
            frequencies[gram] += 1
    assert np.allclose(model.idf, [math.log((1 + n) / (1 + frequencies[i])) + 1 for i in range(language_id.DIMENSIONS)])
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    # a text is given to the centroid of the largest cosine, or to "und"
    texts = [r["text"] for r in docs.where("id % 3 = 0").collect()] + brute.ODD_TEXTS + ["é" * 300_000 + " deux mots", "ǅ ß İx 漢字 a1b"]
    found = language_id.identify(brute.documents(spark, list(enumerate(texts))), model).collect()
    rejected = 0
    for r in found:
        text = texts[r["id"]]
        if not _ngrams(text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        own = _vector(text, model.idf)
        cosines = [sum(x * float(c[i]) for i, x in own.items()) for c in model.centroids]
        best = max(cosines)
        near = [k for k, c in enumerate(cosines) if c > best - 1e-5]
        assert r["lang_pred"] in {model.languages[k] for k in near} and abs(r["score"] - min(max(best, 0), 1)) < 1e-4
        if all(abs(best - float(model.radii[k])) > 1e-4 for k in near):
            assert r["rejected"] in {best < float(model.radii[k]) for k in near}
        rejected += r["rejected"]
    assert 0 < rejected < len(texts) / 2


def test_equal_centroids_give_the_first(spark):
    """Ties between centroids: the first of the model's order, which is by language."""
    rows = [(i, "the same words", "b" if i % 2 else "a") for i in range(8)]
    model = language_id.learn(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(brute.documents(spark, [(1, "the same words")] * 3), model).collect()} == {"a"}


def _shape(text):
    data = (text or "").encode("utf-8", "replace")
    classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!", ".,;:?'\"()-", " ", "\n"]
    counts = [sum(chr(b) in c for b in data) for c in classes]
    letters = sum(b > 127 or chr(b) in "abcdefghijklmnopqrstuvwxyz" for b in data)
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    lines = [x for x in data.split(b"\n") if re.search(rb"[^ \t\r\x0b\x0c]", x)]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    return [c / max(len(data), 1) for c in [*counts, len(data) - letters - sum(counts)]] + [
        sum(map(len, words)) / n / 10, len(set(words)) / math.sqrt(n) / 10, sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / n_lines, math.log1p(len(words)) / 10,
    ]


def _odds(p):
    p = min(max(p, 1e-5), 1 - 1e-5)
    return math.log(p / (1 - p))


def _weight(groups, center):
    """Within against between variance of (values, center) groups of two and more."""
    groups = [(v, c) for v, c in zip(groups, center) if len(v) > 1]
    n, k = sum(len(v) for v, _ in groups), len(groups)
    if k < 2 or n <= k:
        return qc.MOST_WEIGHT
    within = sum(sum((x - sum(v) / len(v)) ** 2 for x in v) for v, _ in groups) / (n - k)
    between = sum(len(v) * (sum(v) / len(v) - c) ** 2 for v, c in groups)
    spread = (between - (k - 1) * within) / max(n - sum(len(v) ** 2 for v, _ in groups) / n, 1e-9)
    return qc.MOST_WEIGHT if spread <= 0 else min(max(within / spread, qc.LEAST_WEIGHT), qc.MOST_WEIGHT)


def _plain(rows, labels):
    """(evidence, host, path, quality) of (id, text, host, path) rows with unique ids."""
    shapes = {r[0]: _shape(r[1]) for r in rows}
    fitted = qc.fit(np.array([shapes[i] for i in labels]), np.array([float(g) for g in labels.values()]))
    odds = {i: float(fitted.log_odds(np.array([s]))[0]) for i, s in shapes.items()}
    p = {i: 1 / (1 + math.exp(-o)) for i, o in odds.items()}
    hosts, paths = defaultdict(list), defaultdict(list)
    for i, _, host, path in rows:
        hosts[host].append(p[i])
        paths[host, path].append(p[i])
    overall = (sum(p.values()) + 1) / (len(p) + 2)
    host_weight = _weight(hosts.values(), [overall] * len(hosts))
    path_weight = _weight(paths.values(), [sum(hosts[h]) / len(hosts[h]) for h, _ in paths])
    out = {}
    for i, _, host, path in rows:
        h = (sum(hosts[host]) - p[i] + host_weight * overall) / (len(hosts[host]) - 1 + host_weight)
        own = paths[host, path]
        q = (sum(own) - p[i] + path_weight * h) / (len(own) - 1 + path_weight)
        out[i] = (p[i], h, q, 1 / (1 + math.exp(-(odds[i] + _odds(q) - _odds(overall)))))
    return out


def _judged(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    given = spark.createDataFrame(list(labels.items()), "id long, good int")
    return qc.quality_classifier(docs, given, (F.col("host"), F.col("path"))).collect()


def _agrees(found, expected):
    for r in found:
        assert (r["evidence"], r["host_quality"], r["path_quality"], r["quality"]) == pytest.approx(expected[r["id"]], abs=1e-6)
        assert r["kept"] == (r["quality"] >= 0.5)
    assert len(found) == len(expected)


def test_quality_equals_the_plain_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang").collect()
    labels = {r["doc_id"]: int(r["quality"] > 0) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [tuple(r) for r in docs] + [(10**6 + i, t, None, "odd") for i, t in enumerate(brute.ODD_TEXTS + ["long words " * 200_000])]
    _agrees(_judged(spark, rows, labels), _plain(rows, labels))


def test_the_fit_is_the_optimum():
    """The gradient of the penalised likelihood is zero, which holds at one point only."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 2, 0.1, 30, 1] + [0, 1, 5, -9, 0]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1])))).astype(float)
    fitted = qc.fit(x, y)
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    residual = y - 1 / (1 + np.exp(-(scaled @ fitted.weights[1:] + fitted.weights[0])))
    assert np.allclose(scaled.T @ residual, qc.RIDGE * fitted.weights[1:], atol=1e-6) and abs(residual.sum()) < 1e-4


def test_site_posteriors_decide_where_the_text_does_not(spark):
    """One text, labelled good as often as bad: kept on a host of good documents, dropped on one of bad ones."""
    rng = random.Random(2)
    good, bad = "plain words stand here and there. " * 12, "### $$$ %%% !!! *** " * 12
    between = "plain words ### stand here !!! and there *** " * 12
    rows = [(i, between if i % 10 == 0 else good, "good.example", f"p{i % 3}") for i in range(200)]
    rows += [(1000 + i, between if i % 10 == 0 else bad, "bad.example", f"p{i % 3}") for i in range(200)]
    rows += [(2000 + i, between, f"single{i}.example", None) for i in range(3)]
    labels = {i: int(t == good) if t != between else rng.randint(0, 1) for i, t, _, _ in rows}
    found, expected = _judged(spark, rows, labels), _plain(rows, labels)
    _agrees(found, expected)
    kept = {r["id"]: r["kept"] for r in found}
    assert all(kept[i] for i in range(0, 200, 10)) and not any(kept[1000 + i] for i in range(0, 200, 10))
    alone = {r["id"]: r["evidence"] >= 0.5 for r in found}
    assert sum(kept[i] != alone[i] for i in kept) >= 20
