"""Operators that judge or search texts one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from lapwise.llm import decontamination, language_id, licenses, quality_classifier, quality_rules


def test_quality_metrics(spark, sf_dir):
    docs = brute.odd_documents(spark).select("text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    found = docs.select("text", quality_rules.metrics(F.coalesce("text", F.lit(""))).alias("m")).collect()
    for r in found:
        assert r["m"].asDict() == brute.quality_metrics(r["text"])


def test_quality_posteriors(spark, sf_dir):
    votes = quality_rules.voted(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_rows=False)
    model = quality_rules.fit(votes)
    judged = quality_rules.judged(votes, model)
    both = judged.join(votes.select(F.col("row.doc_id").alias("doc_id"), "votes"), F.col("row.doc_id") == F.col("doc_id"))
    for r in both.collect():
        assert math.isclose(r["quality"], model.posterior(r["votes"]), rel_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    wrong = judged.where("NOT base_failed").select("row.doc_id", "kept").join(labels, "doc_id").where("kept <> (label = 1)")
    assert wrong.count() == 0


def test_estimation_finds_the_better_rules():
    rng = random.Random(5)
    accuracies = [(0.999, 0.8), (0.999, 0.6), (0.998, 0.4)]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a[0]) else -1) if good else (-1 if rng.random() < a[1] else 1) for a in accuracies)
        counts[votes] = counts.get(votes, 0) + 1
    model = quality_rules.estimate(sorted(counts.items()), 3)
    assert abs(model.good - 0.8) < 0.05
    assert model.on_bad[0] > model.on_bad[1] > model.on_bad[2]
    assert quality_rules.estimate([], 3).good == pytest.approx(0.85)


def _planted(accuracies, n=30_000, share=0.75):
    """Votes of independent rules on documents that are known to be good or bad: (votes, good) with counts."""
    rng, counts = random.Random(7), {}
    for _ in range(n):
        good = rng.random() < share
        votes = tuple(
            0 if rng.random() < 0.1 else (1 if rng.random() < a else -1) if good else (-1 if rng.random() < b else 1) for a, b in accuracies
        )
        counts[votes, good] = counts.get((votes, good), 0) + 1
    return counts


def test_estimated_accuracies_decide_and_not_single_votes():
    """Weak rules vote bad on a fifth of the good documents: the estimation finds that out and outvotes them."""
    accuracies = [(0.8, 0.55), (0.78, 0.6), (0.97, 0.7), (0.99, 0.8), (0.95, 0.65)]
    counts = _planted(accuracies)
    patterns = {}
    for (votes, _), n in counts.items():
        patterns[votes] = patterns.get(votes, 0) + n
    model = quality_rules.estimate(sorted(patterns.items()), len(accuracies))
    assert abs(model.good - 0.75) < 0.05
    for (on_good, on_bad), found_good, found_bad in zip(accuracies, model.on_good, model.on_bad):
        assert abs(on_good - found_good) < 0.05 and abs(on_bad - found_bad) < 0.05
    kept = {v: model.posterior(v) >= 0.5 for v in patterns}
    all_pass = {v: min(v) >= 0 for v in patterns}
    right = lambda verdict: sum(n for (v, good), n in counts.items() if verdict[v] == good) / sum(counts.values())
    assert sum(n for v, n in patterns.items() if kept[v] != all_pass[v]) > 5_000
    assert right(kept) > 0.9 > 0.8 > right(all_pass)


def test_start_values_do_not_decide():
    counts = {}
    for (votes, _), n in _planted([(0.9, 0.6), (0.95, 0.7), (0.97, 0.5), (0.85, 0.8)]).items():
        counts[votes] = counts.get(votes, 0) + n
    models = []
    for start in ((0.85, 0.95, 0.3), (0.7, 0.8, 0.5), (0.9, 0.9, 0.6)):
        with pytest.MonkeyPatch.context() as patch:
            for name, value in zip(("START_GOOD", "START_ON_GOOD", "START_ON_BAD"), start):
                patch.setattr(quality_rules, name, value)
            models.append(quality_rules.estimate(sorted(counts.items()), 4, iterations=400))
    for m in models[1:]:
        assert abs(m.good - models[0].good) < 0.01
        assert all(abs(a - b) < 0.01 for a, b in zip((*m.on_good, *m.on_bad), (*models[0].on_good, *models[0].on_bad)))


def test_quality_of_odd_rows(spark):
    judged = quality_rules.quality_rules(brute.odd_documents(spark), keep_rows=True)
    assert judged.count() == 18 and judged.where("m.n_words = 0 AND kept").isEmpty()
    assert judged.select("row.*").columns == brute.odd_documents(spark).columns
    assert quality_rules.quality_rules(brute.documents(spark, [])).count() == 0


def _places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == list(phrase)]


def _notices(text, templates):
    """(label, base, start, words, share) of all places where a key phrase stands."""
    words, expected = brute.ascii_words(text), []
    for t in templates:
        for p in _places(words, t.key):
            start = p - t.key_start
            share = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(t.words)) / len(t.words)
            if share >= licenses.LEAST_SHARE:
                expected.append((t.label, t.base, start, len(t.words), round(share, 6)))
    return sorted(expected)


def _scanned(spark, texts, templates):
    found = licenses.scan_licenses(brute.documents(spark, list(enumerate(texts))), templates=templates).collect()
    return {r["id"]: (r["n_words"], sorted(tuple(f) for f in r["found"])) for r in found}


def test_licenses(spark):
    whole = {t.label: " ".join(t.words) for t in licenses.TEMPLATES if t.label.endswith("-text")}
    texts = brute.ODD_TEXTS + [
        "CC-BY cc by CC. BY", "GNU General Public License, general public license", "All rights reserved all RIGHTS reserved.",
        "Licensed under the Apache License, Version 2.0.", "the Apache License of others", "released under the MIT license",
        "license apache", "worK is licensed CC BY-NC 4.0 under", "Licensed under CC BY-NC 4.0.", "by nc 4 0",
        whole["mit-text"].title(), f"a {whole['isc-text']} b {whole['mit-text'][200:]}", whole["isc-text"][300:],
    ]
    found = _scanned(spark, texts, licenses.TEMPLATES)
    for i, text in enumerate(texts):
        assert found[i] == (len(brute.ascii_words(text)), _notices(text, licenses.TEMPLATES))
    assert {f[0] for f in found[len(texts) - 3][1]} == {"mit", "mit-text"}
    assert licenses.scan_licenses(brute.documents(spark, [])).count() == 0
    assert licenses.scan_licenses(brute.odd_documents(spark)).count() == 18


def test_many_templates_leave_the_plan_as_it_is(spark, sf_dir):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 60)}"
    made = []
    for n in range(400):
        words = [word() for _ in range(rng.randint(1, 9))]
        key = words[rng.randint(0, len(words) - 1) :]
        made.append(licenses._template(f"t{n}", " ".join(words), " ".join(key)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(30)] + [" ".join(t.words) for t in made[:30]]
    found = _scanned(spark, texts, made)
    assert [found[i][1] for i in range(len(texts))] == [_notices(t, made) for t in texts]
    docs = brute.documents(spark, [(1, "a")])
    plans = [licenses.scan_licenses(docs, templates=some)._jdf.queryExecution().analyzed().toString() for some in (made[:5], made)]
    steps = [plan.count("lambdafunction(") for plan in plans]
    assert steps[0] == steps[1] > 0


def test_postings_hold_the_rarest_words():
    index = licenses.postings(dict.fromkeys((w for t in licenses.TEMPLATES for w in t.key), 9) | {"license": 5, "gnu": 1})
    gnu = next(n for n, t in enumerate(licenses.TEMPLATES) if t.label == "gnu-gpl")
    assert sorted((p["rank"], w) for w, found in index.items() for p in found if p["template"] == gnu) == [(0, "gnu"), (1, "license")]


@pytest.mark.parametrize("block_windows", [200_000, 5])
def test_decontamination(spark, block_windows):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "dd", "É"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([12, 11, 10, 9, 4, 3, 2, 1, 0])]
    items += [(20, "zz"), (20, "yy yy"), (None, "ww vv"), (21, None), (10, items[0][1])]
    texts = brute.ODD_TEXTS + [", ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(20)]
    texts += [f"{items[0][1]} ZZ {items[1][1]}", "Ww-vv", f"{items[1][1]} {items[1][1]}"]
    docs = brute.documents(spark, list(enumerate(texts)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    tests = decontamination.Benchmark(benchmark)
    found = decontamination.decontaminate(docs, tests, block_windows=block_windows)
    items_of = {tuple(r["numbers"]): r["items"] for r in decontamination.found_items(found, tests).collect()} | {(): []}
    found = found.collect()
    named = [("" if i is None else i, t) for i, t in items]
    for r in found:
        n_words, n_hit, ids = brute.decontaminated(r["row"]["text"], named)
        hit = sum(h["last"] - h["first"] + 1 for h in r["hits"])
        assert (r["n_words"], hit, items_of[tuple(r["numbers"])]) == (n_words, n_hit, ids)
    assert len(found) == len(texts)


def test_decontamination_in_blocks_of_rows_without_clear_ids(spark):
    window = "a b c d e f g h i j"
    rows = [(1, window), (1, window), (1, "clean " * 3), (None, f"x {window}"), (None, "x"), (None, None), (2, f"{window} k {window}")]
    benchmark = spark.createDataFrame([(i, window) for i in range(300)] + [(300, "k a"), (301, "zz")], "item_id bigint, text string")
    found = decontamination.decontaminate(brute.documents(spark, rows), benchmark, block_windows=1)
    hits = [(r["row"]["doc_id"], r["row"]["text"], [tuple(h) for h in r["hits"]], len(r["numbers"])) for r in found.collect()]
    expected = [(1, window, [(0, 9)], 1)] * 2 + [(1, "clean " * 3, [], 0), (None, f"x {window}", [(1, 10)], 1), (None, "x", [], 0), (None, None, [], 0)]
    assert sorted(hits, key=str) == sorted(expected + [(2, f"{window} k {window}", [(0, 20)], 2)], key=str)


def test_decontamination_of_odd_tables(spark):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    found = decontamination.decontaminate(brute.odd_documents(spark), nothing)
    assert found.count() == 18 and found.where(F.size("hits") > 0).isEmpty()
    assert found.select("row.*").columns == brute.odd_documents(spark).columns
    one = spark.createDataFrame([(1, "word word word")], "item_id bigint, text string")
    assert decontamination.decontaminate(brute.documents(spark, []), one).count() == 0
    long = decontamination.decontaminate(brute.odd_documents(spark), one).where("row.doc_id = 50").head()
    assert [tuple(h) for h in long["hits"]] == [(0, 59_999)]


def test_language_by_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = docs.where("doc_id % 3 = 0")
    model = language_id.learn(docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "text", "lang"))
    assert max(model.languages.count(x) for x in set(model.languages)) > 1
    predicted = language_id.identify(held_out, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    n, right, low, high = predicted.agg(
        F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")
    ).head()
    assert right / n >= 0.97 and 0 <= low and high <= 1
    odd = {(r["id"], r["lang_pred"]): r for r in language_id.identify(brute.odd_documents(spark), model).collect()}
    assert all((i, "und") in odd for i in (0, 1, 2, 3)) and odd[(None, "und")]["score"] == 0
    strange = brute.documents(spark, [(1, "qzx wvk jjx qqk zzzk xxq kkqz"), (2, "и это другой язык")])
    assert [r["rejected"] for r in language_id.identify(strange, model).orderBy("id").collect()] == [True, True]


def test_language_without_anything_to_learn(spark):
    model = language_id.learn(spark.createDataFrame([], "id bigint, text string, lang string"))
    found = language_id.identify(brute.odd_documents(spark), model).collect()
    assert len(found) == 18 and {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}


def test_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    judged = quality_classifier.quality_classifier(docs, labels, (F.col("source"), F.col("lang")))
    assert judged.count() == docs.count()
    wrong = judged.join(labels, "id").where("kept <> (good = 1)").count()
    assert wrong / labels.count() <= 0.02


def test_sparse_sites_lean_on_their_priors(spark):
    """A host of bad documents lowers the prior of its documents; a host of one is judged as the corpus is."""
    good, bad = "plain words stand here and there. " * 12, "### $$$ %%% !!! *** " * 12
    rows = [(i, good if i % 10 else bad, "good.example") for i in range(200)]
    rows += [(1000 + i, bad, "bad.example") for i in range(100)] + [(2000, good, "single.example")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("p", F.lit(None).cast("string"))
    labels = docs.select(F.col("doc_id").alias("id"), (F.col("text") == good).cast("int").alias("good")).where("id % 2 = 0")
    judged = quality_classifier.quality_classifier(docs, labels, (F.col("source"), F.col("p"))).collect()
    prior = {r["id"]: r["host_quality"] for r in judged}
    overall = sum(r["evidence"] for r in judged) / len(judged)
    assert prior[1000] < 0.1 < 0.8 < prior[1] and abs(prior[2000] - overall) < 0.1


def test_quality_classifier_of_odd_tables(spark):
    site = (F.col("source"), F.lit(None))
    no_labels = spark.createDataFrame([], "id bigint, good int")
    odd = quality_classifier.quality_classifier(brute.odd_documents(spark), no_labels, site).collect()
    assert len(odd) == 18 and len({round(r["evidence"], 9) for r in odd}) == 1
    assert quality_classifier.quality_classifier(brute.documents(spark, []), no_labels, site).count() == 0
