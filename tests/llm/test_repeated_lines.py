"""The pipeline's line stage: every earlier place counts, and long passages of few lines."""

import brute
import corpus_pipeline


def test_every_earlier_place_counts(spark, sf_dir):
    rows = []
    for n in range(20):  # whichever of the grams is chosen, some of these runs begin with it
        x, y, z, w = (f"{c} {n}" for c in "xyzw")
        rows += [(5 * n, f"{x}\n{y}\n{w}"), (5 * n + 1, f"{w}\n{y}\n{z}"), (5 * n + 2, f"{x}\n{y}\n{z}"), (5 * n + 3, f"{x}\n{y}\n{z}")]
    out = corpus_pipeline.new_lines(spark, brute.documents(spark, rows), sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i, _ in rows if i % 5 < 3]


def test_long_passages_of_few_lines(spark, sf_dir):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, words("a", 50)), (2, "own line\n" + words("a", 50)), (3, words("b", 25) + "\n\n" + words("c", 25))]
    rows += [(4, words("b", 25) + "\n" + words("c", 25) + "\nlast"), (5, words("d", 49) + "\nfirst"), (6, words("d", 49) + "\nsecond")]
    out = corpus_pipeline.new_lines(spark, brute.documents(spark, rows), sf_dir)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept == dict(rows) | {2: "own line", 4: "last"}


def test_lines_of_odd_keys(spark, sf_dir):
    passage = "l1\nl2\nl3"
    rows = [(7, passage), (7, passage), (7, "other\n" + passage), (None, passage), (None, "own\n" + passage), (9, None)]
    out = corpus_pipeline.new_lines(spark, brute.documents(spark, rows), sf_dir)
    # Null ids come first, in the order of their texts' hashes, so one of the two null rows keeps the passage.
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect())
    nulls = [t for i, t in texts if i == "None"]
    assert nulls in ([passage, "own"], ["own\n" + passage]) and [t for i, t in texts if i != "None"] == ["other", ""]
    assert corpus_pipeline.new_lines(spark, brute.documents(spark, []), sf_dir).count() == 0
