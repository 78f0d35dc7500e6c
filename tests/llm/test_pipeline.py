"""The pipeline against plain versions of its stages, and on odd tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from lapwise.llm import quality_rules
from lapwise.session import cut
from test_near_copies import _kept as without_near_copies


def _expected(spark, sf_dir):
    """(doc_id, ids) of the documents that plain versions of the stages leave."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    # quality: votes from plain counts, the model from their patterns
    measures = {i: brute.quality_metrics(t) for i, t in docs.items()}
    table = spark.createDataFrame([(i, m) for i, m in measures.items()], "doc_id long, m struct<" + ",".join(f"{k}:bigint" for k in quality_rules.METRICS) + ">")
    votes = {r["doc_id"]: tuple(r["v"]) for r in table.select("doc_id", F.array(*[x.vote() for x in quality_rules.rules()]).alias("v")).collect()}
    patterns = {}
    for v in votes.values():
        patterns[v] = patterns.get(v, 0) + 1
    model = quality_rules.estimate(sorted(patterns.items()), len(quality_rules.rules()))
    good = lambda m: m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]
    docs = {i: t for i, t in docs.items() if good(measures[i]) and model.posterior(votes[i]) >= 0.5}
    # runs of lines that any earlier place has
    lines = brute.line_dedup(docs.items())
    docs = {i: kept for i, (kept, n, gone) in lines.items() if n == 0 or gone < n}
    # near copies: five-word shingles, similarity of 0.8 or more
    docs = {i: docs[i] for i in without_near_copies(docs.items())}
    # benchmark
    docs = {i: t for i, t in docs.items() if brute.decontaminated(t, items)[1] == 0}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    return sorted((i, library.encode(t, add_special_tokens=False).ids) for i, t in docs.items())


def test_pipeline(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == _expected(spark, sf_dir)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in found)


@pytest.mark.parametrize("make", [brute.odd_documents, lambda spark: brute.documents(spark, [])])
def test_stages_on_odd_tables(spark, sf_dir, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.count() <= docs.count()
        if name != "bpe":
            assert out.dtypes == docs.dtypes


def test_n_chars_follows_the_text(spark, sf_dir):
    out = corpus_pipeline.new_lines(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert out.where(F.length("text") != F.col("n_chars")).isEmpty()
