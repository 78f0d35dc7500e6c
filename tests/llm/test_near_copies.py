"""Near copies against all pairs of texts."""

import random

import numpy as np
import pytest

import brute
import corpus_pipeline
from lapwise.llm import golay, near_copies


def _sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def _kept(rows):
    """Smallest id of each group of (id, text) rows with unique ids."""
    rows = sorted(rows)
    sets, label = _sets(t for _, t in rows), list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sorted(rows[x][0] for x in set(label))


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block_shingles", [near_copies.BLOCK_SHINGLES, 500])
def test_near_copies(spark, block_shingles):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([60, 200, 700]))]
        texts += [" ".join(_edited(rng, base, len(base) * k // 100)) for k in (0, 1, 1, 2, 2, 3, 4, 6)]
        # a chain, whose ends need not be similar
        for _ in range(6):
            base = _edited(rng, base, len(base) // 60)
            texts.append(" ".join(base))
    rows = list(enumerate(texts + [f"short {i % 3}" for i in range(6)]))
    rng.shuffle(rows)
    found = near_copies.one_of_each(brute.documents(spark, rows).repartition(3), block_shingles=block_shingles)
    assert sorted(r["doc_id"] for r in found.collect()) == _kept(rows)


def test_near_copies_of_odd_rows(spark):
    docs = brute.odd_documents(spark)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and not {1, 2, 12} & set(ids) and {11, 50, None} <= set(ids)
    assert near_copies.one_of_each(brute.documents(spark, [])).count() == 0


def test_stage_drops_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.distinct_documents(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == _kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_similar_sets_share_an_index_and_are_near():
    rng = np.random.default_rng(3)
    pairs = []
    for size in [4, 5, 8, 9, 20, 60, 300, 1000] * 25:
        # the least similarity that is linked, by edits of equal sets and by a part of a set
        shared = rng.integers(0, 2**64, size, dtype=np.uint64)
        for more in ((size // 8, size // 8), (size // 4, 0)):
            a, b = (np.concatenate([shared, rng.integers(0, 2**64, n, dtype=np.uint64)]) for n in more)
            pairs.append((near_copies.margins(a), near_copies.margins(b)))
    a, b = (np.array(side) for side in zip(*pairs))
    words = (near_copies.fingerprints(side) for side in (a, b))
    assert (np.bitwise_count(np.bitwise_xor(*words)).sum(axis=1) <= near_copies.DIFFERING_BITS).all()
    assert (near_copies.keys(a) == near_copies.keys(b)).any(axis=1).all()
    # texts that have nothing in common are not near
    strangers = near_copies.fingerprints(np.array([near_copies.margins(rng.integers(0, 2**64, 200, dtype=np.uint64)) for _ in range(300)]))
    assert not len(near_copies.near_pairs(strangers)[0])


def test_bits_are_counted():
    words = np.random.default_rng(5).integers(0, 2**64, (1001, 2), dtype=np.uint64)
    for n in (0, 1, 2, 3, 7, 1001):
        plain = [sum(int(w) >> bit & 1 for w in words[:n, column]) for column in range(2) for bit in range(64)]
        assert near_copies._bit_counts(words[:n]).tolist() == plain


def test_margins_choose_the_index():
    rng = np.random.default_rng(7)
    codes = golay._SIGNS[rng.integers(0, 4096, 500)].astype(np.int64)
    # three bits that are wrong, and a fourth with a small margin
    wrong = np.argsort(rng.random(codes.shape), axis=1)[:, :4]
    margins = 50 * codes
    np.put_along_axis(margins, wrong, -np.take_along_axis(codes, wrong, axis=1), axis=1)
    assert (golay._SIGNS[golay.weighted_index(margins)] == codes).all()


@pytest.mark.parametrize("block_nodes", [near_copies.BLOCK_NODES, 3])
def test_prints_are_linked_over_blocks(spark, block_nodes):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    found = np.array([near_copies.margins(np.concatenate([base[k:], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(20)])
    rows = [(p.view(np.int64).tolist(), k.tolist()) for p, k in zip(near_copies.fingerprints(found), near_copies.keys(found))]
    prints = spark.createDataFrame(rows, "print array<long>, keys array<int>")
    clusters = near_copies._clusters(prints, block_nodes).collect()
    assert len(clusters) == 20 and len({r["cluster"] for r in clusters}) == 1
