"""Nearest neighbours against all pairs of vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapwise.llm import nearest
from lapwise.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, k1 string, vector string, ids string, score string, rank string, row string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d", "e", "f") for i, v in rows], SCHEMA)


def _exact(ids, vectors, is_query, k=5):
    """(rank, id, cosine) of the k nearest of every query, ties by id."""
    ids, vectors = np.array(ids), np.array(vectors, np.float32).astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for q in np.nonzero(is_query(ids))[0]:
        cosines = vectors @ vectors[q] / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -np.round(cosines, 12))) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(rank, int(ids[i]), float(cosines[i])) for rank, i in enumerate(order, 1)]
    return out


def _found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def _recall(found, exact):
    assert found.keys() == exact.keys()
    for q, rows in found.items():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(exact[q])
        assert all(math.isclose(a[2], b[2], abs_tol=1e-12) or a[2] < b[2] for a, b in zip(rows, exact[q]))
    hits = sum(len({r[1] for r in found[q]} & {r[1] for r in exact[q]}) for q in exact)
    return hits / sum(map(len, exact.values()))


@pytest.mark.parametrize("shard_rows", [nearest.SHARD_ROWS, 150])
def test_recall(spark, shard_rows):
    """Clustered vectors, a third of them copies of one."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 900)] + 0.3 * rng.normal(size=(900, 16))
    vectors[rng.permutation(900)[:300]] = vectors[0]
    rows = [(i * 10, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    found = _found(nearest.nearest_neighbours(_table(spark, rows), F.col("vec_id") % 50 == 0, shard_rows=shard_rows, cell_queries=40))
    exact = _exact([i for i, _ in rows], [v for _, v in rows], lambda ids: ids % 50 == 0)
    assert _recall(found, exact) >= 0.95
    # all copies of the hot vector are found, by ascending id
    copies = sorted(i for i, v in rows if v == rows[0][1])
    hot = [q for q in exact if q in copies]
    assert all([r[1] for r in found[q]] == [c for c in copies if c != q][:5] for q in hot)


def test_query_against_all_pairs(spark, sf_dir):
    found = _found(QUERIES["op12_nearest"](spark, sf_dir))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    exact = _exact([i for i, _ in rows], [v for _, v in rows], lambda ids: ids % 50 == 0)
    assert _recall(found, exact) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]),  # a repeated row and a repeated id with another vector
        (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [-1.0, 0.0]), (4, [1e-30, 1e-30]), (50, [1e30, 1e30]),
        (5, None), (6, []), (7, [0.0, 0.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 0.0]),
        (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (150, [0.0, 0.0]), (200, [4.0]),
    ]
    found = _found(nearest.nearest_neighbours(_table(spark, rows), F.col("vec_id") % 50 == 0))
    assert set(found) == {0, 50, 100}  # 200 has nothing to be compared with
    half = math.sqrt(0.5)
    # 1 and 2 tie exactly; the others point the same way up to rounding
    order = [i for _, i, _ in found[0]]
    assert [r for r, _, _ in found[0]] == [1, 2, 3, 4, 5] and set(order[:4]) == {1, 2, 4, 50} and order[4] == 3
    assert order.index(1) < order.index(2)
    assert all(math.isclose(s, e, abs_tol=1e-6) for (_, _, s), e in zip(found[0], [half] * 4 + [0.0]))
    assert {i for _, i, _ in found[50]} == {0, 1, 2, 3, 4} and found[50][-1][1] == 3
    assert [(r, i) for r, i, _ in found[100]] == [(1, 101)] and math.isclose(found[100][0][2], 1.0)
    assert nearest.nearest_neighbours(_table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_an_index_is_searched_after_it_was_written(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    distinct, _ = nearest.nodes(_table(spark, rows), 6)
    nearest.build(distinct, 100).write.parquet(f"{tmp_path}/index")
    index = spark.read.schema(nearest.INDEX).parquet(f"{tmp_path}/index")
    assert index.count() >= 2 and index.agg(F.sum(F.octet_length("ids"))).head()[0] == 8 * 300
    links = index.select((F.octet_length("lowest") / F.octet_length("ids")).alias("share")).distinct().collect()
    assert [r["share"] for r in links] == [2 * nearest.LINKS * 4 / 8]
    found = nearest.search(index, distinct.select(*nearest.NODE, "vector"), 1)
    best = found.where(F.array_contains("ids", F.lit(17))).agg(F.max("score")).head()[0]
    assert math.isclose(best, 1.0, abs_tol=1e-12)
