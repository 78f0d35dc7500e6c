"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors are one node, which keeps the smallest ids that have it, so copies
in any number neither crowd a graph nor are lost from the results.  Nodes are
dealt to shards of ``SHARD_ROWS`` by a hash of the vector.  The graph of a shard
is a row of flat arrays: vectors, the links of the lowest layer (a fixed number
of places a node), the links of the upper layers one after another, and where
they start.  It can be written and searched again (:func:`build`, :func:`search`).

Every query vector is searched in every shard: a graph is sent to a task with a
bounded part of the queries behind it, and loaded once for them.  Similarities are
cosines of the original vectors in double precision; the graph itself is walked
with single-precision unit vectors.

Vectors that are null, empty or zero, or hold null or non-finite parts, and rows
without id take no part.  Vectors of other lengths are never compared.  Repeated
rows count once; of an id with several vectors the best counts, for queries and
candidates alike, and an id is never its own neighbour.  Ties go to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapwise.llm.arrow import bound_batches
from lapwise.llm.rows import packed
from lapwise.operators.numbering import first_rows
from lapwise.session import cut

SHARD_ROWS = 4_096
# Query vectors that one copy of a graph answers.
CELL_QUERIES = 4_096
# Links of a node in an upper layer; twice as many in the lowest.
LINKS = 16
# Nodes kept while a place for a new node is looked for, and while a query is answered.
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
SEED = 12
# Nodes a shard returns for a query, at least.
LEAST_FOUND = 16

# Counts by vector length that may be broadcast.
FEW_LENGTHS = 10_000

NODE = ("dim", "k1", "k2")


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nodes(rows: DataFrame, copies: int, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``dim``, ``k1``, ``k2``, ``vector``, ``ids``: the ``copies`` smallest) and all ids by vector."""
    taken = packed(rows).select(
        F.col(f"row.{id_column}").cast("bigint").alias("vec_id"), F.col(f"row.{vector_column}").cast("array<double>").alias("vector")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    keys = [F.size("vector").alias("dim"), F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(SEED), "vector").alias("k2")]
    taken = cut(taken.select(*keys, "vec_id", "vector"), "ann-vectors")
    owners = taken.select(*NODE, "vec_id").distinct()
    smallest = first_rows(owners, list(NODE), ["vec_id"], copies).groupBy(*NODE).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    vectors = taken.groupBy(*NODE).agg(F.first("vector").alias("vector"))
    return cut(vectors.join(smallest, list(NODE)), "ann-nodes"), owners


class Graph:
    """A navigable small-world graph over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        # Very large and very small parts are brought near 1, so that no square overflows.
        largest = np.abs(vectors).max(axis=1, keepdims=True)
        self.scaled = np.where((largest > 1e100) | (largest < 1e-100), vectors / largest, vectors)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.scaled, self.scaled))
        self.unit = (self.scaled / self.norms[:, None]).astype(np.float32)
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp = 0

    @classmethod
    def built(cls, vectors: np.ndarray) -> Graph:
        graph, n = cls(vectors), len(vectors)
        draws = np.random.default_rng(SEED).random(n)
        graph.levels = np.minimum(np.floor(-np.log(1 - draws) / math.log(LINKS)), 30).astype(np.int32)
        graph.starts = np.concatenate([[0], np.cumsum(graph.levels[:-1])]).astype(np.int64) * LINKS
        graph.lowest = np.full((n, 2 * LINKS), -1, np.int32)
        graph.upper = np.full(int(graph.levels.sum()) * LINKS, -1, np.int32)
        graph.entry = 0
        for node in range(1, n):
            graph._insert(node)
        return graph

    def _places(self, node: int, layer: int) -> np.ndarray:
        if layer == 0:
            return self.lowest[node]
        start = self.starts[node] + (layer - 1) * LINKS
        return self.upper[start : start + LINKS]

    def _insert(self, node: int) -> None:
        vector, level, top = self.unit[node], int(self.levels[node]), int(self.levels[self.entry])
        best = [(float(self.unit[self.entry] @ vector), self.entry)]
        for layer in range(top, level, -1):
            best = self._walk(vector, best, 1, layer)
        for layer in range(min(level, top), -1, -1):
            best = self._walk(vector, best, BUILD_WIDTH, layer)
            order = sorted(best, reverse=True)
            chosen = self._spread(np.array([i for _, i in order]), np.array([s for s, _ in order], np.float32), LINKS)
            self._places(node, layer)[: len(chosen)] = chosen
            for other in chosen.tolist():
                self._link(other, node, layer)
        if level > top:
            self.entry = node

    def _link(self, node: int, new: int, layer: int) -> None:
        places = self._places(node, layer)
        if places[-1] < 0:
            places[int(np.argmax(places < 0))] = new
            return
        # A full list keeps three quarters, so that it is not full again at once.
        candidates = np.append(places, new)
        near = self.unit[candidates] @ self.unit[node]
        order = np.argsort(-near, kind="stable")
        kept = self._spread(candidates[order], near[order], len(places) * 3 // 4)
        places[:] = -1
        places[: len(kept)] = kept

    def _spread(self, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """At most so many of the candidates (nearest first): those not nearer to a chosen one, then the nearest others."""
        if len(candidates) <= most:
            return candidates
        between = self.unit[candidates] @ self.unit[candidates].T
        covered, chosen = np.zeros(len(candidates), bool), []
        for i in range(len(candidates)):
            if not covered[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                covered |= between[i] > near
        if len(chosen) < most:
            left = np.ones(len(candidates), bool)
            left[chosen] = False
            chosen += np.nonzero(left)[0][: most - len(chosen)].tolist()
        return candidates[chosen]

    def _walk(self, vector: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` most similar nodes found from the entries on, as a heap of (similarity, node)."""
        self.stamp += 1
        seen, stamp, unit = self.seen, self.stamp, self.unit
        best: list[tuple[float, int]] = []
        todo: list[tuple[float, int]] = []
        for near, node in entries:
            seen[node] = stamp
            heappush(best, (near, node))
            heappush(todo, (-near, node))
        while todo:
            far, node = heappop(todo)
            if len(best) >= width and -far < best[0][0]:
                break
            places = self._places(node, layer)
            others = places[(places >= 0) & (seen[places] != stamp)]
            if not len(others):
                continue
            seen[others] = stamp
            sims = unit[others] @ vector
            if len(best) >= width:
                nearer = sims > best[0][0]
                others, sims = others[nearer], sims[nearer]
            for near, other in zip(sims.tolist(), others.tolist()):
                if len(best) < width:
                    heappush(best, (near, other))
                    heappush(todo, (-near, other))
                elif near > best[0][0]:
                    heapreplace(best, (near, other))
                    heappush(todo, (-near, other))
            while len(best) > width:
                heappop(best)
        return best

    def nearest(self, vector: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most so many nodes found nearest to a vector, with their cosines in double precision."""
        largest = np.abs(vector).max()
        own = vector / largest if largest > 1e100 or largest < 1e-100 else vector
        norm = math.sqrt(float(own @ own))
        unit = (own / norm).astype(np.float32)
        best = [(float(self.unit[self.entry] @ unit), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            best = self._walk(unit, best, 1, layer)
        found = np.array([i for _, i in self._walk(unit, best, max(SEARCH_WIDTH, most), 0)])
        cosines = (self.scaled[found] @ own) / (self.norms[found] * norm)
        order = np.argsort(-cosines, kind="stable")[:most]
        return found[order], cosines[order]


INDEX = (
    "dim int, shard int, entry int, vectors binary, levels binary, starts binary, lowest binary, upper binary, "
    "ids binary, id_ends binary"
)
_FLAT = ("vectors", "levels", "starts", "lowest", "upper", "ids", "id_ends")


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The graphs of the shards of a sorted partition."""
    carried: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carried = table if carried is None else pa.concat_tables([carried, table])
        shard, dim = (carried.column(c).to_numpy() for c in ("shard", "dim"))
        bounds = [0, *(np.nonzero((np.diff(shard) != 0) | (np.diff(dim) != 0))[0] + 1).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield _graph_row(carried.slice(a, b - a))
        carried = carried.slice(bounds[-1])
    if carried is not None and carried.num_rows:
        yield _graph_row(carried)


def _graph_row(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
    vectors = rows.column("vector").chunk(0).flatten().to_numpy().reshape(-1, dim)
    ids = rows.column("ids").chunk(0)
    graph = Graph.built(vectors)
    flat = (vectors, graph.levels, graph.starts, graph.lowest, graph.upper, ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy()))
    kinds = (np.float64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int64)
    columns = [pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary()) for a, k in zip(flat, kinds)]
    numbers = [pa.array([x], pa.int32()) for x in (dim, shard, graph.entry)]
    return pa.RecordBatch.from_arrays([*numbers, *columns], ["dim", "shard", "entry", *_FLAT])


def _small(by_dim: DataFrame) -> DataFrame:
    """Counts by vector length, broadcast if there are few: as a rule there is one length, whose rows no join may gather."""
    counts = cut(by_dim, "ann-counts")
    return F.broadcast(counts) if counts.count() <= FEW_LENGTHS else counts


def build(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row of flat arrays per shard of the distinct vectors of :func:`nodes`."""
    bound_batches(distinct.sparkSession)
    sizes = _small(distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")))
    dealt = distinct.join(sizes, "dim").select("dim", F.pmod("k1", "shards").cast("int").alias("shard"), "k2", "vector", "ids")
    tasks = max(1, -(-distinct.count() // shard_rows))
    # The order within a shard is that of a hash, as a graph should grow evenly.
    sorted_shards = dealt.repartitionByRange(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "k2")
    return sorted_shards.mapInArrow(_graphs, INDEX)


def _loaded(row: dict, dim: int) -> tuple[Graph, np.ndarray, np.ndarray]:
    graph = Graph(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim))
    graph.levels, graph.starts = np.frombuffer(row["levels"], np.int32), np.frombuffer(row["starts"], np.int64)
    graph.lowest = np.frombuffer(row["lowest"], np.int32).reshape(-1, 2 * LINKS)
    graph.upper, graph.entry = np.frombuffer(row["upper"], np.int32), row["entry"]
    return graph, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)


FOUND = "dim int, k1 long, k2 long, score double, ids array<long>"


def _answers(most: int):
    """Search of the queries behind each graph of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = ids = ends = None
        for batch in batches:
            out: list[tuple] = []
            for place, (dim, k1, k2, vector) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*NODE, "vector")))):
                if vector is None:
                    row = {c: batch.column(c)[place].as_buffer() for c in _FLAT} | {"entry": batch.column("entry")[place].as_py()}
                    graph, ids, ends = _loaded(row, dim)
                    continue
                found, scores = graph.nearest(np.array(vector), most)
                for node, score in zip(found.tolist(), scores.tolist()):
                    out.append((dim, k1, k2, score, ids[ends[node - 1] if node else 0 : ends[node]]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "score", "ids"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """Rows (``dim``, ``k1``, ``k2``, ``score``, ``ids``) of the nodes found nearest to each distinct query vector.

    ``queries`` holds ``dim``, ``k1``, ``k2``, ``vector``.  At least ``k`` nodes are returned per query, if there are as many.
    """
    bound_batches(index.sparkSession)
    most = max(LEAST_FOUND, k)
    copies = _small(queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / cell_queries).alias("copies")))
    shards = _small(index.groupBy("dim").agg(F.count(F.lit(1)).alias("shards")))
    none = lambda kind: F.lit(None).cast(kind)
    graphs = index.join(copies, "dim").select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"),
        none("bigint").alias("k1"), none("bigint").alias("k2"), none("array<double>").alias("vector"), "entry", *_FLAT,
    )
    asked = queries.join(copies, "dim").join(shards, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard"),
        F.pmod("k2", "copies").cast("int").alias("copy"), "k1", "k2", "vector",
        none("int").alias("entry"), *[none("binary").alias(c) for c in _FLAT],
    )
    # Nulls come first: a graph stands before its queries.
    cells = graphs.unionByName(asked).repartition("dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", "k1", "k2")
    found = cells.mapInArrow(_answers(most), FOUND)
    return first_rows(found, list(NODE), [F.col("score").desc(), F.element_at("ids", 1)], most, "place").drop("place")


def nearest_neighbours(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found of every query, a row whose
    ``is_query`` (over ``vec_id``) holds, among all rows with another id."""
    distinct, owners = nodes(rows, k + 1, id_column, vector_column)
    index = cut(build(distinct, shard_rows), "ann-index")
    asking = cut(owners.where(is_query).withColumnRenamed("vec_id", "query_id"), "ann-queries")
    asked = distinct.join(asking.select(*NODE).distinct(), list(NODE), "left_semi").select(*NODE, "vector")
    found = cut(search(index, asked, k + 1, cell_queries), "ann-found")
    pairs = found.join(asking, list(NODE)).select("query_id", "score", F.explode("ids").alias("vec_id"))
    best = pairs.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = first_rows(best, ["query_id"], [F.col("score").desc(), "vec_id"], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
