"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one node, so a group of copies of any size is one row
from then on.  Candidates are found by SimHash: a set has a fingerprint of
``SEGMENTS`` segments of 23 bits, each bit the majority of a bit of the
shingles' hashes.  A similarity of 0.8 is a cosine of 8/9 at least, so that a bit
differs with a probability of 0.152 at most: too many bits for keys of exact
segments.  So every segment is decoded to one index of the Golay code by the
margins of its bits (:func:`lapwise.llm.golay.weighted_index`), which two such sets
share with a probability of 0.2 for each segment, and of 0.99999 for some.

Nodes that share an index are compared by the first ``PRINT_WORDS`` words of their
fingerprints.  Those within ``DIFFERING_BITS`` are linked: by chance few, and of large
sets of similarity 0.8 hardly any are further apart (binomial tails).  A key
that many nodes share is dealt into blocks of bounded size.

The components of these links are clusters of candidates.  All nodes
of a cluster are compared by their whole sets; a cluster of many shingles is dealt
into blocks of bounded size, and each pair of blocks gives a spanning forest of
the pairs that are similar.  The groups are the connected components of these.

A text of fewer words is one shingle.  Null and empty texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lapwise.llm import golay
from lapwise.llm.arrow import bound_batches, map_batches
from lapwise.llm.components import components
from lapwise.llm.rows import packed
from lapwise.session import cut

SHINGLE_WORDS = 5
# Similarity as a fraction of integers, so that the limit itself is met exactly.
SIMILAR = (4, 5)
SEGMENTS, SEGMENT_BITS = 48, 23
# Words of a fingerprint that are compared, and their differing bits.
PRINT_WORDS, DIFFERING_BITS = 3, 58
SEED = 42
# Shingles of one cluster that are compared with each other in one task, on average.
BLOCK_SHINGLES = 1 << 16
# Nodes of one key that are compared with each other in one task, and how many at a time.
BLOCK_NODES = 2_048
_STEP = 256
# Shingles whose bits are counted at a time.
_CHUNK = 1 << 12

_FACTORS = np.random.default_rng(SEED).integers(0, 2**64, -(-SEGMENTS * SEGMENT_BITS // 64), dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]
    return np.unique(np.array(hashes, np.uint64))


def _hash_words(found: np.ndarray) -> np.ndarray:
    """As many hashes of each shingle as a fingerprint has words."""
    words = found[:, None] * _FACTORS[None, :]
    words ^= words >> np.uint64(32)
    words *= _MIX
    words ^= words >> np.uint64(29)
    return words


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set: three rows become their sum and their carries until two are left of each weight."""
    counts, weight = np.zeros(64 * words.shape[1], np.int64), 1
    while len(words):
        carries = [words[:0]]
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * third :]])
        bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def margins(found: np.ndarray) -> np.ndarray:
    """By how many of a set's hashes each bit is set more often than not."""
    counts = np.zeros(64 * len(_FACTORS), np.int64)
    for at in range(0, len(found), _CHUNK):
        counts += _bit_counts(_hash_words(found[at : at + _CHUNK]))
    return 2 * counts - len(found)


def fingerprints(margins: np.ndarray) -> np.ndarray:
    """The words of each row of margins that are compared: a bit is set if it is in over half of the hashes."""
    bits = margins[:, : 64 * PRINT_WORDS] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def keys(margins: np.ndarray) -> np.ndarray:
    """A key for each segment of each row of margins: its place and its index of the Golay code."""
    segments = margins[:, : SEGMENTS * SEGMENT_BITS].reshape(-1, SEGMENT_BITS)
    found = golay.weighted_index(segments).reshape(-1, SEGMENTS).astype(np.int32)
    return found | (np.arange(SEGMENTS, dtype=np.int32) << 12)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def _marked(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in batch.column("text").to_pylist()]
    nodes = pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64))
    sizes = pa.array([len(s) for s in sets], pa.int64())
    counted = np.array([margins(s) for s in sets], np.int64).reshape(len(sets), -1)
    prints = [p.view(np.int64) if len(s) else [] for s, p in zip(sets, fingerprints(counted))]
    found = [k if len(s) else [] for s, k in zip(sets, keys(counted))]
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), batch.column("number"), nodes, sizes, pa.array(prints, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int32()))],
        ["id", "number", "node", "size", "print", "keys"],
    )


def _clusters(prints: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``first`` and ``cluster`` of the fingerprints (``print``, with ``keys``) near to others; ``first`` is their first word."""
    words = [F.col("print")[i].alias(f"w{i}") for i in range(PRINT_WORDS)]
    keyed = cut(prints.select(*words, "keys"), "copies-prints").select(F.explode("keys").alias("key"), *[f"w{i}" for i in range(PRINT_WORDS)])
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = sizes.select("key", F.ceil(F.col("n") / block_nodes).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("w0"), F.col("blocks").cast("bigint")).cast("int")
    # A node meets every block; a pair of blocks is named by the smaller and the larger of them.
    dealt = keyed.join(blocks, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *[f"w{i}" for i in range(PRINT_WORDS)])
    bound_batches(prints.sparkSession)
    grouped = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = grouped.mapInArrow(_near_prints, "a long, b long").distinct()
    return components(found).select(F.col("node").alias("first"), F.col("root").alias("cluster"))


def _near_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the first words of near fingerprints, cell by cell of a sorted partition; a cell that ends a batch waits."""
    carried = None
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        rows = rows if carried is None else np.concatenate([carried, rows])
        ends = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0] + 1
        yield _linked(np.split(rows, ends)[:-1])
        carried = rows[ends[-1] :] if len(ends) else rows
    if carried is not None:
        yield _linked([carried])


def _linked(cells: list[np.ndarray]) -> pa.RecordBatch:
    pairs = [near_pairs(cell[:, 3:].view(np.uint64)) for cell in cells if len(cell) > 1]
    a, b = (np.concatenate([p[side] for p in pairs]) if pairs else np.empty(0, np.uint64) for side in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])


def near_pairs(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the pairs of a spanning forest of fingerprints within the distance of each other."""
    def near(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        differing = sum(np.bitwise_count(prints[rows, w][:, None] ^ prints[others, w][None, :]).astype(np.int16) for w in range(PRINT_WORDS))
        return differing <= DIFFERING_BITS

    every = np.arange(len(prints))
    steps = [every[at : at + _STEP] for at in range(0, len(prints), _STEP)]
    linked = every[np.concatenate([near(step, every).sum(axis=1) > 1 for step in steps])]
    a, b = [prints[:0, 0]], [prints[:0, 0]]
    left = linked
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            found = near(np.array([node]), left)[0]
            reached, left = left[found], left[~found]
            queue.extend(reached)
            a.append(np.full(len(reached), prints[node, 0]))
            b.append(prints[reached, 0])
    return np.concatenate(a), np.concatenate(b)


def links(clustered: DataFrame, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (``a``, ``b``) that connect all similar nodes of each cluster; rows are ``cluster``, ``node``, ``size``, ``text``."""
    sizes = clustered.groupBy("cluster").agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
    dealt = clustered.join(sizes, "cluster").select("cluster", "node", "text", "blocks", own.alias("own"))
    # A node meets every block; a pair of blocks is named by the smaller and the larger of them.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    kind = "cluster long, blocks int, own int, node long, shingles array<long>"
    cells = map_batches(dealt, _with_sets, kind).select("cluster", "own", "node", "shingles", others)
    cells = cells.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles")
    bound_batches(clustered.sparkSession)
    grouped = cells.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return grouped.mapInArrow(_forests, "a long, b long").distinct()


def _with_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = pa.array([shingles(t).view(np.int64) for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))
    kept = ["cluster", "blocks", "own", "node"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], sets], [*kept, "shingles"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the cells of a sorted partition."""
    cell, nodes, sets = None, [], []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")))
        column = batch.column("shingles")
        for row, (name, node) in enumerate(zip(names, batch.column("node").to_pylist())):
            if name != cell:
                yield _link_rows(nodes, sets)
                cell, nodes, sets = name, [], []
            nodes.append(node)
            sets.append(column[row].values.to_numpy().copy())
    yield _link_rows(nodes, sets)


def _link_rows(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    pairs = [(nodes[a], nodes[b]) for a, b in forest(sets)] if len(nodes) > 1 else []
    a, b = ([min(p) for p in pairs], [max(p) for p in pairs])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of the sets (not empty) that are similar to each other."""
    part, whole = SIMILAR
    sizes = np.array([len(s) for s in sets])
    vocabulary, words = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marks = np.zeros(len(vocabulary), np.int64)
    left = np.ones(len(sets), bool)
    pairs = []
    for root in range(len(sets)):
        queue = [root] if left[root] else []
        left[root] = False
        while queue:
            node = queue.pop()
            own = words[starts[node] : starts[node] + sizes[node]]
            marks[own] = 1
            common = np.add.reduceat(marks[words], starts)
            marks[own] = 0
            # common / (sizes together - common) >= part / whole
            near = np.nonzero(left & ((part + whole) * common >= part * (sizes + sizes[node])))[0]
            left[near] = False
            queue.extend(near.tolist())
            pairs.extend((node, other) for other in near.tolist())
    return pairs


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """The rows without near copies: of each group the row with the smallest id stays, one if there are several."""
    rows = packed(docs).select("row", F.monotonically_increasing_id().alias("number"))
    kept = cut(rows, "copies-rows")
    narrow = kept.select(F.col(f"row.{id_column}").alias("id"), "number", F.col(f"row.{text_column}").alias("text"))
    kind = f"id {dict(narrow.dtypes)['id']}, number long, node long, size long, print array<long>, keys array<int>"
    marked = cut(map_batches(narrow, _marked, kind), "copies")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "number")
    # Equal nodes have equal sets, and so equal sizes and fingerprints.
    same = marked.groupBy("node").agg(F.min(order).alias("first"), F.min("size").alias("size"), F.min(F.get("print", F.lit(0))).alias("w0"))
    nodes = cut(same, "copies-nodes")
    firsts = nodes.where("size > 0").select(F.col("first.number").alias("number"))
    clusters = _clusters(marked.join(firsts, "number", "left_semi"))
    # Fingerprints with the same first word are a cluster without a link.
    named = nodes.where("size > 0").join(clusters.withColumnRenamed("first", "w0"), "w0", "left").withColumn("cluster", F.coalesce("cluster", "w0"))
    shared = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
    picked = named.join(shared, "cluster").select("cluster", "node", "size", F.col("first.number").alias("number"))
    clustered = cut(picked.join(narrow.select("number", "text"), "number").drop("number"), "copies-clustered")
    labels = components(links(clustered, block_shingles))
    rooted = nodes.join(labels, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.number").alias("number"))
    return kept.join(first, "number", "left_semi").select("row.*")
