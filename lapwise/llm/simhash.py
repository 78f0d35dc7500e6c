"""SimHash near-duplicates: fingerprints, links at a few differing bits, groups.

A fingerprint is the majority of the bits of the hashes of all word shingles.
Equal fingerprints are one node, so a group of copies of any size is one row
from then on.  Nodes get the Golay keys of :mod:`lapwise.llm.golay`; nodes that
share a key are compared, those within ``DIFFERING_BITS`` are linked, and the
groups are the connected components of the links.

A key that many nodes share is not paired within one task: its nodes are dealt
into blocks of bounded size, and only a spanning forest of each pair of blocks
is emitted, which keeps the links as few as the nodes.

Null and empty texts have fingerprint 0 and are linked like any other.  Rows with
equal ids are rows of one document.  A group of rows that all have null ids has a
null component.
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

SHINGLE_WORDS = 3
DIFFERING_BITS = 3
SEED = 42
# Nodes of one key that are compared with each other in one task.
BLOCK_NODES = 2_048
# Hashes whose bits are counted at a time.
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The SimHash of a text: a bit is set if it is set in over half of the shingle hashes."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        chunk = np.array(hashes[at : at + _CHUNK], ">u8")
        counts += np.unpackbits(chunk.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(rows: DataFrame, text: str) -> DataFrame:
    """All columns of ``rows`` but the text (a path such as ``row.text``), and ``fingerprint`` as a signed long."""
    parent, _, child = text.rpartition(".")
    kept = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in kept) + ", fingerprint long"

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(parent).field(child) if parent else batch.column(child)
        values = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values)], [*kept, "fingerprint"])

    return map_batches(rows, hashed, schema)


def _keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes = batch.column("fingerprint").to_numpy()
    rows, keys = golay.keys(nodes.view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes[rows])], ["key", "node"])


def links(nodes: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Links (``a`` < ``b``) that connect all nodes (``fingerprint``) within ``DIFFERING_BITS`` of each other.

    Within a key, or a pair of blocks of a key, a spanning forest stands for all links.
    """
    keyed = cut(map_batches(nodes, _keys_of, "key long, node long"), "simhash-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key").select("key", "node", F.ceil(F.col("n") / block_nodes).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A node meets every block; a pair of blocks is named by the smaller and the larger of them.
    dealt = shared.select("key", "node", own.alias("own"), F.explode(others).alias("other"))
    cells = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    bound_batches(nodes.sparkSession)
    grouped = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return grouped.mapInArrow(_forests, "a long, b long").distinct()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the cells of a sorted partition; a cell that ends a batch waits for the next one."""
    carried = [np.empty(0, np.int64) for _ in range(4)]
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j", "node")]
        columns = [np.concatenate(pair) for pair in zip(carried, columns)]
        new = _cell_starts(columns)
        at = int(new[-1]) if len(new) else 0
        carried = [c[at:] for c in columns]
        yield _forest_rows([c[:at] for c in columns])
    yield _forest_rows(carried)


def _cell_starts(columns: list[np.ndarray]) -> np.ndarray:
    key, i, j, _ = columns
    if not len(key):
        return np.empty(0, np.int64)
    changed = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    return np.concatenate([[0], np.nonzero(changed)[0] + 1])


def _forest_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    starts = _cell_starts(columns)
    ends = np.concatenate([starts[1:], [len(columns[0])]]).astype(np.int64) if len(starts) else starts
    nodes, a, b = columns[3], [], []
    # Small cells all at once, by the distance of the two places; large ones one by one.
    small = ends - starts <= 8
    last = np.repeat(ends, ends - starts) if len(starts) else np.empty(0, np.int64)
    is_small = np.repeat(small, ends - starts) if len(starts) else np.empty(0, bool)
    for distance in range(1, 8):
        at = np.arange(max(0, len(nodes) - distance))
        at = at[is_small[at] & (at + distance < last[at])]
        x, y = nodes[at], nodes[at + distance]
        near = (x != y) & (_bit_counts(x ^ y) <= DIFFERING_BITS)
        a.append(x[near])
        b.append(y[near])
    for start, end in zip(starts[~small].tolist(), ends[~small].tolist()):
        x, y = _forest(np.unique(nodes[start:end]))
        a.append(x)
        b.append(y)
    a, b = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _bit_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _forest(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of nodes within the distance of each other, breadth first."""
    left = np.ones(len(nodes), bool)
    a, b = [], []
    for root in range(len(nodes)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            node = queue.pop()
            waiting = np.nonzero(left)[0]
            near = waiting[_bit_counts(nodes[waiting] ^ nodes[node]) <= DIFFERING_BITS]
            left[near] = False
            queue.extend(near.tolist())
            a.append(np.full(len(near), nodes[node]))
            b.append(nodes[near])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def grouped(marked: DataFrame, order: list[str]) -> DataFrame:
    """Per fingerprint of ``marked``: ``first``, the least struct of ``order`` in the whole group."""
    nodes = cut(marked.groupBy("fingerprint").agg(F.min(F.struct(*order)).alias("first")), "simhash-nodes")
    labels = components(links(nodes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(labels, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = cut(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fingerprint", "root").join(least, "root").drop("root")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``fingerprint`` (signed) and ``component`` (smallest id of its group) of every row."""
    rows = packed(docs).select(F.col(f"row.{id_column}").alias("id"), F.col(f"row.{text_column}").alias("text"))
    marked = cut(fingerprints(rows, "text"), "simhash")
    ordered = marked.withColumn("no_id", F.col("id").isNull())
    groups = grouped(ordered, ["no_id", "id"]).select("fingerprint", F.col("first.id").alias("component"))
    return marked.join(groups, "fingerprint")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows without near-duplicates: of each group the row with the smallest id stays, one if there are several."""
    rows = packed(docs).select("row", F.monotonically_increasing_id().alias("number"))
    kept = cut(rows, "simhash-rows")
    narrow = kept.select(F.col(f"row.{id_column}").alias("id"), "number", F.col(f"row.{text_column}").alias("text"))
    marked = cut(fingerprints(narrow, "text"), "simhash").withColumn("no_id", F.col("id").isNull())
    first = grouped(marked, ["no_id", "id", "number"]).select(F.col("first.number").alias("number")).distinct()
    return kept.join(first, "number", "left_semi").select("row.*")
