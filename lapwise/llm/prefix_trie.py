"""Prefix trie of conversations, from vertical bitmaps.

Conversations are dealt to cells: ``CELL_CONVERSATIONS`` neighbouring ids by
``CELL_TURNS`` positions, so a cell is bounded however long a conversation or
however common a beginning is.  A cell is an index from (position, turn) to the
bitset of its conversations.  Nodes are found depth first: the children of a node
are the intersections of its bitset with the postings at the next position, and
popcounts and the conversations that end there are read off the bitsets.  A node
has the same key in all cells (its depth and two sums of hashes over its turns and
their places), so cells merge by an aggregation with a row per cell and node.

Sums over subtrees need no walk: every node is owned by its smallest member, a
conversation owns the end of its path, and what lies below a node is what its
members own, without the part that the node's own owner has above it.

Rows without a conversation id belong to none.  Null roles and texts are empty.
Turns are ordered by number, null first, and by a hash of role and text where
numbers are equal; repeated rows are turns of their own.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lapwise.llm.arrow import bound_batches
from lapwise.llm.rows import packed, text_of
from lapwise.operators.numbering import number_rows
from lapwise.session import cut

CELL_CONVERSATIONS = 1_024
CELL_TURNS = 64
# Turn numbers of one slice in which turns are put in order.
SLICE = 256
KEY = ("depth", "k1", "k2")
_MASK = (1 << 64) - 1


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` from 1, ``digest`` of role and text, ``n_bytes`` of the text."""
    role, text = text_of(F.col("row.role")), text_of(F.col("row.text"))
    # The length of the role keeps role and text apart.
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = packed(conversations).select(
        F.col("row.conv_id").cast("bigint").alias("conv_id"), F.col("row.turn").alias("turn"),
        digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).where("conv_id IS NOT NULL")
    numbered = number_rows(
        rows, keys=["conv_id"], slices=[F.floor(F.col("turn") / SLICE)], order=["turn", "digest", "n_bytes"], name="pos"
    )
    return numbered.select("conv_id", F.col("pos").cast("bigint").alias("pos"), "digest", "n_bytes")


def paths(numbered: DataFrame) -> DataFrame:
    """Turns as paths of the trie, with a row at position 0 for every conversation and ``last`` on its end."""
    last = numbered.groupBy("conv_id").agg(F.max("pos").alias("end"))
    placed = numbered.join(last, "conv_id").select("conv_id", "pos", "digest", "n_bytes", (F.col("pos") == F.col("end")).alias("last"))
    return placed.unionByName(_starts(last.select("conv_id", F.lit(False).alias("last"))))


def _starts(conversations: DataFrame) -> DataFrame:
    nothing = (F.lit(0).cast("bigint").alias("pos"), F.lit(b"").alias("digest"), F.lit(0).cast("bigint").alias("n_bytes"))
    return conversations.select("conv_id", *nothing, "last")


def grafted(numbered: DataFrame, head: Column, source: Column, most: int) -> DataFrame:
    """Paths of conversations whose first ``head`` turns (``most`` at most) are those of another conversation.

    ``head`` and ``source`` are expressions over ``conv_id``.  All turns of a
    shorter source are taken, and none of an absent one; own turns follow from
    ``head`` on.
    """
    sources = numbered.where(F.col("pos") <= most).groupBy(F.col("conv_id").alias("source")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "n_bytes"))).alias("head")
    )
    lengths = numbered.groupBy("conv_id").agg(F.max("pos").alias("own"))
    asked = lengths.select("conv_id", "own", head.cast("int").alias("h"), source.alias("source"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,n_bytes:bigint>>")), F.lit(1), F.col("h"))
    rebuilt = asked.join(sources, "source", "left").select("conv_id", "own", "h", taken.alias("taken"))
    length = F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    rebuilt = cut(rebuilt.withColumn("length", length.cast("bigint")), "trie-heads")
    end = (F.col("pos") == F.col("length")).alias("last")
    first = rebuilt.select("conv_id", "length", F.explode("taken").alias("t")).select("conv_id", "length", "t.*")
    shift = rebuilt.select("conv_id", "length", "h", F.size("taken").alias("n_taken"))
    own = numbered.join(shift, "conv_id").where(F.col("pos") > F.col("h"))
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("n_taken"))
    columns = ["conv_id", "pos", "digest", "n_bytes", end]
    starts = _starts(rebuilt.select("conv_id", (F.col("length") == 0).alias("last")))
    return first.select(*columns).unionByName(own.select(*columns)).unionByName(starts)


def _signed(total: Column) -> Column:
    """A sum of longs as a decimal, brought back to 64 bits."""
    whole, half = (F.lit(str(1 << bits)).cast("decimal(38,0)") for bits in (64, 63))
    rest = F.pmod(total, whole)
    return F.when(rest >= half, rest - whole).otherwise(rest).cast("bigint")


def celled(rows: DataFrame) -> DataFrame:
    """Paths with their hashes ``g1``, ``g2``, their cell, and the sums ``p1``, ``p2`` of the hashes before the cell."""
    root = F.col("pos") == 0
    hashes = [F.when(root, F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "pos", "digest")).alias(f"g{seed}") for seed in (1, 2)]
    hashed = rows.select(
        "conv_id", "pos", "n_bytes", "last", *hashes,
        F.floor(F.col("conv_id") / CELL_CONVERSATIONS).alias("shard"), F.floor(F.col("pos") / CELL_TURNS).alias("block"),
    )
    hashed = cut(hashed, "trie-turns")
    exact = [F.sum(F.col(g).cast("decimal(38,0)")).alias(g) for g in ("g1", "g2")]
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "block").agg(*exact)
    states = sums.select("conv_id", "block", *[_signed(F.sum(f"g{i}").over(before)).alias(f"p{i}") for i in (1, 2)]).where("block > 0")
    zero = F.lit(0).cast("bigint")
    return hashed.where("block = 0").select("*", zero.alias("p1"), zero.alias("p2")).unionByName(
        hashed.where("block > 0").join(states, ["conv_id", "block"]).select(*hashed.columns, "p1", "p2")
    )


CELL_ROW = (
    "depth long, k1 long, k2 long, up1 long, up2 long, shard long, n long, conv_id long, n_bytes long, "
    "ends array<long>, members array<long>"
)
_NAMES = ("depth", "k1", "k2", "up1", "up2", "shard", "n", "conv_id", "n_bytes", "ends", "members")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the cells of a sorted partition; a cell that ends a batch waits for the next one."""
    names = ("shard", "block", "conv_id", "pos", "g1", "g2", "n_bytes", "last", "p1", "p2")
    carried: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if carried is not None:
            columns = [np.concatenate(pair) for pair in zip(carried, columns)]
        cells = np.nonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0))[0] + 1
        bounds = [0, *cells.tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield _nodes([c[a:b] for c in columns])
        carried = [c[bounds[-1] :] for c in columns]
    if carried is not None and len(carried[0]):
        yield _nodes(carried)


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _wrapped(value: int) -> int:
    """64 bits as a signed integer."""
    value &= _MASK
    return value - (1 << 64) if value >> 63 else value


def _nodes(cell: list[np.ndarray]) -> pa.RecordBatch:
    shard, _, conversations, positions, g1, g2, n_bytes, last, p1, p2 = cell
    first = np.nonzero(np.diff(conversations, prepend=conversations[0] - 1))[0]
    ids, starts = conversations[first].tolist(), first.tolist()
    positions, turn, sizes = positions.tolist(), list(zip(g1.tolist(), g2.tolist())), n_bytes.tolist()
    place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conversations)))).tolist()
    ending = last.tolist()
    bottom, top = positions[starts[0]], positions[starts[0]]
    postings: dict[tuple, int] = {}
    present: dict[int, int] = {}
    ends: dict[int, int] = {}
    for row, pos in enumerate(positions):
        bit = 1 << place[row]
        postings[pos, turn[row]] = postings.get((pos, turn[row]), 0) | bit
        present[pos] = present.get(pos, 0) | bit
        if ending[row]:
            ends[pos] = ends.get(pos, 0) | bit
        top = max(top, pos)
    frontier: dict[tuple[int, int], int] = {}
    for i, row in enumerate(starts):
        state = (int(p1[row]), int(p2[row]))
        frontier[state] = frontier.get(state, 0) | 1 << i
    out: list[tuple] = []
    number = int(shard[0])
    stack = [(bitset, bottom, state) for state, bitset in frontier.items()]
    while stack:
        parent, pos, state = stack.pop()
        left = parent & present.get(pos, 0)
        while left:
            least = (left & -left).bit_length() - 1
            row = starts[least] + pos - bottom
            own = turn[row]
            child = parent & postings[pos, own]
            left &= ~child
            key = (_wrapped(state[0] + own[0]), _wrapped(state[1] + own[1]))
            here = child & ends.get(pos, 0)
            out.append((
                pos, *key, *state, number, child.bit_count(), ids[least], sizes[row],
                [ids[i] for i in _bits(here)], [ids[i] for i in _bits(child)],
            ))
            if pos < top:
                stack.append((child, pos + 1, key))
    kinds = [pa.int64()] * 9 + [pa.list_(pa.int64())] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], list(_NAMES))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node; rows are sorted by node and shard, so ids ascend."""
    node, digest = None, None
    for batch in batches:
        done = []
        keys = zip(*(batch.column(c).to_pylist() for c in KEY))
        for key, ids in zip(keys, batch.column("ends").to_pylist()):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ids)).encode())
        yield _hash_rows(done)
    if node is not None:
        yield _hash_rows([(*node, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])


def _owned(nodes: DataFrame) -> DataFrame:
    """Per node: ``below``, the weight that its owner's nodes have from it on."""
    sliced = nodes.withColumn("slice", F.floor(F.col("depth") / CELL_TURNS))
    later = Window.partitionBy("conv_id").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("conv_id", "slice").agg(F.sum("weight").alias("w"))
    sums = sums.select("conv_id", "slice", F.coalesce(F.sum("w").over(later), F.lit(0)).alias("later"))
    within = Window.partitionBy("conv_id", "slice").orderBy(F.col("depth").desc())
    return sliced.join(sums, ["conv_id", "slice"]).withColumn("below", F.sum("weight").over(within) + F.col("later"))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (:func:`paths`), a row each: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = rows.sparkSession
    bound_batches(spark)
    order = ("shard", "block", "conv_id", "pos")
    sorted_cells = celled(rows).repartition("shard", "block").sortWithinPartitions(*order)
    cells = cut(sorted_cells.mapInArrow(_cells, CELL_ROW), "trie-cells")
    merged = cells.groupBy(*KEY).agg(
        F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n_bytes").alias("n_bytes"),
        F.min("up1").alias("up1"), F.min("up2").alias("up2"),
    )
    merged = cut(merged, "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")]
    below_root = merged.where("depth > 0")
    children = below_root.groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("n_bytes")
    nodes = merged.join(children, list(KEY), "left").fillna(0, ["n_children"]).withColumn("weight", weight)
    nodes = cut(_owned(nodes), "trie-owned")
    totals = nodes.groupBy(F.col("conv_id").alias("member")).agg(
        F.sum("weight").alias("total"), F.sum((F.col("n_children") == 0).cast("bigint")).alias("leaves")
    )
    members = cells.select(*KEY, F.explode("members").alias("member")).join(totals, "member")
    sums = members.groupBy(*KEY).agg(F.sum("total").alias("all_total"), F.sum("leaves").alias("n_leaves"))
    own = totals.select(F.col("member").alias("conv_id"), F.col("total").alias("own_total"))
    ending = cells.where(F.size("ends") > 0).select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    ends = ending.mapInArrow(_end_hashes, "depth long, k1 long, k2 long, ends_sha256 string")
    parents = merged.select(
        F.col("depth").alias("up0"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id")
    )
    whole = nodes.withColumn("up0", F.when(F.col("depth") > 0, F.col("depth") - 1)).join(sums, list(KEY)).join(own, "conv_id")
    whole = whole.join(ends, list(KEY), "left").join(parents, ["up0", "up1", "up2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("own_total") + F.col("all_total")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    return trie(paths(cut(turns(conversations), "trie-order")))
