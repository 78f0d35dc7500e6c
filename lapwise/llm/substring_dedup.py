"""Removal of byte strings that a document with a smaller id contains, by column-wise suffix sorting.

``LENGTH`` bytes is the shortest string that counts.  The method inserts one
symbol of every string in each round, from the right: the new suffixes' order
follows from the last round's by a stable partition by the symbols inserted,
which read in that order are the round's column of the Burrows-Wheeler transform
(Bauer, Cox and Rosone, Lightweight BWT construction for very large string
collections, 2011).  Equal prefixes then stand side by side, and comparing
neighbours over ``LENGTH`` bytes tells where the common prefix is long enough.

A round for each byte of the longest document would be a job for each of them.
The collection is therefore cut into short strings first, without losing a match:

1. Of the ``GRAM``-byte windows inside every ``LENGTH``-byte string the one with
   the smallest hash is its anchor, so equal strings have equal anchors at the
   same offset.  Anchors are exchanged as packed arrays, and those that occur in
   one text only are dropped.
2. The others are cut out with the strings they are the anchor of: ``COLUMNS``
   bytes at most, aligned at the anchor.  Rounds are thus ``COLUMNS`` and no more,
   whatever the documents' lengths.  Strings are compared within the batch first,
   and only strings that are first there, by content, go on to the task of their
   anchor.
3. Spans found go back to their documents, whose bytes they are cut out of.

Texts travel once, by document.  What a task holds is its share of the anchors or
strings, in proportion to the number of shuffle partitions.  Copies of a whole
text are found by its hash and removed as a whole; they take no part in the rest.
An anchor with many strings is told apart by the bytes next to it: a string
reaches ``HALF`` bytes to one of its sides at least.

Null and empty texts have no bytes.  Rows with equal ids are one document: what
they share stays.  Null ids stand behind all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lapwise.llm.arrow import bound_batches, map_batches
from lapwise.llm.rows import packed

LENGTH = 50
GRAM = 24
# Strings of LENGTH bytes that contain a given anchor, and the bytes they span.
STRINGS = LENGTH - GRAM + 1
COLUMNS = LENGTH + STRINGS - 1
# Buckets of anchors and strings; more where the session shuffles into more partitions.  What a document has in a
# bucket is one row, so with few buckets their number would decide the rows rather than the anchors.
LEAST_BUCKETS = 64
# Occurrences of an anchor from which its strings are dealt by their neighbouring bytes too.
HOT_ANCHOR = 4_096
HALF = (STRINGS - 1) // 2
# Positions that are hashed at a time, which bounds the memory; they fit the low bits of a packed minimum.
_PIECE = 1 << 19
_PLACE_BITS = np.uint64(24)
_LAST_ID = 2**63 - 1
_KEY = "id long, text_hash long"


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all windows of ``length`` bytes, by joining windows of doubled lengths."""
    current, size, factor = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
    joined, covered = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if joined is None:
                    joined, covered = current, size
                else:
                    n = len(current) - covered
                    joined, covered = joined[:n] * factor + current[covered : covered + n], covered + size
            if size * 2 > length:
                break
            n = len(current) - size
            current, size, factor = current[:n] * factor + current[size:], size * 2, factor * factor
        mixed = joined * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


class Anchors:
    """Anchors of a batch of texts laid end to end.

    ``place`` is an anchor's place in the batch, ``row`` its text, and ``first``
    and ``last`` the range of its strings (0 has the anchor at its end).
    """

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        parts = [
            self._piece(at, min(at + _PIECE + LENGTH - 1, len(self.data)))
            for at in range(0, max(len(self.data) - LENGTH + 1, 0), _PIECE)
        ]
        first, last, place, hashes = (
            np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64 if i == 3 else np.int64) for i in range(4)
        )
        # An anchor of strings on either side of a cut between pieces is one.
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        heads = np.nonzero(new)[0]
        ends = np.append(heads[1:], len(place))[: len(heads)] - 1
        self.place, self.hash = place[heads], hashes[heads]
        self.first = first[heads] - self.place + STRINGS - 1
        self.last = last[ends] - self.place + STRINGS - 1
        self.row = np.searchsorted(self.starts, self.place, side="right") - 1

    def _piece(self, start: int, end: int):
        """First and last string, place and hash of the anchors of the strings that start in a piece."""
        hashes = gram_hashes(self.data[start:end], GRAM)
        packed_places = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least = _least_of(packed_places, STRINGS)
        # A string that would reach over the end of its text is none.
        rows = slice(np.searchsorted(self.starts, start, side="right") - 1, np.searchsorted(self.starts, start + len(least)))
        begins = np.maximum(self.starts[:-1][rows], start)
        ends = np.minimum(self.starts[1:][rows], start + len(least))
        text_end = np.repeat(self.starts[1:][rows], np.maximum(ends - begins, 0))
        strings = np.nonzero(np.arange(start + LENGTH, start + LENGTH + len(least)) <= text_end)[0]
        places = (least[strings] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        heads = np.nonzero(new)[0]
        tails = np.append(heads[1:], len(places))[: len(heads)] - 1
        return strings[heads] + start, strings[tails] + start, places[heads] + start, hashes[places[heads]]

    def offset(self) -> np.ndarray:
        """Place of each anchor in its text."""
        return self.place - self.starts[self.row]

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("place", "hash", "first", "last", "row"):
            setattr(self, name, getattr(self, name)[chosen])

    def strings(self) -> np.ndarray:
        """A row of ``COLUMNS`` bytes for each anchor; bytes outside its strings are 0."""
        padded = np.concatenate([np.zeros(STRINGS, np.uint8), self.data, np.zeros(COLUMNS, np.uint8)])
        cut = np.lib.stride_tricks.sliding_window_view(padded, COLUMNS)[self.place + 1]
        columns = np.arange(COLUMNS)
        return np.where((columns >= self.first[:, None]) & (columns < self.last[:, None] + LENGTH), cut, 0).astype(np.uint8)


def repeated(strings: np.ndarray, first: np.ndarray, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each string (row, offset) also stands, aligned, in a row with a smaller id.

    One round per column from the right; from round ``LENGTH`` on, each completes
    the strings that start at its column.
    """
    flags = np.zeros((len(strings), STRINGS), bool)
    by_column = np.ascontiguousarray(strings.T)
    order = np.arange(len(strings))
    for column in range(COLUMNS - 1, -1, -1):
        order = order[np.argsort(by_column[column][order], kind="stable")]
        if column >= STRINGS:
            continue
        rows = order[(first[order] <= column) & (column <= last[order])]
        if len(rows) < 2:
            continue
        prefixes = strings[rows, column : column + LENGTH]
        heads = np.concatenate([[0], np.nonzero((prefixes[1:] != prefixes[:-1]).any(axis=1))[0] + 1])
        least = np.repeat(np.minimum.reduceat(ids[rows], heads), np.diff(np.append(heads, len(rows))))
        flags[rows, column] = ids[rows] > least
    return flags


def _runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, (start, end)) of the bytes that runs of flagged strings cover, from the anchors' offsets in their texts."""
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    base = offsets[rows] - (STRINGS - 1)
    return rows, np.stack([base + starts, base + ends - 1 + LENGTH], axis=1).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; the bytes of numbers are laid out by significance."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for array in arrays:
        array = np.ascontiguousarray(array)
        kind = array.dtype.str.encode().ljust(4)
        width = array.dtype.itemsize
        laid_out = array.reshape(-1).view(np.uint8).reshape(-1, width).T.tobytes()
        parts += [kind, np.array([array.size], "<i8").tobytes(), laid_out]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8
    for _ in range(int(np.frombuffer(data, "<i8", 1)[0])):
        kind = np.dtype(data[at : at + 4].decode().strip())
        size = int(np.frombuffer(data, "<i8", 1, at + 4)[0])
        at += 12
        laid_out = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(laid_out.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def _buckets(batch_rows: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(batch_rows), pa.int32()), pa.array(list(batch_rows.values()), pa.large_binary()).cast(pa.binary())],
        ["bucket", "packed"],
    )


def _by_document(ids: np.ndarray, text_hashes: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row (id, text_hash, values) per document, the values as 64-bit numbers in a string of bytes."""
    order = np.lexsort((text_hashes, ids))
    ids, text_hashes, values = ids[order], text_hashes[order], np.ascontiguousarray(values[order])
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (text_hashes[1:] != text_hashes[:-1])
    heads = np.nonzero(new)[0]
    width = 8 * (values.size // max(len(ids), 1))
    ends = np.append(heads[1:], len(ids))
    for at in range(0, len(heads), 50_000):
        some, upto = heads[at : at + 50_000], ends[at : at + 50_000]
        data = values[some[0] : upto[-1]].tobytes()
        offsets = (np.append(some, upto[-1]) - some[0]) * width
        binary = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(text_hashes[some]), binary], ["id", "text_hash", "found"])


def _exchanged(rows: DataFrame, buckets: int, function) -> DataFrame:
    """``function`` on all packed rows of a bucket, as (id, text_hash, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [blob for batch in batches for blob in batch.column("packed").to_pylist()]
        if blobs:
            yield from function([_unpack(b) for b in blobs])

    bound_batches(rows.sparkSession)
    return rows.repartition(buckets, "bucket").mapInArrow(run, f"{_KEY}, found binary")


def _anchor_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors of each batch, by bucket of their hash."""

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, hashes, data = _columns(batch)
        # Copies within the batch have the same anchors: the smallest id stands for them.
        order = np.lexsort((ids, hashes))
        order = order[np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])]
        found = Anchors([data[i] for i in order])
        ids, hashes = ids[order], hashes[order]
        bucket = (found.hash % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        offsets, out = found.offset(), {}
        for b in range(buckets):
            some = by_bucket[cuts[b] : cuts[b + 1]]
            if len(some):
                row = found.row[some]
                heads = np.nonzero(np.concatenate([[True], row[1:] != row[:-1]]))[0]
                short = found.hash[some] >> np.uint64(24)
                out[b] = _pack(
                    (short & np.uint64(0xFFFFFFFF)).astype(np.uint32), (short >> np.uint64(32)).astype(np.uint8),
                    np.diff(offsets[some], prepend=0).astype(np.int32), ids[row[heads]], hashes[row[heads]],
                    np.diff(np.append(heads, len(some))).astype(np.int32),
                )
        return _buckets(out) if out else None

    return map_batches(texts, anchors, "bucket int, packed binary")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "text_hash"))
    return ids, hashes, batch.column("data").to_pylist()


def _shared(blobs: list[list[np.ndarray]], hot_anchor: int) -> Iterator[pa.RecordBatch]:
    """Anchors of a bucket that stand in two texts or more: their offsets, negative (less 1) for those of hot anchors."""
    low, high, steps, ids, text_hashes, counts = (np.concatenate(c) for c in zip(*[
        (b[0], b[1], np.cumsum(b[2].astype(np.int64)), b[3], b[4], b[5]) for b in blobs
    ]))
    anchor = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    # By anchor, text, id: of a text's copies the smallest id stays.
    order = order[np.lexsort((steps[order], ids[row[order]], text_hashes[row[order]], anchor[order]))]
    if not len(order):
        return
    key, text, owner = anchor[order], text_hashes[row[order]], ids[row[order]]
    new_text = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
    head = np.maximum.accumulate(np.where(new_text, np.arange(len(order)), 0))
    order, key, new_text = (x[owner == owner[head]] for x in (order, key, new_text))
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    sizes = np.diff(np.append(starts, len(key)))
    texts = np.add.reduceat(new_text.astype(np.int64), starts)
    chosen = np.repeat(texts > 1, sizes)
    hot = np.repeat(sizes > hot_anchor, sizes)[chosen]
    order = order[chosen]
    offsets = steps[order]
    yield from _by_document(ids[row[order]], text_hashes[row[order]], np.where(hot, -offsets - 1, offsets))


def _string_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """Packed strings of the shared anchors (``anchors`` of a row) that are first in their batch, and the spans of others."""

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, hashes, data = _columns(batch)
        found = Anchors(data)
        offsets = found.offset()
        hot = np.zeros(len(offsets), bool)
        chosen = np.zeros(len(offsets), bool)
        cuts = np.searchsorted(found.row, np.arange(len(data) + 1))
        for i, blobs in enumerate(batch.column("anchors").to_pylist()):
            places = np.frombuffer(b"".join(blobs), np.int64)
            is_hot = places < 0
            at = cuts[i] + np.searchsorted(offsets[cuts[i] : cuts[i + 1]], np.where(is_hot, -places - 1, places))
            chosen[at] = True
            hot[at[is_hot]] = True
        found.keep(chosen)
        hot, offsets = hot[chosen], offsets[chosen]
        strings = found.strings()
        owner = ids[found.row]
        flags = repeated(strings, found.first, found.last, owner)
        span_rows, spans = _runs(flags, offsets)
        covered = (np.arange(STRINGS) >= found.first[:, None]) & (np.arange(STRINGS) <= found.last[:, None])
        waiting = (covered & ~flags).any(axis=1)
        rows = np.nonzero(waiting)[0]
        rows, first, last, deal = _dealt(rows, hot, found, strings)
        bucket = np.concatenate([(deal % np.uint64(buckets)).astype(np.int64), ids[found.row[span_rows]] % buckets])
        out = {}
        for b in np.unique(bucket).tolist():
            some = np.nonzero(bucket[: len(rows)] == b)[0]
            own = np.nonzero(bucket[len(rows) :] == b)[0]
            # In the order of content, which packs well.
            some = some[np.lexsort((first[some], found.hash[rows[some]]))]
            r, s = rows[some], span_rows[own]
            out[b] = _pack(
                strings[r].T, first[some].astype(np.int8), last[some].astype(np.int8), offsets[r],
                ids[found.row[r]], hashes[found.row[r]], ids[found.row[s]], hashes[found.row[s]], spans[own].reshape(-1),
            )
        return _buckets(out) if out else None

    return map_batches(texts, cut_out, "bucket int, packed binary")


def _dealt(rows: np.ndarray, hot: np.ndarray, found: Anchors, strings: np.ndarray):
    """Rows to send, the range of strings each stands for, and the number that deals them.

    Strings of a hot anchor are dealt by the ``HALF`` bytes before it or behind it.
    """
    is_hot = hot[rows]
    cold, warm = rows[~is_hot], rows[is_hot]
    sent, first, last, deal = [cold], [found.first[cold]], [found.last[cold]], [found.hash[cold]]
    anchor = STRINGS - 1
    for low, high, columns in (
        (0, anchor - HALF, slice(anchor - HALF, anchor)),
        (anchor - HALF + 1, STRINGS - 1, slice(anchor + GRAM, anchor + GRAM + HALF)),
    ):
        a, b = np.maximum(found.first[warm], low), np.minimum(found.last[warm], high)
        some = warm[a <= b]
        beside = gram_hashes(np.ascontiguousarray(strings[some, columns]).reshape(-1), HALF)[::HALF] if len(some) else np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            deal.append(found.hash[some] * np.uint64(31) + beside[: len(some)])
        sent.append(some)
        first.append(a[a <= b])
        last.append(b[a <= b])
    return tuple(np.concatenate(x) for x in (sent, first, last, deal))


def _spans(blobs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated strings of a bucket, with those that were found before."""
    strings = np.concatenate([b[0].reshape(COLUMNS, -1).T for b in blobs])
    first, last, offsets, ids, hashes, span_ids, span_hashes = (
        np.concatenate([b[i] for b in blobs]) for i in range(1, 8)
    )
    spans = np.concatenate([b[8].reshape(-1, 2) for b in blobs])
    flags = repeated(strings, first.astype(np.int64), last.astype(np.int64), ids)
    rows, new = _runs(flags, offsets)
    every = np.concatenate([spans, new])
    yield from _by_document(np.concatenate([span_ids, ids[rows]]), np.concatenate([span_hashes, hashes[rows]]), every)


def substring_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_anchor: int = HOT_ANCHOR
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes of every row."""
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = F.coalesce(F.col(f"row.{text_column}"), F.lit("")).cast("binary")
    order = F.coalesce(F.col(f"row.{id_column}").cast("long"), F.lit(_LAST_ID))
    texts = packed(docs).select(order.alias("id"), F.xxhash64(data).alias("text_hash"), data.alias("data"))
    key = ["id", "text_hash"]

    # Later copies of whole texts, by a hash that tells texts apart for certain.
    digests = texts.select(*key, F.md5("data").alias("digest"))
    firsts = digests.groupBy("text_hash", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    copies = digests.join(firsts, ["text_hash", "digest"]).where("id > first").select(*key).distinct()

    shared = _exchanged(_anchor_rows(texts, buckets), buckets, lambda blobs: _shared(blobs, hot_anchor))
    anchors = shared.groupBy(*key).agg(F.collect_list("found").alias("anchors"))
    strings = _string_rows(texts.join(anchors, key), buckets)
    spans = _exchanged(strings, buckets, _spans).groupBy(*key).agg(F.collect_list("found").alias("spans"))
    marked = texts.join(spans, key, "left").join(copies.withColumn("copy", F.lit(True)), key, "left")

    def cut_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for data, found, copy in zip(*(batch.column(c).to_pylist() for c in ("data", "spans", "copy"))):
            removed, n_spans, kept = without(data, b"".join(found or ()), bool(copy))
            for column, value in zip(columns, (len(data), removed, n_spans, kept)):
                column.append(value)
        counts = [pa.array(c, pa.int64()) for c in columns[:3]]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
        return pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(columns[3], pa.binary())], names)

    done = map_batches(marked, cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumn("id", F.nullif("id", F.lit(_LAST_ID)))


def without(data: bytes, spans: bytes, copy: bool) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left of a text."""
    if copy and len(data) >= LENGTH:
        return len(data), 1, b""
    if not spans:
        return 0, 0, data
    edges = np.zeros(len(data) + 1, np.int64)
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1], -1)
    gone = np.cumsum(edges[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def sha256_of_kept(rows: DataFrame) -> DataFrame:
    """The rows with ``kept_sha256`` instead of the bytes."""
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
