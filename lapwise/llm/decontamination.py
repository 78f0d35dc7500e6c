"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark items.  A search table holds windows of
one length ``m``.  Over blocks of two words (one for single-word windows) it has
a shift table - how far the window may move when a block ends at the current
word - and buckets of windows by their last block.  Where the shift is 0 the
bucket's windows with the same first block are compared directly.

Words are numbers of the vocabulary of the windows; all other words share one
number.  Windows are dealt by hash to blocks of ``BLOCK_WINDOWS`` at most on
average, so what a worker holds does not grow with the benchmark.  A block holds
the words and a number of each window and no item ids: which items have a window
is a table of its own, joined with the numbers found (:func:`found_items`), once
for each distinct set of numbers.  A window that a third of all items share is a
row of a block like any other.

There is a pass over the documents for each block.  With one block documents are
not shuffled, so hot sources do not matter.  With more, a pass keeps the hits of
the documents that have any, under id and text hash, and these are joined once.

Null and empty texts have no words.  Items without words are never found; items
with equal ids count once, and null ids are named by an empty string.  Rows are
searched one by one; rows with equal id and text have the same hits, and rows with
equal or null ids and other texts are told apart by the hash of the text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapwise.llm.arrow import map_batches
from lapwise.llm.line_dedup import united as united_runs
from lapwise.llm.rows import packed, text_of, words
from lapwise.session import cut

WINDOW = 10
BLOCK_WINDOWS = 200_000
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HITS = "array<struct<first:int,last:int>>"

# ASCII letters and digits in lower case, other ASCII as gaps, the rest as it is.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


class WindowTable:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], int], radix: int):
        self.length, self.radix = length, radix
        self.block = min(2, length)
        self.longest = length - self.block + 1
        self.shifts: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[tuple[int, ...], int]]]] = defaultdict(lambda: defaultdict(list))
        for window, number in windows.items():
            for end in range(self.block, length + 1):
                key = self._key(window, end)
                self.shifts[key] = min(self.shifts.get(key, self.longest), length - end)
            self.buckets[self._key(window, length)][self._key(window, self.block)].append((window, number))

    def _key(self, ids, end: int) -> int:
        """The block that ends before ``end``."""
        return ids[end - 1] if self.block == 1 else ids[end - 2] * self.radix + ids[end - 1]

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, window number) of every occurrence."""
        length, longest, shift, key = self.length, self.longest, self.shifts.get, self._key
        end, n = length, len(ids)
        while end <= n:
            step = shift(key(ids, end), longest)
            if step:
                end += step
                continue
            start = end - length
            for window, number in self.buckets[key(ids, end)].get(key(ids, start + self.block), ()):
                if tuple(ids[start:end]) == window:
                    yield start, number
            end += 1


class Searcher:
    """All tables of one block of windows."""

    def __init__(self, windows: list[tuple[str, int]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for text, number in windows:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.encode().split(b" "))
            by_length[len(ids)][ids] = number
        radix = len(self.vocabulary) + 1
        self.tables = [WindowTable(length, found, radix) for length, found in sorted(by_length.items())]

    def search(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """United (first, last) word spans of all occurrences, and the numbers of the windows found, in order."""
        number_of = self.vocabulary.get
        ids = [number_of(w, 0) for w in text_words]
        spans, numbers = [], set()
        for table in self.tables:
            for start, number in table.find(ids):
                spans.append((start, start + table.length - 1))
                numbers.add(number)
        return united(spans), sorted(numbers)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _searcher(block: Broadcast) -> Searcher:
    """The block's tables; built once in a worker, which keeps those of one block."""
    if getattr(_searcher, "of", None) is not block:
        _searcher.of, _searcher.tables = block, Searcher(block.value)
    return _searcher.tables


def windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Every window as space-joined words with an item that has it (``window``, ``item``)."""
    items = packed(benchmark).select(
        F.coalesce(F.col(f"row.{id_column}").cast("string"), F.lit("")).alias("item"),
        words(_lowered(text_of(F.col(f"row.{text_column}"))), NOT_A_WORD).alias("w"),
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    exploded = items.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("start"))
    return exploded.select(F.array_join(F.slice("w", F.col("start"), F.lit(WINDOW)), " ").alias("window"), "item").distinct()


def _lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


class Benchmark:
    """The windows of a benchmark: ``patterns`` (number, window) and ``items`` (number, item), written once."""

    def __init__(self, benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text"):
        having = cut(windows(benchmark, id_column, text_column), "benchmark-windows")
        numbered = having.select("window").distinct().select(F.monotonically_increasing_id().alias("number"), "window")
        self.patterns = cut(numbered, "benchmark-patterns")
        self.items = having.join(self.patterns, "window").select("number", "item")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame | Benchmark,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Every row as ``row`` with ``n_words``, ``hits`` (word spans) and ``numbers`` (sorted, of the windows found)."""
    spark = docs.sparkSession
    if isinstance(benchmark, DataFrame):
        benchmark = Benchmark(benchmark)
    n_blocks = max(1, math.ceil(benchmark.patterns.count() / block_windows))
    rows = packed(docs)
    if n_blocks == 1:
        return _searched(rows, _block(spark, benchmark.patterns), text_column)
    text = text_of(F.col(f"row.{text_column}"))
    key = F.struct(F.col(f"row.{id_column}").alias("id"), F.xxhash64(text).alias("text_hash"))
    passes = []
    for number in range(n_blocks):
        block = _block(spark, benchmark.patterns.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == number))
        found = _searched(rows, block, text_column).where(F.size("hits") > 0)
        passes.append(cut(found.select(key.alias("key"), "hits", "numbers"), "decontamination"))
    merged = (
        reduce(DataFrame.unionByName, passes)
        .groupBy("key")
        .agg(F.flatten(F.collect_set("hits")).alias("hits"), F.flatten(F.collect_set("numbers")).alias("numbers"))
        .select("key", united_runs(F.sort_array("hits")).alias("hits"), F.sort_array(F.array_distinct("numbers")).alias("numbers"))
    )
    joined = rows.withColumn("own", key).join(
        merged, F.col("own.id").eqNullSafe(F.col("key.id")) & (F.col("own.text_hash") == F.col("key.text_hash")), "left"
    )
    return joined.select(
        "row",
        F.size(words(_lowered(text), NOT_A_WORD)).cast("bigint").alias("n_words"),
        F.coalesce("hits", F.array().cast(_HITS)).alias("hits"),
        F.coalesce("numbers", F.array().cast("array<bigint>")).alias("numbers"),
    )


def found_items(found: DataFrame, benchmark: Benchmark) -> DataFrame:
    """Each distinct ``numbers`` that is not empty, with ``items``: the sorted ids of the items that have these windows."""
    sets = found.where(F.size("numbers") > 0).select("numbers").distinct()
    pairs = sets.select("numbers", F.explode("numbers").alias("number")).join(benchmark.items, "number")
    return pairs.groupBy("numbers").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _block(spark: SparkSession, patterns: DataFrame) -> Broadcast:
    return spark.sparkContext.broadcast([(r["window"], r["number"]) for r in patterns.collect()])


def _searched(rows: DataFrame, block: Broadcast, text_column: str) -> DataFrame:
    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        searcher = _searcher(block)
        row = batch.column("row")
        counts, hits, numbers = [], [], []
        for text in row.field(text_column).to_pylist():
            text_words = split_words(text)
            spans, found = searcher.search(text_words)
            counts.append(len(text_words))
            hits.append([{"first": a, "last": b} for a, b in spans])
            numbers.append(found)
        span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        return pa.RecordBatch.from_arrays(
            [row, pa.array(counts, pa.int64()), pa.array(hits, pa.list_(span)), pa.array(numbers, pa.list_(pa.int64()))],
            ["row", "n_words", "hits", "numbers"],
        )

    out = rows.select("row", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<bigint>").alias("numbers"))
    return map_batches(rows, search, out.schema)
