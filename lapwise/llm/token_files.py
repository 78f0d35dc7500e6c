"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id, encoded, and written as one
list of ids per document; ORC encodes the list's integers in runs.  A stripe is a
unit of parallel reading; row indexes and Bloom filters on ``doc_id`` let a lookup
skip stripes and row groups.  File names follow the ranges, so the position of a
document in the whole corpus is the total of the files before its own plus the
ids before it in its file.  Only counts are shuffled to find it, never ids.

The tokenizers library encodes pieces of a text between blanks and line ends;
pieces are remembered, so frequent ones are encoded once by a worker.  This is
exact where no token, normalisation or special token reaches over a blank, which
holds for vocabularies of words with word ends.

A worker remembers a bounded number of pieces.

Null and empty texts are a document of the end id alone.  Null ids come first,
rows with equal ids follow one another in the order of their texts.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lapwise.llm.arrow import map_batches
from lapwise.llm.bpe import id_lists, share_file
from lapwise.llm.rows import packed
from lapwise.session import cut, work_dir

END_ID = 2
STRIPE_BYTES = 64 << 20
INDEX_ROWS = 1_000
REMEMBERED_PIECES = 400_000
# Pieces that are encoded in one call.
TOGETHER = 1_000
# Marks that often stand behind a word.
MARKS = tuple(".,;:!?")
# Letters whose lower case and composition are one letter again.
is_word = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class Recent(dict):
    """What was used lately: two generations of a bounded number of entries; a full one becomes the older one."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def turn_over(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def unknown(self, keys: set) -> set:
        older = self.older
        return {k for k in keys if k not in self and k not in older}


class PieceEncoder:
    """Ids of pieces by the tokenizers library, remembered as little-endian bytes.

    Pieces of plain letters only are one word each; they are encoded many at a
    time, as a text, and told apart by the word ends of their last ids.  Others
    are encoded one by one, as their normalisation may make several words.
    """

    def __init__(self, text: str):
        # A task has one core.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Recent(REMEMBERED_PIECES)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        self.known.turn_over()
        self._learn(self.known.unknown(set().union(*pieces)))
        end = np.array([end_id], "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, p)) + end for p in pieces]

    def _learn(self, new: set[str]) -> None:
        words = {p for p in new if is_word(p)}
        # A word and the mark behind it are two words.
        marked = {p for p in new - words if p[-1:] in MARKS and is_word(p[:-1])}
        every = words.union(p[:-1] for p in marked)
        # Lower case is part of the normalisation.
        self._learn_words(list(self.known.unknown(set(map(str.lower, every)))))
        self.known.update((w, self.known[w.lower()]) for w in self.known.unknown(every))
        self._learn_pieces(list((new - words - marked) | self.known.unknown({p[-1] for p in marked})))
        self.known.update((p, self.known[p[:-1]] + self.known[p[-1]]) for p in marked)

    def _learn_words(self, words: list[str]) -> None:
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        texts = [" ".join(part) for part in parts]
        for part, coded in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            ends = (4 * (np.nonzero(self.ends_word[ids])[0] + 1)).tolist()
            data = ids.tobytes()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _learn_pieces(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            for piece, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[piece] = np.array(coded.ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def _encoder(text: str) -> PieceEncoder:
    return PieceEncoder(text)


def write_tokens(
    docs: DataFrame, vocabulary_path: str, path: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write ``doc_id`` and ``ids`` as ORC files in ascending order of ids."""
    spark = docs.sparkSession
    vocabulary = share_file(spark, vocabulary_path)
    rows = packed(docs).selectExpr(f"row.`{id_column}` AS doc_id", f"row.`{text_column}` AS text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoder(vocabulary.value).encode([t or "" for t in batch.column("text").to_pylist()], end_id)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), id_lists(ids)], ["doc_id", "ids"])

    tokens = map_batches(ordered, encoded, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")
    (
        tokens.write.format("orc")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` as written; a filter on ``doc_id`` reaches the stripes' indexes."""
    return spark.read.orc(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of the files' documents."""
    # A file may be read in several splits; within one, rows keep their order and numbers ascend.
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    stored = spark.read.orc(path).select(F.col("_metadata.file_name").alias("file"), place.alias("place"), "doc_id", "ids")

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("ids")
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        offsets = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        view = memoryview(ids).cast("B")
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        kept = [batch.column(c) for c in ("file", "place", "doc_id")]
        lengths = pa.array(np.diff(offsets).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [*kept, lengths, pa.array(sums, pa.int64())], ["file", "place", "doc_id", "n_tokens", "ids_crc32"]
        )

    kind = dict(stored.dtypes)["doc_id"]
    schema = f"file string, place struct<split:long,number:long>, doc_id {kind}, n_tokens long, ids_crc32 long"
    # Counts without ids, read by file and by document: the files themselves are read once.
    counted = cut(map_batches(stored, summed, schema), "token-counts")
    # Names count the ranges, with more digits from 100,000 files on.
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint")
    before_file = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    files = counted.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        F.col("file"), F.coalesce(F.sum("n").over(before_file), F.lit(0)).alias("file_start")
    )
    before_row = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = counted.withColumn("in_file", F.coalesce(F.sum("n_tokens").over(before_row), F.lit(0)))
    start = (F.col("file_start") + F.col("in_file")).alias("start")
    return within.join(files, "file").select("doc_id", start, "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Write the documents' ids to a new folder and read their positions back."""
    spark = docs.sparkSession
    path = work_dir(spark, "tokens")
    write_tokens(docs, vocabulary_path, path)
    return positions(spark, path)
