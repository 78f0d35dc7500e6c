"""Byte-level BPE by a contiguous array of part boundaries and adjacent ranks.

A word (a piece that the split pattern yields) starts as its bytes.  The array
holds, for every part, the rank at which it merges with its right neighbour.  The
smallest rank is searched for, the boundary behind it is deleted, and the ranks
of the merged part and of the part before it are refreshed, until no pair has a
rank.  Words of one length are encoded together as rows of a matrix, so a scan
for the minimum is one numpy operation for all of them.  Very long words keep
their candidate pairs in a heap instead, which takes the same merges in the same
order.

Words are encoded once for each stretch of documents: a worker remembers a
bounded number of them.  Special tokens in a text are found before it is split,
as the tokenizers library does.  Decoding joins the bytes of the ids; a decoded
text is compared, not assumed.

Null and empty texts have no ids and decode to an empty text.  Documents are
encoded one by one, so repeated rows need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lapwise.llm.arrow import map_batches
from lapwise.llm.rows import packed

# The split pattern of this kind of vocabulary (fixed value, as published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED_WORDS = 400_000
LONG_WORD = 64
_NONE = np.int32(2**31 - 1)
# Rows of a matrix of words.
_ROWS = 8_192


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a tokenizers file (its JSON text)."""

    def __init__(self, text: str):
        parsed = json.loads(text)
        self.bytes_of: dict[int, bytes] = {}
        characters = byte_characters()
        ids = parsed["model"]["vocab"]
        for token, number in ids.items():
            self.bytes_of[number] = bytes(characters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        for content, number in self.special.items():
            self.bytes_of[number] = content.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for character, byte in characters.items():
            self.byte_ids[byte] = ids[character]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parsed["model"]["merges"]]
        # A pair of ids as one number, in ascending order, with the rank and the merged id.
        self.radix = max(ids.values()) + 1
        merged = {ids[a] * self.radix + ids[b]: (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merges = merged
        ordered = sorted(merged)
        self.pair_keys = np.array([*ordered, np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(merged[k][0] for k in ordered), _NONE], np.int32)
        self.rank_ids = np.zeros(len(pairs), np.int32)
        for rank, number in merged.values():
            self.rank_ids[rank] = number

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids; none where one is negative or the pair does not merge."""
        keys = left.astype(np.int64) * self.radix + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """Ids of each word."""
    out: list[list[int]] = [[]] * len(words)
    by_length = defaultdict(list)
    for at, word in enumerate(words):
        by_length[len(word)].append(at)
    for length, places in by_length.items():
        if length > LONG_WORD:
            for at in places:
                out[at] = encode_long(vocabulary, words[at])
        elif length:
            for start in range(0, len(places), _ROWS):
                some = places[start : start + _ROWS]
                for at, ids in zip(some, _encode_matrix(vocabulary, [words[p] for p in some], length)):
                    out[at] = ids
    return out


def _encode_matrix(vocabulary: Vocabulary, words: list[bytes], length: int) -> list[list[int]]:
    """Words of equal length; parts move left when a boundary is deleted, so they stay contiguous."""
    parts = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)]
    n = len(words)
    # Two spare columns of "no part" keep every look to the right inside the matrix.
    parts = np.concatenate([parts, np.full((n, 2), -1, np.int32)], axis=1)
    ranks = np.full((n, length + 1), _NONE, np.int32)
    ranks[:, :length] = vocabulary.ranks(parts[:, :length], parts[:, 1 : length + 1])
    columns = np.arange(length + 1)[None, :]
    active = np.arange(n)
    while True:
        at = ranks[active].argmin(axis=1)
        least = ranks[active, at]
        going = least < _NONE
        active, at, least = active[going], at[going], least[going]
        if not len(active):
            break
        # The boundary behind part `at` is deleted: everything further right moves by one.
        source = columns + (columns > at[:, None])
        moved_parts = np.take_along_axis(parts[active], source, axis=1)
        moved_ranks = np.take_along_axis(ranks[active], np.minimum(source, length), axis=1)
        rows = np.arange(len(active))
        moved_parts[rows, at] = vocabulary.rank_ids[least]
        right = np.where(at + 1 <= length, moved_parts[rows, np.minimum(at + 1, length)], -1)
        moved_ranks[rows, at] = vocabulary.ranks(moved_parts[rows, at], right)
        before = np.maximum(at - 1, 0)
        refreshed = vocabulary.ranks(moved_parts[rows, before], moved_parts[rows, at])
        moved_ranks[rows, before] = np.where(at > 0, refreshed, moved_ranks[rows, before])
        parts[active, : length + 1] = moved_parts
        ranks[active] = moved_ranks
    return [row[: int(k)].tolist() for row, k in zip(parts, (parts >= 0).sum(axis=1))]


def encode_long(vocabulary: Vocabulary, word: bytes) -> list[int]:
    """The same merges by a heap of (rank, place), for words that a scan would take long for."""
    parts = vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    n = len(parts)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    merges, radix = vocabulary.merges, vocabulary.radix

    def rank(at: int):
        right = following[at]
        return merges.get(parts[at] * radix + parts[right]) if right < n else None

    heap = [(found[0], at, parts[at], parts[at + 1]) for at in range(n - 1) if (found := rank(at))]
    heapq.heapify(heap)
    while heap:
        _, at, left, right_part = heapq.heappop(heap)
        right = following[at]
        if parts[at] != left or right >= n or parts[right] != right_part:
            continue
        parts[at], parts[right] = merges[left * radix + right_part][1], -1
        following[at] = following[right]
        if following[right] < n:
            previous[following[right]] = at
        for place in (at, previous[at]):
            if place >= 0 and (found := rank(place)):
                heapq.heappush(heap, (found[0], place, parts[place], parts[following[place]]))
    return [p for p in parts if p >= 0]


class Encoder:
    """Encodes texts, remembering words."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.split = regex.compile(PATTERN).findall
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.ids: dict[str, np.ndarray] = {}
        self.digits: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        for known in (self.ids, self.digits, self.decoded):
            known.clear()
        for content, number in self.vocabulary.special.items():
            self._remember(content, [number])

    def _remember(self, word: str, ids: list[int]) -> None:
        self.ids[word] = np.array(ids, np.int32).tobytes()
        self.digits[word] = ",".join(map(str, ids))
        self.decoded[word] = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.split(part))]

    def learn(self, pieces: list[list[str]]) -> None:
        """Encode the words that are not remembered."""
        new = list(set().union(*pieces) - self.ids.keys())
        if len(self.ids) + len(new) > REMEMBERED_WORDS:
            self.forget()
            new = list(set().union(*pieces) - self.ids.keys())
        for word, ids in zip(new, encode_words(self.vocabulary, [w.encode("utf-8", "replace") for w in new])):
            self._remember(word, ids)


@lru_cache(maxsize=1)
def _encoder(text: str) -> Encoder:
    return Encoder(text)


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file for all tasks; its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256`` of the comma-joined ids and ``decoded_sha256`` of the decoded text."""
    vocabulary = share_file(docs.sparkSession, path)
    rows = packed(docs).selectExpr(f"row.`{id_column}` AS id", f"row.`{text_column}` AS text")

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(vocabulary.value)
        pieces = [encoder.pieces(t) for t in _texts(batch)]
        encoder.learn(pieces)
        digits, decoded = encoder.digits.__getitem__, encoder.decoded.__getitem__
        counts, ids_hashes, text_hashes = [], [], []
        for words in pieces:
            ids = ",".join(map(digits, words))
            counts.append(ids.count(",") + 1 if ids else 0)
            ids_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
            text = b"".join(map(decoded, words)).decode("utf-8", "replace")
            text_hashes.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_hashes), pa.array(text_hashes)],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = dict(rows.dtypes)["id"]
    return map_batches(rows, encoded, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``ids`` (array<int>) and ``round_trip``, whether the ids decode to the text."""
    vocabulary = share_file(docs.sparkSession, path)
    rows = packed(docs).selectExpr(f"row.`{id_column}` AS id", f"row.`{text_column}` AS text")

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(vocabulary.value)
        texts = _texts(batch)
        pieces = [encoder.pieces(t) for t in texts]
        encoder.learn(pieces)
        ids = [b"".join(map(encoder.ids.__getitem__, words)) for words in pieces]
        same = [b"".join(map(encoder.decoded.__getitem__, w)) == t.encode("utf-8", "replace") for w, t in zip(pieces, texts)]
        return pa.RecordBatch.from_arrays([batch.column("id"), id_lists(ids), pa.array(same)], ["id", "ids", "round_trip"])

    return map_batches(rows, encoded, f"id {dict(rows.dtypes)['id']}, ids array<int>, round_trip boolean")


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """One list of 32-bit numbers for each string of their bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decode(tokens: DataFrame, path: str, id_column: str = "id", ids_column: str = "ids") -> DataFrame:
    """``id`` and ``text`` of encoded documents; bytes that are no UTF-8 become the replacement character."""
    vocabulary = share_file(tokens.sparkSession, path)
    rows = packed(tokens).selectExpr(f"row.`{id_column}` AS id", f"row.`{ids_column}` AS ids")

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        bytes_of = _encoder(vocabulary.value).vocabulary.bytes_of.__getitem__
        texts = [b"".join(map(bytes_of, ids or ())).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return map_batches(rows, decoded, f"id {dict(rows.dtypes)['id']}, text string")
