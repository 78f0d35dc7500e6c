"""Token ids against the tokenizers library, and the token files."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from lapwise.llm import bpe, token_files

BYTE_FILE, WORD_FILE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def strange_texts():
    rng = random.Random(8)
    alphabet = list("abcdeé ñß\n\t 0123'sltvem.,!?") + [" ", " ", "́", "日", "🟠", "\x1c", "\x85", "Σ", "İ", "ſ", "ǆ", "٣", "²", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    words = ["don't", " WE'RE", "  ", "\n\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "hello", " world", "12345", "ΟΔΟΣ ", "'S"]
    return texts + ["".join(rng.choice(words) for _ in range(rng.randint(0, 20))) for _ in range(200)] + [t or "" for t in brute.ODD_TEXTS]


def test_byte_bpe_equals_the_library():
    library = Tokenizer.from_file(BYTE_FILE)
    with open(BYTE_FILE, encoding="utf-8") as file:
        encoder = bpe.Encoder(file.read())
    texts = strange_texts() + ["x" * 5000, "ab" * 700, "the cat " * 500 + "y" * 200]
    pieces = [encoder.pieces(t) for t in texts]
    encoder.learn(pieces)
    for text, words, expected in zip(texts, pieces, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(b"".join(map(encoder.ids.__getitem__, words)), np.int32).tolist()
        assert ids == expected.ids, text
        decoded = b"".join(map(encoder.decoded.__getitem__, words)).decode()
        assert decoded == library.decode(expected.ids, skip_special_tokens=False)


def test_long_words_merge_alike():
    with open(BYTE_FILE, encoding="utf-8") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = random.Random(1)
    words = [bytes(rng.choice(b"theranio ") for _ in range(rng.randint(1, 64))) for _ in range(300)]
    assert bpe.encode_words(vocabulary, words) == [bpe.encode_long(vocabulary, w) for w in words]
    assert bpe.encode_words(vocabulary, [b"", b"a"]) == [[], [64]]


def test_a_full_memory_changes_nothing(monkeypatch):
    with open(BYTE_FILE, encoding="utf-8") as file:
        text = file.read()
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 20)
    encoder, library = bpe.Encoder(text), Tokenizer.from_file(BYTE_FILE)
    for sample in strange_texts()[:50]:
        pieces = [encoder.pieces(sample)]
        encoder.learn(pieces)
        ids = np.frombuffer(b"".join(map(encoder.ids.__getitem__, pieces[0])), np.int32).tolist()
        assert ids == library.encode(sample, add_special_tokens=False).ids


def test_digests_and_round_trip(spark):
    docs = brute.odd_documents(spark)
    library = Tokenizer.from_file(BYTE_FILE)
    found = bpe.digests(docs, BYTE_FILE).collect()
    assert len(found) == 18
    by_id = {r["id"]: r for r in found if r["id"] not in (3, 4, None)}
    for i, text in list(enumerate(brute.ODD_TEXTS)) + [(50, "word " * 60_000)]:
        if i in by_id:
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert by_id[i]["n_tokens"] == len(ids)
            assert by_id[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert by_id[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, BYTE_FILE)
    assert encoded.where("NOT round_trip").isEmpty()
    texts = sorted((str(r["id"]), r["text"]) for r in bpe.decode(encoded, BYTE_FILE).collect())
    assert texts == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    empty = brute.documents(spark, [])
    assert bpe.digests(empty, BYTE_FILE).count() == bpe.encode(empty, BYTE_FILE).count() == 0


def test_bad_bytes_decode_to_the_replacement_character(spark):
    tokens = spark.createDataFrame([(1, [120, 64]), (2, []), (3, None)], "id long, ids array<int>")
    library = Tokenizer.from_file(BYTE_FILE)
    found = {r["id"]: r["text"] for r in bpe.decode(tokens, BYTE_FILE).collect()}
    assert found == {1: library.decode([120, 64]), 2: "", 3: ""}


def test_pieces_equal_whole_texts():
    library = Tokenizer.from_file(WORD_FILE)
    with open(WORD_FILE, encoding="utf-8") as file:
        encoder = token_files.PieceEncoder(file.read())
    texts = strange_texts()
    for text, ids, expected in zip(texts, encoder.encode(texts, 2), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == [*expected.ids, 2], text


def test_few_remembered_pieces_change_nothing(monkeypatch):
    library = Tokenizer.from_file(WORD_FILE)
    with open(WORD_FILE, encoding="utf-8") as file:
        text = file.read()
    monkeypatch.setattr(token_files, "REMEMBERED_PIECES", 15)
    monkeypatch.setattr(token_files, "TOGETHER", 7)
    encoder = token_files.PieceEncoder(text)
    for sample in strange_texts()[::3] + ["Words, words; and Words. more words! words", "words words, Words."]:
        expected = library.encode(sample, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([sample], 2)[0], "<u4").tolist() == [*expected, 2]


def _expected(rows):
    library, start = Tokenizer.from_file(WORD_FILE), 0
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        yield i, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def test_token_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5, "lang", "source")
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, WORD_FILE, path)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = sorted(tuple(r) for r in token_files.positions(spark, path).collect())
    assert found == list(_expected(rows))
    one = token_files.read_tokens(spark, path).where(F.col("doc_id") == 17)
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in one._jdf.queryExecution().toString()
    files = [f for f in os.listdir(path) if f.endswith(".orc")]
    assert sum(pyarrow.orc.ORCFile(f"{path}/{f}").nrows for f in files) == len(rows)


def test_token_files_of_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = sorted(token_files.token_files(docs, WORD_FILE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is not None, i))
    assert [r["start"] for r in found] == np.cumsum([0, *[r["n_tokens"] for r in found]])[:-1].tolist()
    empty = next(r for r in found if r["doc_id"] == 1)
    assert (empty["n_tokens"], empty["ids_crc32"]) == (1, zlib.crc32(b"\x02\0\0\0"))
    assert token_files.token_files(brute.documents(spark, []), WORD_FILE).count() == 0


def test_positions_of_a_file_read_in_splits(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, WORD_FILE, path)
    expected = sorted(tuple(r) for r in token_files.positions(spark, path).collect())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in keep:
            spark.conf.set(k, "20000")
        assert sorted(tuple(r) for r in token_files.positions(spark, path).collect()) == expected
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
