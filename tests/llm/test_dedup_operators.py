"""Line, near-duplicate and substring removal against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from lapwise.llm import golay, simhash, substring_dedup
from lapwise.llm.components import components
from lapwise.llm.line_dedup import line_dedup


def _kept(df):
    return {r["doc_id"]: (r["kept"], r["n_lines"], r["n_removed"]) for r in df.select("row.doc_id", "kept", "n_lines", "n_removed").collect()}


def test_lines(spark, sf_dir):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " "]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(brute.ODD_TEXTS)]
    assert _kept(line_dedup(brute.documents(spark, rows))) == brute.line_dedup(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert _kept(line_dedup(docs)) == brute.line_dedup(rows)


def test_every_line_stays_somewhere(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(str(rng.randint(0, 8)) for _ in range(10))) for i in range(40)]
    kept = _kept(line_dedup(brute.documents(spark, rows)))
    before = {x for _, t in rows for x in t.split("\n")}
    assert {x for t, _, _ in kept.values() for x in t.split("\n")} >= before
    assert sum(n for _, _, n in kept.values()) > 0


def test_windows_and_words_are_parameters(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    docs = brute.documents(spark, rows)
    removed = [sum(n for _, _, n in _kept(line_dedup(docs, window=w)).values()) for w in (2, 3, 5)]
    assert removed[0] > removed[1] > removed[2] > 0
    # one word makes a window: every line that stood earlier goes
    firsts = _kept(line_dedup(docs, long_words=1))
    assert sum(n - gone for _, n, gone in firsts.values()) == len({x for _, t in rows for x in t.split("\n") if x})


def test_lines_of_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = line_dedup(docs)
    assert found.count() == 18 and found.select("row.*").columns == docs.columns
    kept = found.where("row.doc_id IN (11, 12)").orderBy("row.doc_id").collect()
    assert [r["n_removed"] for r in kept] == [0, 4] and kept[1]["kept"] == ""
    assert found.where("row.text IS NULL AND kept IS NOT NULL").isEmpty()
    same = "l1\nl2\nl3\nl4"
    repeated = line_dedup(brute.documents(spark, [(5, same), (5, same), (6, same), (None, same)]))
    assert sorted((str(r["row"]["doc_id"]), r["n_removed"]) for r in repeated.collect()) == [("5", 4), ("5", 4), ("6", 4), ("None", 0)]
    assert line_dedup(brute.documents(spark, [])).count() == 0


def test_golay_code_is_perfect():
    words = np.arange(0, 1 << 23, 997, dtype=np.uint32)
    numbers = golay.index_of(words)
    for flip in (1 << 3, 1 << 11 | 1 << 22, 1 | 1 << 9 | 1 << 20):
        code = words.copy()
        # a code word decodes to itself, and so does any word within three bits of it
        corrected = code ^ golay._CORRECTIONS[golay._BYTES[0][code & 255] ^ golay._BYTES[1][code >> 8 & 255] ^ golay._BYTES[2][code >> 16]]
        assert (golay.index_of(corrected ^ np.uint32(flip)) == numbers).all()


def test_near_fingerprints_share_a_key():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        flips = np.zeros(len(values), np.uint64)
        for row in range(len(values)):
            for b in rng.choice(64, bits, replace=False):
                flips[row] |= np.uint64(1) << np.uint64(b)
        mine, theirs = golay.keys(values), golay.keys(values ^ flips)
        shared = set(zip(*map(np.ndarray.tolist, mine))) & set(zip(*map(np.ndarray.tolist, theirs)))
        assert {row for row, _ in shared} == set(range(len(values)))


@pytest.mark.parametrize("block_nodes", [simhash.BLOCK_NODES, 3])
def test_links_connect_all_near_nodes(spark, block_nodes):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    values = []
    for b in base:
        chain = b
        for _ in range(40):
            chain ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
            values += [chain, b ^ (np.uint64(1) << np.uint64(rng.integers(0, 64)))]
    values = np.unique(np.array(values, np.uint64))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fingerprint long")
    labels = {r["node"]: r["root"] for r in components(simhash.links(nodes, block_nodes)).collect()}
    found = [labels.get(int(v), int(v)) for v in values.view(np.int64)]
    expected = brute.groups(values)
    assert len(set(zip(found, expected))) == len(set(found)) == len(set(expected))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links + [(7, 7)], "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    values = [brute.simhash(t) for _, t in rows]
    expected = {i: (v, rows[g][0]) for (i, _), v, g in zip(rows, values, brute.groups(values))}
    found = simhash.near_duplicates(docs).collect()
    assert {r["id"]: (r["fingerprint"] % 2**64, r["component"]) for r in found} == expected
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == {c for _, c in expected.values()}


def test_near_duplicates_of_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_duplicates(docs).count() == 18
    assert found[0]["fingerprint"] == 0 and {found[i]["component"] for i in (0, 1, 2, 3)} == {0}
    assert found[11]["component"] == found[12]["component"] == 11
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(0) == 1 and not {1, 2, 3, 12} & set(ids) and {11, 50, None} <= set(ids)
    assert simhash.near_duplicates(brute.documents(spark, [])).count() == 0
    assert simhash.one_of_each(brute.documents(spark, [])).count() == 0
    only_null = simhash.near_duplicates(brute.documents(spark, [(None, "some words")])).collect()
    assert [r["component"] for r in only_null] == [None]


def _substrings(df):
    return sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize("hot_anchor", [substring_dedup.HOT_ANCHOR, 1])
def test_substrings(spark, hot_anchor):
    rng = random.Random(11)
    passage = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (49, 50, 51, 75, 120, 400)]
    texts = ["".join(rng.choice(passage + ["x", "yz "]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    # periodic and constant texts, overlapping repeats, whole copies
    texts += ["ab" * 60, "ab" * 40, "z" * 49, "z" * 50, "z" * 51, "z" * 300, passage[5], passage[5], passage[5][:-1]]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(40, 300))) for _ in range(30)]
    rows = list(enumerate(texts + brute.ODD_TEXTS))
    rng.shuffle(rows)
    docs = brute.documents(spark, rows).repartition(5)
    assert _substrings(substring_dedup.substring_dedup(docs, hot_anchor=hot_anchor)) == sorted(brute.substring_dedup(rows))


def test_substrings_of_odd_rows(spark):
    docs = brute.odd_documents(spark)
    found = substring_dedup.substring_dedup(docs).collect()
    assert len(found) == 18 and sum(r["id"] is None for r in found) == 2
    long = next(r for r in found if r["id"] == 50)
    assert (long["n_bytes"], long["n_removed"]) == (300_000, 0)  # repeats within a document stay
    text = "the same fifty bytes and some more of them, in all of these rows"
    rows = brute.documents(spark, [(4, text), (4, text), (4, text + "!"), (9, text), (None, text), (None, "?" + text)])
    shown = sorted((str(r["id"]), r["n_removed"], r["n_spans"]) for r in substring_dedup.substring_dedup(rows).collect())
    n = len(text)
    assert shown == [("4", 0, 0), ("4", 0, 0), ("4", 0, 0), ("9", n, 1), ("None", n, 1), ("None", n, 1)]
    assert substring_dedup.substring_dedup(brute.documents(spark, [])).count() == 0


def test_anchors_over_several_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    whole = substring_dedup.Anchors(texts)
    monkeypatch.setattr(substring_dedup, "_PIECE", 257)
    parts = substring_dedup.Anchors(texts)
    for name in ("place", "hash", "first", "last", "row"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_column_rounds_equal_plain_comparison():
    rng = np.random.default_rng(3)
    strings = rng.integers(97, 99, (200, substring_dedup.COLUMNS), dtype=np.uint8)
    strings[50:150] = strings[rng.integers(0, 20, 100)]
    strings[100:150, 60:] = 1
    ids = rng.integers(0, 60, 200)
    first, last = rng.integers(0, 10, 200), rng.integers(10, substring_dedup.STRINGS, 200)
    flags = substring_dedup.repeated(strings, first, last, ids)
    least = {}
    for r in range(200):
        for o in range(first[r], last[r] + 1):
            key = (o, strings[r, o : o + 50].tobytes())
            least[key] = min(least.get(key, 10**9), ids[r])
    for r in range(200):
        for o in range(substring_dedup.STRINGS):
            expected = first[r] <= o <= last[r] and least[(o, strings[r, o : o + 50].tobytes())] < ids[r]
            assert flags[r, o] == expected
