"""Spelling variants against all single edits of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from lapwise.llm import spelling


def _vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def _edits(word, letters):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for a in letters:
            yield word[:i] + a + word[i:]
            if i < len(word):
                yield word[:i] + a + word[i + 1 :]


def _variants(words):
    letters = {c for w in words for c in w}
    near = {w: {e for e in _edits(w, letters) if e in words and e != w} for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def _texts(rng, n):
    """Texts with frequent words, their damaged forms, and forms of those."""
    stems = ["".join(rng.choice("abcdéñ") for _ in range(rng.choice([6, 7, 8, 9, 12]))) for _ in range(40)]
    pool = []
    for stem in stems:
        pool += [stem.upper() if rng.random() < 0.2 else stem] * rng.choice([2, 30, 400])
        for _ in range(6):
            pool += [rng.choice(list(_edits(stem, "abcdéñ")))] * rng.choice([2, 3, 30])
    rng.shuffle(pool)
    return [(i, rng.choice([" ", "1", "·", "\n"]).join(pool[i::n])) for i in range(n)]


@pytest.mark.parametrize("list_words", [spelling.LIST_WORDS, 5])
def test_spelling_variants(spark, list_words):
    rows = _texts(random.Random(11), 17)
    found = spelling.spelling_variants(brute.documents(spark, rows), list_words=list_words)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _variants(_vocabulary(rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_odd_documents(spark):
    docs = brute.odd_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(7, "ordinary ordinary ordinarx ordinarx")]
    found = spelling.spelling_variants(docs.unionByName(docs.where("doc_id = 0").withColumns({"doc_id": F.lit(7).cast("long"), "text": F.lit(rows[-1][1])})))
    assert sorted((tuple(r) for r in found.collect()), key=str) == _variants(_vocabulary(rows))
    empty = spelling.spelling_variants(brute.documents(spark, []))
    assert empty.count() == 0


def test_scan_is_the_edit_distance():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 4, 5]))).encode() for _ in range(60)})
    lists = spelling.SortedLists(words, np.array([0]))
    asking, found = spelling.scan(lists, np.arange(len(words)))
    pairs = {(words[a], words[b]) for a, b in zip(asking, found)}
    edits = {(w, e) for w in words for e in (x.encode() for x in _edits(w.decode(), "ab")) if e in words and e != w}
    assert pairs == edits and len(asking) == len(pairs)


def test_lists_are_bounded_and_lose_no_pair(spark):
    """Words that all begin alike: the list is dealt again until each is small."""
    words = [("aaaaaaa" + a + b + c, 2) for a in "abcdef" for b in "abcdef" for c in "abcdef"]
    table = spark.createDataFrame(words, "word string, n long")
    dealt = spelling.lists(table, 50)
    open_letters = F.col("s") - F.col("lo") - F.col("back")
    assert dealt.where(open_letters > 1).groupBy(*spelling.KEY).count().where("count > 50").isEmpty()
    near = spelling.near_words(table, 50).collect()
    assert {r["n_near"] for r in near} == {15} and len(near) == len(words)


def test_pieces_end_at_gaps(monkeypatch):
    text = " ".join(["wordwordword", "éééééééé", "日本語", "another"] * 9)
    whole, cut = {}, {}
    spelling.count_words("1", text, whole)
    monkeypatch.setattr(spelling, "PIECE", 5)
    spelling.count_words("1", text, cut)
    assert whole == cut and len(whole) == 3


def test_roots_follow_all_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    found = spelling.last_forms(spark.createDataFrame(chain, "word string, form string"))
    assert {r["root"] for r in found.collect()} == {"w13"} and found.count() == 14
