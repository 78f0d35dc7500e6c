"""The conversation trie against prefixes kept in a dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lapwise.llm import prefix_trie
from lapwise.session import cut

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 string, pos string, ends string, row string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def _digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _ordered(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, _digest(role, text), (role, text)))
    return {c: [t[3] for t in sorted(v)] for c, v in own.items()}


def _nodes(paths):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for n in range(len(paths[c]) + 1):
            members[tuple(paths[c][:n])].append(c)
        ends[tuple(paths[c])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for n in range(len(p) + 1):
            leaves[p[:n]] += children[p] == 0
            saved[p[:n]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def _found(nodes):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in (tuple(x) for x in nodes.collect()))


def _conversations(rng, n, turns):
    rows = []
    for c in range(n):
        texts = [f"{rng.choice('ab')} é" for _ in range(rng.randrange(turns))]
        rows += [(c * 3 - 40, t, rng.choice(["user", "user", None]), x) for t, x in enumerate(texts)]
    return rows


@pytest.mark.parametrize(("conversations", "turns"), [(1024, 64), (8, 2)])
def test_trie(spark, monkeypatch, conversations, turns):
    monkeypatch.setattr(prefix_trie, "CELL_CONVERSATIONS", conversations)
    monkeypatch.setattr(prefix_trie, "CELL_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "SLICE", 3)
    rows = _conversations(random.Random(13), 60, 8)
    # many copies of one conversation, and one that is much longer
    rows += [(500 + c, t, "user", f"same {t}") for c in range(40) for t in range(3)]
    rows += [(900, t, "user", f"turn {t % 2}") for t in range(150)] + [(901, t, "user", f"turn {t % 2}") for t in range(131)]
    found = prefix_trie.prefix_trie(_table(spark, rows))
    assert _found(found) == _nodes(_ordered(rows))


def test_grafted_heads(spark):
    rows = _conversations(random.Random(5), 50, 12)
    head, source = F.pmod(F.col("conv_id"), F.lit(7)), F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(4))
    numbered = cut(prefix_trie.turns(_table(spark, rows)), "test-turns")
    own = _ordered(rows)
    paths = {c: own.get(c - c % 4, [])[: c % 7] + own[c][c % 7 :] for c in own}
    assert _found(prefix_trie.trie(prefix_trie.grafted(numbered, head, source, 6))) == _nodes(paths)


def test_odd_conversations(spark):
    """Nulls in any column, equal turn numbers, repeated rows, a very long text, roles and texts that run together."""
    rows = [
        (1, None, None, None), (1, None, "", ""), (1, 2, "user", "x" * 200_000), (2, 1, "us", "ertext"), (3, 1, "user", "text"),
        (4, 1, "user", "b"), (4, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", "b"), (6, 1, "user", "a"), (6, 1, "user", "a"),
        (None, 1, "user", "a"), (None, None, None, None), (2**62, 1, "user", "a"), (-7, 0, "user", "a"),
    ]
    assert _found(prefix_trie.prefix_trie(_table(spark, rows))) == _nodes(_ordered(rows))
    assert prefix_trie.prefix_trie(_table(spark, [])).count() == 0
    only_null = [(None, 1, "user", "a")]
    assert prefix_trie.prefix_trie(_table(spark, only_null)).count() == 0
