"""Spelling variants: words one edit apart, each led to the most frequent form of its neighbourhood.

Words are counted over all documents first; from then on there is one row per
word.  Two words are near if one inserted, deleted or replaced letter turns one
into the other.  A pair is looked for in lists that share a part of the word: of
a shorter length ``s``, the edit lies either behind the first half of ``s``
letters, which both words begin with, or before the last half, which both end
with.  Every word is dealt to the lists of its own length and of the next smaller
one.  A list of more than ``LIST_WORDS`` words is dealt again by a half of what
is left, as often as needed; lists with one open letter have 8,190 words at most,
so lists are bounded whatever the vocabulary, and none is cut off.  The place of
a pair's first difference decides for one list, so that each pair is found once.

In a task a list is sorted, and every word scans it with a banded edit matrix: of
each row three cells are kept, the rows of the letters that a list word shares
with the one before are used again, and where a row is above one edit all list
words with that beginning are skipped (:func:`scan`).

Null texts have no words and a null id is an empty one; repeated rows count each
time.  Words of equal frequency are ordered by code points.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lapwise.llm.arrow import bound_batches
from lapwise.llm.rows import packed
from lapwise.session import cut

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form is so many times as frequent as its variant.
TIMES = 10
# One in so many runs loses a letter, by the hash of its document and letters.
DAMAGED = 31
# Words of one list.
LIST_WORDS = 16_384
# Words counted in a task before the counts are passed on, and letters read at a time.
COUNTED_WORDS = 300_000
PIECE = 1 << 20
# Words of the lists scanned together.
SCANNED_WORDS = 1 << 16
# Words of the keyed lists in one task.
TASK_WORDS = 150_000

# Latin-1 bytes: letters as they are, A-Z in lower case, all else as a gap.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def _pieces(text: str) -> Iterator[bytes]:
    """The text as Latin-1 letters and gaps, in pieces that end at a gap."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].encode("latin-1", "replace").translate(_LETTERS)
        end = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        yield piece[:end]
        rest = piece[end:]


def count_words(doc_id: str, text: str, totals: dict[bytes, int]) -> None:
    """Add the words (Latin-1) of a text to ``totals``, each run damaged as its hash says."""
    start = crc32(doc_id.encode() + b":")
    for piece in _pieces(text):
        for run, n in Counter([w for w in piece.split() if len(w) >= LEAST_LETTERS]).items():
            h = crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DAMAGED == 0:
                place = h % len(run)
                run = run[:place] + run[place + 1 :]
                if len(run) < LEAST_LETTERS:
                    continue
            totals[run] = totals.get(run, 0) + n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[bytes, int] = {}
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if text:
                count_words(doc_id or "", text, totals)
            if len(totals) >= COUNTED_WORDS:
                yield _count_rows(totals)
                totals = {}
    yield _count_rows(totals)


def _count_rows(totals: dict[bytes, int]) -> pa.RecordBatch:
    words = pa.array([w.decode("latin-1") for w in totals], pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(totals.values()), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words of at least ``LEAST_LETTERS`` letters that occur ``LEAST_COUNT`` times or more."""
    bound_batches(docs.sparkSession)
    rows = packed(docs).select(
        F.col(f"row.{id_column}").cast("string").alias("id"), F.col(f"row.{text_column}").alias("text")
    )
    counted = rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


KEY = ("s", "lo", "back", "below", "prefix", "suffix")


def _dealt(word: Column, s: Column, lo: Column, back: Column, below: Column) -> list[Column]:
    """The two lists by which a pair with shorter length ``s`` is found; ``below`` bounds its first difference."""
    half = F.floor((s - lo - back) / 2).cast("int")

    def one(lo: Column, back: Column, below: Column) -> Column:
        parts = (s, lo, back, below, F.left(word, lo), F.right(word, back))
        return F.struct(*[p.alias(name) for p, name in zip(parts, KEY)])

    return [one(lo + half, back, below), one(lo, back + half, F.least(below, lo + half))]


def lists(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """Rows (``s``, ``lo``, ``back``, ``below``, ``prefix``, ``suffix``, ``word``, ``n``) dealt to lists of bounded size."""
    zero, length = F.lit(0), F.length("word")
    own = [key for s in (length, length - 1) for key in _dealt(F.col("word"), s, zero, zero, s + 1)]
    dealt = cut(words.select("word", "n", F.explode(F.array(*own)).alias("key")).select("key.*", "word", "n"), "spelling-lists")
    done = []
    while True:
        # Lists with one open letter stay as they are: their size is bounded by the letters there are.
        open_letters = F.col("s") - F.col("lo") - F.col("back")
        large = dealt.where(open_letters > 1).groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > list_words)
        large = cut(large.drop("size"), "spelling-large")
        if large.isEmpty():
            return _united([*done, dealt])
        done.append(dealt.join(large, list(KEY), "left_anti").select(*KEY, "word", "n"))
        again = F.explode(F.array(*_dealt(F.col("word"), *(F.col(c) for c in KEY[:4])))).alias("key")
        dealt = cut(dealt.join(large, list(KEY)).select("word", "n", again).select("key.*", "word", "n"), "spelling-lists")


def _united(parts: list[DataFrame]) -> DataFrame:
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


class SortedLists:
    """Lists of open parts (the letters between prefix and suffix), sorted within each list."""

    def __init__(self, zones: list[bytes], starts: np.ndarray):
        n, width = len(zones), max((len(z) for z in zones), default=0) + 1
        joined = np.array(zones, dtype=f"S{width}")
        self.codes = joined.view(np.uint8).reshape(n, width)
        self.sizes = np.array([len(z) for z in zones], np.int64)
        self.first = np.zeros(n, bool)
        self.first[starts] = True
        # Letters shared with the list word before.
        differs = np.ones((n, width), bool)
        if n > 1:
            differs[1:] = self.codes[1:] != self.codes[:-1]
        differs[:, -1] = True
        self.shared = np.where(self.first, 0, np.minimum(differs.argmax(axis=1), self.sizes)).astype(np.int64)
        ends = np.append(starts[1:], n)
        self.start = np.repeat(starts, ends - starts)
        self.end = np.repeat(ends, ends - starts)
        # Behind list word i: the next one that does not share its first d + 1 letters, or the list's end.
        places = np.arange(n)
        self.behind = np.empty((n, width), np.int64)
        for d in range(width):
            at = np.where(self.first | (self.shared <= d), places, n)
            following = np.append(np.minimum.accumulate(at[::-1])[::-1], n)[1:]
            self.behind[:, d] = np.minimum(following, self.end)


def scan(lists: SortedLists, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking, found) of places one edit apart; every place of ``asking`` scans its own list.

    All asking words move in step, each with its own place in its list and its
    own rows: cell ``k`` of row ``d`` is the edits between the first ``d``
    letters of the list word and the first ``d + k - 1`` of the asking one.
    """
    n, width = lists.codes.shape
    if not len(asking):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Letters of the asking words with one place before and two behind that match nothing.
    own = np.zeros((len(asking), width + 4), np.uint8)
    own[:, 1 : width + 1] = lists.codes[asking]
    sizes = lists.sizes[asking]
    rows = np.full((len(asking), width + 1, 3), 2, np.uint8)
    rows[:, 0, 1], rows[:, 0, 2] = 0, 1
    moving = np.arange(len(asking))
    at, end, depth = lists.start[asking].copy(), lists.end[asking], np.zeros(len(asking), np.int64)
    found_by, found = [], []
    while len(moving):
        i, d = at[moving], depth[moving]
        whole = d == lists.sizes[i]
        if whole.any():
            who, place = moving[whole], i[whole]
            cell = sizes[who] - d[whole] + 1
            near = (cell >= 0) & (cell <= 2)
            near[near] = rows[who[near], d[whole][near], cell[near]] == 1
            found_by.append(who[near])
            found.append(place[near])
            at[who] = place + 1
            going = ~whole
            who, i, d = moving[going], i[going], d[going]
        else:
            who = moving
        if len(who):
            letter = lists.codes[i, d]
            before = rows[who, d]
            p0, p1, p2 = before[:, 0], before[:, 1], before[:, 2]
            # own is shifted by one: letters d - 1, d and d + 1 of the asking word.
            c0 = np.minimum(p0 + (own[who, d] != letter), p1 + 1)
            c1 = np.minimum(np.minimum(p1 + (own[who, d + 1] != letter), p2 + 1), c0 + 1)
            c2 = np.minimum(p2 + (own[who, d + 2] != letter), c1 + 1)
            open_ = (c0 <= 1) | (c1 <= 1) | (c2 <= 1)
            on = who[open_]
            below = d[open_] + 1
            rows[on, below, 0] = np.minimum(c0[open_], 2)
            rows[on, below, 1] = np.minimum(c1[open_], 2)
            rows[on, below, 2] = np.minimum(c2[open_], 2)
            depth[on] = below
            shut = ~open_
            at[who[shut]] = lists.behind[i[shut], d[shut]]
            moved = np.concatenate([moving[whole], who[shut]]) if whole.any() else who[shut]
        else:
            moved = moving
        left = at[moved] < end[moved]
        going_on = moved[left]
        depth[going_on] = lists.shared[at[going_on]]
        if not left.all():
            at_end = np.zeros(len(asking), bool)
            at_end[moved[~left]] = True
            moving = moving[~at_end[moving]]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return asking[np.concatenate(found_by)], np.concatenate(found)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the whole lists of a sorted partition: per word their number and the best of them."""
    carried: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carried = table if carried is None else pa.concat_tables([carried, table])
        if carried.num_rows >= SCANNED_WORDS:
            starts = _list_starts(carried)
            if len(starts) > 1:
                whole = int(starts[-1])
                yield _near_rows(carried.slice(0, whole), starts[:-1])
                carried = carried.slice(whole).combine_chunks()
    if carried is not None and carried.num_rows:
        yield _near_rows(carried, _list_starts(carried))


def _list_starts(table: pa.Table) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for name in KEY:
        column = table.column(name).combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.nonzero(changed)[0]


def _near_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    s, lo, back, below = (table.column(c).to_numpy().astype(np.int64) for c in KEY[:4])
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n = table.column("n").to_numpy()
    zones = [w[a : len(w) - b] for w, a, b in zip(words, lo.tolist(), back.tolist())]
    groups = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    width = max(map(len, zones), default=0) + 1
    order = np.lexsort((np.array(zones, dtype=f"S{width}"), groups))
    zones = [zones[i] for i in order]
    lists = SortedLists(zones, starts)
    shorter = np.nonzero(lists.sizes == (s - lo - back))[0]  # s, lo and back are the same for a whole list
    a, b = scan(lists, shorter)
    if len(a):
        differs = lists.codes[a] != lists.codes[b]
        # The place of the first difference decides for one list.
        own = lo[a] + differs.argmax(axis=1) < below[a]
        a, b = a[own], b[own]
    # A longer word does not ask itself: it is found by the shorter one.
    longer = lists.sizes[b] > lists.sizes[a]
    words_of, near = order[np.concatenate([a, b[longer]])], order[np.concatenate([b, a[longer]])]
    return _best(words, n, words_of, near)


def _best(words: list[bytes], n: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    names = ["word", "n_near", "best_n", "best"]
    rank = np.empty(len(words), np.int64)
    width = max(map(len, words), default=1) or 1
    rank[np.argsort(np.array(words, dtype=f"S{width}"), kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.nonzero(np.diff(of, prepend=-1))[0]
    counts = np.diff(np.append(first, len(of)))
    text = lambda places: pa.array([words[i].decode("latin-1") for i in places.tolist()], pa.string())
    columns = [text(of[first]), pa.array(counts, pa.int64()), pa.array(n[near[first]], pa.int64()), text(near[first])]
    return pa.RecordBatch.from_arrays(columns, names)


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words one edit away) and ``best``, the most frequent of them, with its ``best_n``."""
    dealt = cut(lists(words, list_words), "spelling-dealt")
    spark = words.sparkSession
    bound_batches(spark)
    # Scanning costs far more than reading: tasks are counted by words, not by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // TASK_WORDS))
    sorted_lists = dealt.repartition(tasks, *KEY).sortWithinPartitions(*KEY)
    found = sorted_lists.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    none = F.lit(None)
    alone = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), none.cast("bigint").alias("best_n"), none.cast("string").alias("best"))
    every = alone.unionByName(found.withColumn("n", none.cast("bigint")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("b")
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best).select(
        "word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def last_forms(links: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms of ``links`` (``word``, ``form``) lead in the end.

    Every round doubles the steps followed.  A form is ten times as frequent as
    its variant, so there are no circles and five rounds reach any root.
    """
    followed = cut(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = followed.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        longer = cut(followed.join(onward, "root", "left").select("word", "root", "onward"), "spelling-roots")
        moved = longer.select("word", F.coalesce("onward", "root").alias("root"))
        if longer.where("onward IS NOT NULL").isEmpty():
            return moved
        followed = moved


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", list_words: int = LIST_WORDS) -> DataFrame:
    """Every word with its ``form`` (null without one), ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = cut(vocabulary(docs, id_column, text_column), "spelling-words")
    led = F.col("best_n") >= TIMES * F.col("n")
    judged = near_words(words, list_words).select(
        "word", F.when(led, F.col("best")).alias("form"), "n", "n_near", F.when(led, F.col("best_n")).alias("form_n")
    )
    judged = cut(judged, "spelling-judged")
    roots = last_forms(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
