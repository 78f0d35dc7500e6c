"""Removal of repeated runs of lines, by winnowing over line hashes.

Lines without a word are looked over.  A window is a stretch of three lines, or of
one or two with ``LONG_WORDS`` words.  The smallest line hash of a window (the last
of equal ones) is its fingerprint, so two places that have the same window have the
same fingerprint, and neighbouring windows mostly share theirs.

Positions are joined in two steps.  Of the fingerprints only those go on that stand
in two places: one aggregation over the fingerprints, and a join with what it leaves.
From such a fingerprint a match is extended to both ends of each window that chose
it, by the hash of the lines before and after it; one aggregation per fingerprint and
neighbourhood gives the first place, and every later place is joined with that one.
So any earlier place counts, whatever its context, and places are never paired with
each other.  A match that goes on meets the windows further on, each with its own
fingerprint, so the united windows reach to both ends of it.

A later place of a window is deleted.  Places are ordered by id, text hash and line.
The first place of any line is never deleted: a window over it that stood earlier
would be an earlier place of the line.  So every text stays in the corpus.

A window is known by 64 bits of its fingerprint and 64 of all its lines, hashed
apart.  Null and empty texts have no lines and stay as they are.  Rows with equal id
and equal text count as one place: both stay or lose the same lines.  Rows with equal
ids and different texts, and rows with null ids (first in order), are told apart
by the hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.binding import let
from lapwise.llm.rows import packed, text_of, words
from lapwise.session import cut

WINDOW = 3
# Words that make a window of fewer lines.
LONG_WORDS = 50
_RUNS = "array<struct<first:int,last:int>>"


def worded_lines(text: Column) -> Column:
    """Array of (line, text) of the lines with a word; ``line`` counts all lines from 0."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    return F.filter(lines, lambda x: x["text"].rlike(r"[^\x20\x09-\x0D]"))


def _windows(text: Column, window: int, long_words: int) -> Column:
    """Array of (gram, gram_at, first, size, around) of all windows; places count the lines with a word."""
    hashed = F.transform(
        worded_lines(text),
        lambda x: F.struct(
            F.xxhash64(x["text"]).alias("hash"),
            F.xxhash64(F.lit(1), x["text"]).alias("other"),
            F.size(words(x["text"])).alias("n_words"),
        ),
    )

    def of(lines: Column) -> Column:
        def at(first: Column, size: int) -> Column:
            parts = [F.get(lines, first + k) for k in range(size)]
            enough = F.lit(True) if size == window else sum((p["n_words"] for p in parts[1:]), parts[0]["n_words"]) >= long_words
            marks = [F.struct(p["hash"].alias("hash"), (-(first + k)).alias("minus_at")) for k, p in enumerate(parts)]
            least = F.array_min(F.array(*marks))
            found = F.struct(
                least["hash"].alias("gram"),
                (-least["minus_at"]).alias("gram_at"),
                first.alias("first"),
                F.lit(size).alias("size"),
                F.xxhash64(*[p["other"] for p in parts]).alias("around"),
            )
            return F.when((first + size <= F.size(lines)) & enough, found)

        firsts = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: i < F.size(lines))
        return F.flatten(F.transform(firsts, lambda i: F.array_compact(F.array(*[at(i, n) for n in range(1, window + 1)]))))

    return let(hashed, of)


def windows(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """One row per document with lines: ``id``, ``text_hash`` and its ``windows``."""
    text = text_of(F.col(f"row.{text_column}"))
    found = packed(docs).select(
        F.col(f"row.{id_column}").alias("id"), F.xxhash64(text).alias("text_hash"), _windows(text, window, long_words).alias("windows")
    )
    return found.where(F.size("windows") > 0)


def repeated_fingerprints(found: DataFrame) -> DataFrame:
    """Fingerprints (``gram``) that stand in two places."""
    chosen = F.array_distinct(F.transform("windows", lambda w: F.struct(w["gram"].alias("gram"), w["gram_at"].alias("at"))))
    prints = found.select("id", "text_hash", F.explode(chosen).alias("print"))
    place = F.struct("id", "text_hash", F.col("print.at").alias("at"))
    places = prints.groupBy(F.col("print.gram").alias("gram")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    return places.where(F.col("first") != F.col("last")).select("gram")


def repeated_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """Windows that an earlier place has: ``id``, ``text_hash`` and ``runs``, a sorted array of (first, last) lines with a word."""
    found = windows(docs, id_column, text_column, window, long_words)
    extended = found.select("id", "text_hash", F.inline("windows")).join(repeated_fingerprints(found), "gram", "left_semi")
    # Both the first places and the later ones are taken from it.
    extended = cut(
        extended.select("gram", "around", "size", F.struct("id", "text_hash", F.col("first").alias("at")).alias("place")), "line-matches"
    )
    match = ["gram", "around", "size"]
    firsts = (
        extended.groupBy(*match)
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    later = extended.join(firsts, match).where(F.col("place") > F.col("first"))
    run = F.struct(F.col("place.at").alias("first"), (F.col("place.at") + F.col("size") - 1).alias("last"))
    return later.groupBy(F.col("place.id").alias("id"), F.col("place.text_hash").alias("text_hash")).agg(
        F.sort_array(F.collect_set(run)).alias("runs")
    )


def united(runs: Column) -> Column:
    """Sorted runs, of which those that overlap or touch become one."""
    empty = F.array().cast(_RUNS)

    def unite(done: Column, run: Column) -> Column:
        previous = F.get(done, F.size(done) - 1)
        joined = F.struct(previous["first"].alias("first"), F.greatest(previous["last"], run["last"]).alias("last"))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(
            (F.size(done) > 0) & (run["first"] <= previous["last"] + 1), F.concat(head, F.array(joined))
        ).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, empty, unite)


def line_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, long_words: int = LONG_WORDS
) -> DataFrame:
    """Every row as ``row`` with ``kept`` text and counts ``n_lines``, ``n_removed`` (lines with a word), ``n_spans``.

    A null text stays null.
    """
    runs = repeated_runs(docs, id_column, text_column, window, long_words).withColumn("runs", united(F.col("runs")))
    return without_runs(docs, runs, id_column, text_column)


def without_runs(docs: DataFrame, runs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``line_dedup``, with the given ``runs``, which do not overlap, to delete."""
    text = text_of(F.col(f"row.{text_column}"))
    rows = packed(docs).withColumn("id", F.col(f"row.{id_column}")).withColumn("text_hash", F.xxhash64(text))
    runs = runs.withColumnsRenamed({"id": "run_id", "text_hash": "run_hash"})
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("text_hash") == F.col("run_hash")), "left")

    def cut_out(spans: Column) -> Column:
        def without(lines: Column) -> Column:
            # Places in the whole text of the lines to delete.
            gone = F.flatten(
                F.transform(spans, lambda s: F.transform(F.slice(lines, s["first"] + 1, s["last"] - s["first"] + 1), lambda x: x["line"]))
            )
            kept = let(gone, lambda g: _lines_but(text, g))
            return F.struct(
                F.size(lines).cast("bigint").alias("n_lines"),
                F.size(gone).cast("bigint").alias("n_removed"),
                F.size(spans).cast("bigint").alias("n_spans"),
                F.when(F.size(spans) > 0, kept).otherwise(F.col(f"row.{text_column}")).alias("kept"),
            )

        return let(worded_lines(text), without)

    return joined.select("row", F.inline(F.array(let(F.coalesce("runs", F.array().cast(_RUNS)), cut_out))))


def _lines_but(text: Column, gone: Column) -> Column:
    """The text without the lines at these places (in ascending order)."""
    lines = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return let(lines, lambda x: F.array_join(F.transform(places, lambda i: F.get(x, i)), "\n"))
