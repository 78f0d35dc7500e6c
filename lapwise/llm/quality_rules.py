"""Weak supervision of text quality: voting rules, their accuracies by expectation-maximisation, posteriors.

Every rule votes good (1) or bad (-1) on a document, or abstains (0).  A rule
has two unknown accuracies: how often its vote is right on good documents and
on bad ones.  Expectation-maximisation estimates them, and the share of good
documents, from the votes alone: votes are counted by pattern, and there are at
most ``3 ** len(RULES)`` patterns however large the corpus is.  The posterior
probability of a document is then a sum of log-odds of its votes.

Only DataFrame expressions touch the documents.  Texts are read once: metrics
and votes are written to the shared folder, the model is fitted on the pattern
counts and applied to what was written.

Null and empty texts have no words and fail the base rule.  Rows are judged one
by one, so repeated or null ids need no care.  Without any document the model is
the prior.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.binding import let
from lapwise.llm.rows import packed, text_of, words
from lapwise.session import cut

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
ITERATIONS = 50
# Where the estimation starts.  Rules are detectors of one fault each: they seldom vote bad on a good document, and
# each sees a part of the bad ones only.  The votes move the accuracies from there as far as they say.
START_GOOD, START_ON_GOOD, START_ON_BAD = 0.85, 0.95, 0.3
# Weight, in votes, of the start values.
PRIOR_VOTES = 10.0
KEEP_AT = 0.5

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_symbol_lines")


@dataclass(frozen=True)
class Rule:
    """Votes bad outside the tolerated range of a share, good inside the usual one, else abstains."""

    name: str
    part: str
    whole: str
    usual: tuple[float, float]
    tolerated: tuple[float, float]

    def vote(self) -> Column:
        share = F.col(f"m.{self.part}") / F.greatest(F.col(f"m.{self.whole}"), F.lit(1))
        return (
            F.when(F.col("m.n_words") == 0, F.lit(0))
            .when(~share.between(*self.tolerated), F.lit(-1))
            .when(share.between(*self.usual), F.lit(1))
            .otherwise(F.lit(0))
        )


def rules() -> list[Rule]:
    return [
        Rule("symbols", "n_symbols", "n_words", (0.0, 0.02), (0.0, 0.1)),
        Rule("symbol_chars", "n_symbols", "word_chars", (0.0, 0.005), (0.0, 0.03)),
        Rule("symbol_lines", "n_symbol_lines", "n_lines", (0.0, 0.1), (0.0, 0.5)),
        Rule("shouts", "n_shouts", "n_words", (0.0, 0.02), (0.0, 0.15)),
        Rule("capitals", "n_upper", "word_chars", (0.0, 0.08), (0.0, 0.3)),
        Rule("repeats", "n_repeat_words", "n_words", (0.0, 0.2), (0.0, 0.4)),
        Rule("lines", "n_dup_lines", "n_lines", (0.0, 0.0), (0.0, 0.5)),
        Rule("word_length", "word_chars", "n_words", (3.5, 9.0), (2.5, 14.0)),
        Rule("line_length", "n_words", "n_lines", (4.0, 400.0), (1.5, 1e9)),
    ]


def _repeated_words(w: Column) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows are compared by hash.  Where all differ the answer is 0; else they
    are sorted with their places, neighbours with equal hashes give the
    repeated places, and their three-word spans are added up without overlap.
    """
    n = F.size(w)
    later = F.zip_with(F.slice(w, 2, n), F.slice(w, 3, n), lambda b, c: F.struct(b.alias("b"), c.alias("c")))
    hashes = F.slice(F.zip_with(w, later, lambda a, x: F.xxhash64(a, x["b"], x["c"])), 1, F.greatest(n - 2, F.lit(0)))

    def places(sorted_windows: Column) -> Column:
        same = lambda x, i: F.get(sorted_windows, i)["h"].eqNullSafe(x["h"])
        hit = F.filter(sorted_windows, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def spans(at: Column) -> Column:
        new_words = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda p, following: F.least(F.lit(3), following - p))
        return F.aggregate(new_words, F.lit(0), lambda total, n_new: total + n_new)

    def count(h: Column) -> Column:
        windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(let(windows, places), spans)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated)

    return let(hashes, count)


def metrics(text: Column) -> Column:
    """A struct of counts of one text."""
    # One pass leaves the marks that are counted; there are few of them.
    marks = F.regexp_replace(text, r"[^A-Z!#*$%&|<>]+", "")
    only = lambda m, kind: F.length(F.regexp_replace(m, rf"[^{kind}]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda column, name: column.cast("bigint").alias(name)
    of_words = let(
        words(text),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeated_words(w).alias("repeated")),
    )
    with_symbol = lambda x: F.size(F.filter(x, lambda line: line.rlike(r"[#*$%&|<>]")))
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"), with_symbol(x).alias("with_symbol")
        ),
    )
    of_marks = let(
        marks,
        lambda m: F.struct(only(m, "#*$%&|<>").alias("symbols"), only(m, "A-Z").alias("upper"), only(m, "!").alias("shouts")),
    )
    parts = F.struct(of_words.alias("w"), of_lines.alias("l"), of_marks.alias("k"))
    return let(
        parts,
        lambda p: F.struct(
            counted(p["w"]["n"], "n_words"),
            counted(p["w"]["chars"], "word_chars"),
            counted(p["k"]["symbols"], "n_symbols"),
            counted(p["l"]["n"] - p["l"]["kinds"], "n_dup_lines"),
            counted(p["w"]["repeated"], "n_repeat_words"),
            counted(p["l"]["n"], "n_lines"),
            counted(p["k"]["upper"], "n_upper"),
            counted(p["k"]["shouts"], "n_shouts"),
            counted(p["l"]["with_symbol"], "n_symbol_lines"),
        ),
    )


def base_failed() -> Column:
    n = F.col("m.n_words")
    return (n < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > MOST_REPEATED_PERCENT * n)


def voted(docs: DataFrame, keep_rows: bool, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Metrics ``m`` and votes of every document, with its id or its whole row; written once."""
    rows = packed(docs)
    text = text_of(F.col(f"row.{text_column}"))
    carried = F.col("row") if keep_rows else F.struct(F.col(f"row.{id_column}").alias(id_column)).alias("row")
    # The generator keeps the metrics from being computed once for every use.
    measured = rows.select(carried, F.inline(F.array(F.struct(metrics(text).alias("m")))))
    votes = F.array(*[rule.vote() for rule in rules()]).alias("votes")
    return cut(measured.select("row", "m", votes), "quality-votes")


@dataclass(frozen=True)
class Model:
    """Share of good documents, and each rule's accuracy on good and on bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def evidence(self, rule: int, vote: int) -> float:
        """Log-odds that a vote adds for a good document."""
        right, wrong = self.on_good[rule], 1 - self.on_bad[rule]
        return math.log(right / wrong) if vote > 0 else math.log((1 - right) / (1 - wrong)) if vote < 0 else 0.0

    def posterior(self, pattern) -> float:
        odds = math.log(self.good / (1 - self.good)) + sum(self.evidence(j, v) for j, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, iterations: int = ITERATIONS) -> Model:
    """Expectation-maximisation over (vote pattern, count).

    ``PRIOR_VOTES`` votes at the start values stand for each share, so that none becomes 0 or 1.
    """
    share = lambda right, wrong, start: (right + PRIOR_VOTES * start) / (right + wrong + PRIOR_VOTES)
    total = sum(n for _, n in patterns)
    model = Model(START_GOOD, (START_ON_GOOD,) * n_rules, (START_ON_BAD,) * n_rules)
    for _ in range(iterations):
        weighted = [(votes, n * p, n * (1 - p)) for votes, n in patterns for p in (model.posterior(votes),)]
        on_good, on_bad = [], []
        for j in range(n_rules):
            for_good = [(good, bad) for votes, good, bad in weighted if votes[j] > 0]
            for_bad = [(good, bad) for votes, good, bad in weighted if votes[j] < 0]
            on_good.append(share(sum(g for g, _ in for_good), sum(g for g, _ in for_bad), START_ON_GOOD))
            on_bad.append(share(sum(b for _, b in for_bad), sum(b for _, b in for_good), START_ON_BAD))
        good = sum(g for _, g, _ in weighted)
        model = Model(share(good, total - good, START_GOOD), tuple(on_good), tuple(on_bad))
    return model


def fit(votes: DataFrame) -> Model:
    """The model of a corpus; what is collected is one row per vote pattern, ``3 ** rules`` at most."""
    counts = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in counts)
    return estimate(patterns, len(rules()))


def judged(votes: DataFrame, model: Model) -> DataFrame:
    """Adds ``base_failed``, the posterior ``quality`` and ``kept`` to voted rows."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for j in range(len(rules())):
        vote = F.get("votes", F.lit(j))
        odds = odds + F.when(vote > 0, model.evidence(j, 1)).when(vote < 0, model.evidence(j, -1)).otherwise(0.0)
    out = votes.select("row", "m", base_failed().alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def quality_rules(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """Every document with metrics and verdict: ``row``, ``m``, ``base_failed``, ``quality``, ``kept``."""
    votes = voted(docs, keep_rows)
    return judged(votes, fit(votes))
