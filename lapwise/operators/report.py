"""Messages and reports of benchmark jobs, as column expressions.

A report is made row by row from the job's columns and its comparison text, so
rendering any number of reports needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from lapwise.functions.binding import let, rows_of
from lapwise.functions.names import commit_url, compare_url, request_url
from lapwise.functions.text import format_duration, html_escape, sized, tail_units, truncate_sized, truncate_tail, units
from lapwise.operators.ordering import query_number
from lapwise.session import cut

# Size limit of a message in UTF-16 units and the shape of its parts.
MESSAGE_LIMIT = 65_536
BLOCK_START = "=== Comparing "
SUMMARY_OPEN, SUMMARY_CLOSE = "<pre>", "</pre>\n\n"
DETAILS_OPEN = "<details>\n<summary>Show full query output</summary>\n\n<pre>"
DETAILS_CLOSE = "</pre>\n\n</details>"
MEASURED_ITERATIONS = 5
# Sections of the lines with the names of the runs and with the total.
FIRST_SECTION, LAST_SECTION = 0, 5


def report_blocks(text: Column) -> Column:
    """Non-blank blocks of a comparison text, one per compared dataset."""

    def split(text: Column) -> Column:
        # A plain search, if no header follows another end of a line.
        parts = F.transform(F.split(text, f"\n{BLOCK_START}"), lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(BLOCK_START), part)))
        other = reduce(or_, [text.contains(f"{end}{BLOCK_START}") for end in "\r\u0085\u2028\u2029"])
        return F.when(other, F.split(text, f"(?m)(?=^{BLOCK_START})")).otherwise(parts)

    return F.filter(F.transform(let(_trim(text), split), _trim), lambda block: block != "")


def block_parts(block: Column) -> Column:
    """``structured``, ``summary`` and ``details`` of a block.

    Header, task lines and the last total are the summary; a block without
    header or total has no structure.
    """
    starts = lambda line, word: F.ltrim(line).startswith(word)

    def split(lines: Column, total: Column) -> Column:
        in_summary = lambda line, i: (i == 0) | (i == total) | starts(line, "TASKS:")
        return F.struct(
            (F.get(lines, F.lit(0)).startswith(BLOCK_START) & (total > 0)).alias("structured"),
            F.array_join(F.transform(F.filter(lines, in_summary), lambda line: F.ltrim(line)), "\n").alias("summary"),
            F.array_join(F.filter(lines, lambda line, i: ~in_summary(line, i)), "\n").alias("details"),
        )

    def last_total(lines: Column) -> Column:
        places = F.transform(lines, lambda line, i: F.when(starts(line, "TOTAL:"), i).otherwise(-1))
        return F.array_max(places)

    return let(F.split(block, "\n"), lambda lines: let(last_total(lines), lambda total: split(lines, total)))


def split_report_blocks(reports: DataFrame, keys: Sequence[str], text: str = "report") -> DataFrame:
    """One row per block of every report."""
    blocks = reports.select(*keys, F.posexplode(report_blocks(F.col(text))).alias("block", "text"))
    return blocks.select(*keys, "block", "text", rows_of(block_parts(F.col("text"))))


def _trim(text: Column) -> Column:
    # One greedy match, as btrim with a list of characters looks at every character apart.
    return F.regexp_extract(text, r"(?s)\A[ \t\n\x0B\f\r]*+(.*[^ \t\n\x0B\f\r])?", 1)


def sized_blocks(text: Column) -> Column:
    """The blocks of a comparison text, split and escaped once: ``structured``, ``summary``, ``details``, ``whole``.

    Of each text only what a message can show is kept, with its whole size.
    """

    def escaped(block: Column) -> Column:
        fit = lambda value: sized(html_escape(value), MESSAGE_LIMIT)
        return let(
            block_parts(block),
            lambda parts: F.struct(
                parts["structured"].alias("structured"), fit(parts["summary"]).alias("summary"),
                fit(parts["details"]).alias("details"), fit(block).alias("whole"),
            ),
        )

    return F.transform(report_blocks(text), escaped)


def _preformatted(whole: Column, limit: Column) -> Column:
    frame = len("<pre>") + len("</pre>")
    return F.when(limit <= frame, truncate_sized(whole, limit)).otherwise(
        F.concat(F.lit("<pre>"), truncate_sized(whole, limit - frame), F.lit("</pre>"))
    )


def render_block(block: Column, limit: Column) -> Column:
    """A sized block within its size: the summary first, the details folded below it."""
    frame = sum(map(len, (SUMMARY_OPEN, SUMMARY_CLOSE, DETAILS_OPEN, DETAILS_CLOSE)))
    room = limit - frame

    def framed(summary: Column) -> Column:
        details = truncate_sized(block["details"], room - units(summary))
        return F.concat(
            F.lit(SUMMARY_OPEN), summary, F.lit(SUMMARY_CLOSE), F.lit(DETAILS_OPEN), details, F.lit(DETAILS_CLOSE)
        )

    whole = let(truncate_sized(block["summary"], room), framed)
    shown = F.when(~block["structured"] | (room <= 0), _preformatted(block["whole"], limit)).otherwise(whole)
    return F.when(limit <= 0, "").otherwise(shown)


def render_comparison(blocks: Column, limit: Column) -> Column:
    """All sized blocks of a comparison, sharing the size evenly."""
    count = F.size(blocks)
    share = F.floor(F.greatest(F.lit(0), limit - (count - 1) * 2) / F.greatest(count, F.lit(1))).cast("int")
    shared = let(share, lambda size: F.transform(blocks, lambda block: render_block(block, size)))
    return F.array_join(shared, "\n\n")


# --- messages -----------------------------------------------------------------
# The texts of all messages below.


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def request_link() -> Column:
    return _text("Requested by [this comment](", request_url(F.col("pull_request_url"), F.col("comment_id")), ").")


def dataset_names() -> Column:
    return F.array_join(F.transform("datasets", lambda d: F.concat(F.lit("`"), d, F.lit("`"))), ", ")


def capacity() -> Column:
    return _text(F.col("nodes"), " `", F.col("instance_type"), "` nodes")


def queued_message() -> Column:
    return _text(
        request_link(), "\n\nBenchmark job ", F.col("id"), " queued for ", dataset_names(), " on ", capacity(), "."
    )


def running_message() -> Column:
    return _text(request_link(), "\n\nRunning ", dataset_names(), " on ", capacity(), ".")


def progress_message() -> Column:
    return _text(
        running_message(), "\n\n**Progress ", F.col("step"), "/", F.col("total"), ":** ", F.col("message"), "."
    )


def failure_message() -> Column:
    """Says that a job failed, but nothing of its output."""
    return _text(
        request_link(), "\n\nBenchmark job ", F.col("id"), " failed for ", dataset_names(),
        ". Full details are available in the controller journal.",
    )


def result_message(site: str, build_target: str) -> Column:
    """The report of a finished job within the size limit.

    Uses the job columns, ``blocks`` (of ``sized_blocks``) and the timings: ``phases`` (an array
    of dataset, base_ms, head_ms), ``base_deploy_ms``, ``head_deploy_ms``,
    ``base_ms``, ``head_ms``, ``queue_wait_ms``, ``validation_ms`` and ``total_ms``.
    """
    base, head, repository = F.col("base_sha"), F.col("head_sha"), F.col("repository")
    revision = lambda label, sha: _text(
        f"[{label} `", F.left(sha, F.lit(12)), "`](", commit_url(site, repository, sha), ")"
    )
    full_revision = lambda sha: _text("[`", sha, "`](", commit_url(site, repository, sha), ")")
    duration = lambda column: format_duration(F.col(column))
    phase = lambda p: _text(
        "| Benchmark `", p["dataset"], "` | ", format_duration(p["base_ms"]), " | ", format_duration(p["head_ms"]), " |"
    )
    header = _text(
        request_link(), "\n\n## Benchmark results\n\n**Compared:** ", revision("Base", base), " → ",
        revision("PR head", head), " · [View exact source diff](", compare_url(site, repository, base, head), ")\n\n",
    )
    details = _text(
        "\n\n<details>\n<summary>Verification and run details</summary>\n\nJob `", F.col("id"),
        "` captured both immutable revisions when the request was queued. The bot fetched and checked out each full"
        f" commit SHA in detached HEAD, then built and deployed the `{build_target}` target from that checkout.\n\n"
        "| Identity | Base | PR head |\n| --- | --- | --- |\n| Source commit | ", full_revision(base), " | ",
        full_revision(head), " |\n\n| Phase | Base | PR head |\n| --- | ---: | ---: |\n| Build and deployment | ",
        duration("base_deploy_ms"), " | ", duration("head_deploy_ms"), " |\n| All benchmarks | ", duration("base_ms"),
        " | ", duration("head_ms"), " |\n", F.array_join(F.transform("phases", phase), "\n"),
        "\n\n**Workload:** ", dataset_names(),
        f" · all queries · 1 warmup + {MEASURED_ITERATIONS} measured iterations per query\n\n**Capacity:** ", capacity(),
        " for both revisions\n\n**Other timings:** Queue ", duration("queue_wait_ms"), " · Dataset validation ",
        duration("validation_ms"), " · Total ", duration("total_ms"), "\n\n</details>",
    )
    limit = F.lit(MESSAGE_LIMIT)

    def assemble(head: Column, tail: Column) -> Column:
        fixed = units(head) + units(tail)
        short = truncate_tail(F.concat(head, tail), limit)
        room = let(limit - fixed, lambda size: render_comparison(F.col("blocks"), size))
        return F.when(fixed >= limit, short).otherwise(F.concat(head, room, tail))

    return let(header, lambda head: let(details, lambda tail: assemble(head, tail)))


# --- texts from lines -----------------------------------------------------------


def _place() -> Column:
    """What orders the lines of a dataset."""
    number = query_number("id")
    return F.struct(
        "section", number.isNull().alias("unnumbered"), number.alias("number"),
        F.collate(F.col("id"), "UNICODE").alias("locale"), F.col("id").alias("id"),
    )


def report_texts(lines: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """The whole comparison text of every dataset; it is one value, as large as its lines."""
    ordered = F.sort_array(F.collect_list(F.struct(_place().alias("place"), "line")))
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("report")
    )


def line_tails(lines: DataFrame, keys: Sequence[str], limit: int = MESSAGE_LIMIT) -> DataFrame:
    """The lines (``section``, ``id``, ``line``) of every group joined in order: ``tail``, their last ``limit`` units, and ``units`` of all.

    Lines are ordered by ranges of bounded size.  From the sizes of the ranges
    follows what stands behind each, and from the sizes within a range what
    stands behind each line, so only lines that reach into the tail are gathered.
    """
    ranged = lines.repartitionByRange(*keys, _place()).select(
        *keys, "section", "id", "line", (units(F.col("line")) + 1).cast("bigint").alias("size"), F.spark_partition_id().alias("range")
    )
    ranged = cut(ranged, "report-lines")
    sums = ranged.groupBy(*keys, "range").agg(F.sum("size").alias("size"))
    later = Window.partitionBy(*keys).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select(*keys, "range", "size", F.coalesce(F.sum("size").over(later), F.lit(0)).alias("behind"))
    wholes = placed.groupBy(*keys).agg((F.sum("size") - 1).cast("int").alias("units"))
    near = ranged.join(placed.where(F.col("behind") < limit).drop("size"), [*keys, "range"])
    after = Window.partitionBy(*keys, "range").orderBy(_place().desc()).rowsBetween(Window.unboundedPreceding, -1)
    reaching = near.withColumn("behind", F.col("behind") + F.coalesce(F.sum("size").over(after), F.lit(0))).where(F.col("behind") < limit)
    # A line has a unit at least, so there are at most as many as units.
    ordered = F.sort_array(F.collect_list(F.struct(_place().alias("place"), "line")))
    joined = F.array_join(F.transform(ordered, lambda e: e["line"]), "\n")
    tails = reaching.groupBy(*keys).agg(joined.alias("tail"))
    return tails.join(wholes, list(keys)).withColumn("tail", tail_units(F.col("tail"), F.lit(limit)))


def sized_reports(lines: DataFrame, key: str = "dataset") -> DataFrame:
    """The block of every dataset as :func:`sized_blocks` gives it, from its lines instead of its text."""
    first, last = F.col("section") == FIRST_SECTION, F.col("section") == LAST_SECTION
    summary = first | last | F.ltrim("line").startswith("TASKS:")
    # The summary is not indented.
    own = F.struct(F.when(summary, "summary").otherwise("details").alias("part"), F.when(summary, F.ltrim("line")).otherwise(F.col("line")).alias("line"))
    whole = F.struct(F.lit("whole").alias("part"), F.col("line").alias("line"))
    parts = lines.select(key, "section", "id", F.explode(F.array(own, whole)).alias("p"))
    escaped = parts.select(key, "section", "id", "p.part", html_escape(F.col("p.line")).alias("line"))
    tails = line_tails(escaped, [key, "part"])
    sized_part = F.struct("tail", "units")
    none = F.struct(F.lit("").alias("tail"), F.lit(0).alias("units"))
    part = lambda name: F.coalesce(F.first(F.when(F.col("part") == name, sized_part), ignorenulls=True), none)
    gathered = tails.groupBy(key).agg(*[part(name).alias(name) for name in ("summary", "details", "whole")])
    shape = lines.groupBy(key).agg((F.bool_or(first) & F.bool_or(last)).alias("structured"))
    return gathered.join(shape, key).select(key, F.array(F.struct("structured", "summary", "details", "whole")).alias("blocks"))


def trimmed_texts(texts: DataFrame) -> DataFrame:
    """Texts (``report``) without surrounding blanks, and none that is blank."""
    return texts.withColumn("report", _trim(F.col("report"))).where(F.col("report") != "")


def multi_dataset_report(texts: DataFrame, key: str = "job_id") -> DataFrame:
    """Trimmed texts of a job's datasets in request order, a blank line between.

    ``texts`` has ``dataset_pos`` and ``report``; a command names its datasets
    in one comment, which bounds the list.
    """
    ordered = F.sort_array(F.collect_list(F.struct("dataset_pos", "report")))
    joined = F.array_join(F.transform(ordered, lambda e: e["report"]), "\n\n")
    return texts.groupBy(key).agg(joined.alias("comparison"), F.count(F.lit(1)).alias("blocks"))
