"""Benchmark commands in comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapwise.functions.binding import rows_of

# Limits, defaults, accepted words and replies of the command.
MAX_NODES = 24
DEFAULT_INSTANCE_TYPE = "c5n.2xlarge"
DEFAULT_NODES = 12
DATASET = r"^[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+\z"
INSTANCE_TYPE = r"^[a-z][a-z0-9-]{0,19}\.[a-z0-9-]{1,20}\z"
NODE_COUNT = r"^[1-9][0-9]*\z"
USAGE = "Expected `benchmarks run <suite>/<variant>... [--instance-type <type>] [--nodes <count>]`."
# Unicode white space; the regex class of the JVM alone covers ASCII only.
_SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE, WORD = f"[{_SPACES}]", f"[^{_SPACES}]+"

# The first non-blank line, trimmed; and a line that is a command.
FIRST_LINE = f"(?s)\\A{SPACE}*([^\\n]*?){SPACE}*(?:\\n|\\z)"
COMMAND = f"\\Abenchmarks{SPACE}+run(?:{SPACE}|\\z)"


def parse_commands(comments: DataFrame, body: str = "body") -> DataFrame:
    """Add ``kind`` (none, invalid, request), ``message``, ``datasets``, ``instance_type`` and ``nodes``.

    Only the first non-blank line counts.  Dataset words run up to the first
    option word; the first failing check decides the reply.
    """
    line = F.col("_line")
    first_line = F.regexp_extract(F.col(body), FIRST_LINE, 1)
    # Anything but a command ends here: without words all later steps are null.
    # The words are extracted, as splitting would compile its pattern per row.
    words = F.when(line.rlike(COMMAND), F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    rest = F.col("_rest")
    found = F.array_position(F.transform(rest, lambda word: word.startswith("--")), True).cast("int")
    count = F.when(found == 0, F.size(rest)).otherwise(found - 1)

    staged = (
        comments.withColumn("_line", first_line)
        .withColumn("_words", words)
        .withColumn("_rest", F.slice("_words", 3, F.greatest(F.size("_words") - 2, F.lit(0))))
        .withColumn("_count", count)
        .withColumn("_datasets", F.slice("_rest", F.lit(1), F.col("_count")))
        .withColumn("_options", F.slice("_rest", F.col("_count") + 1, F.size("_rest") - F.col("_count")))
        .withColumn("_names", F.filter("_options", lambda _, i: i % 2 == 0))
        .withColumn("_values", F.filter("_options", lambda _, i: i % 2 == 1))
        .withColumn("_instance", _option("--instance-type", DEFAULT_INSTANCE_TYPE))
        .withColumn("_nodes", _option("--nodes", str(DEFAULT_NODES)))
        .withColumn("_message", F.when(F.col("_words").isNotNull(), _first_complaint()))
    )
    kind = (
        F.when(F.col("_words").isNull(), "none").when(F.col("_message").isNotNull(), "invalid").otherwise("request")
    )
    requested = lambda column: F.when(F.col("_kind") == "request", column)
    parsed = F.struct(
        F.col("_kind").alias("kind"),
        F.col("_message").alias("message"),
        requested(F.col("_datasets")).alias("datasets"),
        requested(F.col("_instance")).alias("instance_type"),
        requested(F.col("_nodes").try_cast("bigint")).alias("nodes"),
    )
    return staged.withColumn("_kind", kind).select(*[F.col(c) for c in comments.columns], rows_of(parsed))


def _option(name: str, default: str) -> Column:
    position = F.array_position("_names", name).cast("int")
    return F.coalesce(F.when(position > 0, F.get("_values", position - 1)), F.lit(default))


def _first_complaint() -> Column:
    datasets, names, nodes = F.col("_datasets"), F.col("_names"), F.col("_nodes")
    bad_dataset = F.get(F.filter(datasets, lambda d: ~d.rlike(DATASET)), F.lit(0))
    unknown_option = F.exists(names, lambda n: ~n.isin("--instance-type", "--nodes"))
    repeats = lambda array: F.size(F.array_distinct(array)) < F.size(array)
    # Digits without a leading zero: more than two of them exceed the limit.
    node_ok = nodes.rlike(NODE_COUNT) & (F.length(nodes) <= 2) & (F.coalesce(nodes.try_cast("int"), F.lit(0)) <= MAX_NODES)
    return (
        F.when((F.size(datasets) == 0) | (F.size("_options") % 2 != 0), USAGE)
        .when(
            bad_dataset.isNotNull(),
            F.concat(F.lit("Invalid dataset `"), bad_dataset, F.lit("`; expected a path such as `tpch/sf1`.")),
        )
        .when(repeats(datasets), "Each dataset may be requested only once.")
        .when(unknown_option | repeats(names), USAGE)
        .when(
            ~F.col("_instance").rlike(INSTANCE_TYPE),
            F.concat(F.lit("Invalid instance type `"), F.col("_instance"), F.lit("`.")),
        )
        .when(
            ~node_ok,
            F.concat(
                F.lit("Invalid node count `"), nodes, F.lit(f"`; expected an integer from 1 to {MAX_NODES}.")
            ),
        )
    )
