"""Names, links and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted names.
DATASET_PATTERN = r"^([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)\z"
TABLE_PATTERN = r"^[a-zA-Z0-9._-]+\z"
SHA_PATTERN = r"^[0-9a-f]{40}\z"
LOGIN_PATTERN = r"^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?\z"
LABEL_LENGTH = 12


def suite_of(dataset: Column) -> Column:
    return F.regexp_extract(dataset, DATASET_PATTERN, 1)


def variant_of(dataset: Column) -> Column:
    return F.regexp_extract(dataset, DATASET_PATTERN, 2)


def is_dataset(dataset: Column) -> Column:
    """``suite/variant`` where neither part is a dot name."""
    dots = (".", "..")
    return dataset.rlike(DATASET_PATTERN) & ~suite_of(dataset).isin(*dots) & ~variant_of(dataset).isin(*dots)


def is_below_root(dataset: Column) -> Column:
    """Whether the dataset's path stays strictly below the root it is resolved against."""
    suite, variant = suite_of(dataset), variant_of(dataset)
    depth = lambda part: F.when(part == ".", 0).when(part == "..", -1).otherwise(1)
    # ``..`` as the first part leaves the root whatever follows.
    return dataset.rlike(DATASET_PATTERN) & (suite != "..") & (depth(suite) + depth(variant) > 0)


def is_sha(value: Column) -> Column:
    return value.rlike(SHA_PATTERN)


def is_login(value: Column) -> Column:
    return value.rlike(LOGIN_PATTERN)


def issue_number(url: Column) -> Column:
    """Number at the end of an issue link; absent and zero both mean "none"."""
    digits = F.nullif(F.regexp_extract(url, r"/issues/([0-9]+)\z", 1), F.lit(""))
    return F.nullif(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def run_label(branch: Column, commit: Column) -> Column:
    """Last part of the branch name, or the short commit of a detached work-tree; neither is an error."""
    last = F.element_at(F.split(F.trim(branch), "/"), -1)
    neither = F.raise_error(F.lit("A work-tree has neither branch nor commit")).cast("string")
    return F.coalesce(F.nullif(last, F.lit("")), F.nullif(F.left(commit, F.lit(LABEL_LENGTH)), F.lit("")), neither)


def bucket_uri(bucket: Column) -> Column:
    """``s3://name`` without trailing slashes."""
    return F.concat(F.lit("s3://"), F.regexp_replace(F.regexp_replace(bucket, "^s3://", ""), "/+$", ""))


def hadoop_uri(uri: Column) -> Column:
    """The same location for Spark's object-store reader."""
    return F.regexp_replace(uri, "^s3://", "s3a://")


def schema_name(dataset: Column) -> Column:
    return F.replace(dataset, F.lit("/"), F.lit("_"))


def commit_url(site: str, repository: Column, sha: Column) -> Column:
    return F.concat(F.lit(f"{site}/"), repository, F.lit("/commit/"), sha)


def compare_url(site: str, repository: Column, base: Column, head: Column) -> Column:
    return F.concat(F.lit(f"{site}/"), repository, F.lit("/compare/"), base, F.lit("..."), head)


def request_url(pull_request_url: Column, comment_id: Column) -> Column:
    return F.concat(pull_request_url, F.lit("#issuecomment-"), comment_id.cast("string"))
