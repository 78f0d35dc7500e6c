"""JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dataset_list(document: Column, dataset: Column) -> Column:
    """A JSON array of texts as it is; anything else becomes ``[dataset]``.

    ``from_json`` would turn other elements into text, so the shape is checked
    on the parsed value: all elements text, at least one, none null.
    """
    shape = F.schema_of_variant(F.try_parse_json(document))
    # A text array may still hold nulls; only then does the typed read see one.
    nulls = F.exists(F.from_json(document, "array<string>"), lambda e: e.isNull())
    keep = (shape == "ARRAY<STRING>") & ~F.coalesce(nulls, F.lit(True))
    return F.when(F.coalesce(keep, F.lit(False)), document).otherwise(F.to_json(F.array(dataset)))
