"""Search filters as one condition on chunks joined with their documents; Catalyst pushes down what it can."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filter names and the columns they ask.
LISTS = {"document_ids": "document_id", "source_ids": "source_id", "doc_types": "doc_type", "source_types": "source_type", "languages": "language"}
LAYERS = ("chunk_metadata", "metadata", "properties")


def metadata_value(key: str, layers: tuple[str, ...] = LAYERS) -> Column:
    """The first value of a top-level key that is neither absent nor JSON null: the chunk's, the user's, the document's own."""
    found = [F.try_variant_get(F.try_parse_json(layer), f'$["{key}"]', "variant") for layer in layers]
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in found])


def _equals(value: Column, wanted: Any) -> Column:
    """Typed: a text never equals a number; true and false are 1 and 0."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == wanted)
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(kind != "STRING", F.try_variant_get(value, "$", "double"))
    return number == float(wanted)


def condition(filters: dict[str, Any] | None) -> Column:
    """An empty list asks nothing, but for a metadata key it finds nothing; a row without a date is in no range; unknown names are errors."""
    filters = filters or {}
    if unknown := set(filters) - {*LISTS, "doc_date", "metadata"}:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    out = F.lit(True)
    for name, column in LISTS.items():
        if wanted := filters.get(name):
            if not isinstance(wanted, list):
                raise ValueError(f"{name} is a list")
            out &= F.col(column).isin(wanted)
    dates = filters.get("doc_date") or {}
    if not isinstance(dates, dict) or set(dates) - {"gte", "lte"}:
        raise ValueError("doc_date has gte and lte")
    if dates.get("gte"):
        out &= F.col("doc_date") >= str(dates["gte"])
    if dates.get("lte"):
        out &= F.col("doc_date") <= str(dates["lte"])
    metadata = filters.get("metadata") or {}
    if not isinstance(metadata, dict):
        raise ValueError("metadata is a mapping")
    for key, wanted in metadata.items():
        if not re.fullmatch(r"[\w.-]+", key):
            raise ValueError(f"bad key {key!r}")
        any_of = F.lit(False)
        for one in wanted if isinstance(wanted, list) else [wanted]:
            if one is not None:
                any_of |= F.coalesce(_equals(metadata_value(key), one), F.lit(False))
        out &= any_of
    return F.coalesce(out, F.lit(False))
