"""Nested values to JSON text and back, for stores and files that hold text only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import schemas


def fields_to_json(fields: Column | str) -> Column:
    """A field map as JSON, names in order (F41, F42); null stays null."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    return F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"], e["value"])))), {"ignoreNullFields": "false"})


def fields_from_json(text: Column | str) -> Column:
    """The field map of JSON text (F42); unreadable text gives null."""
    return F.from_json(text, f"map<string,{schemas.FIELD}>", {"mode": "PERMISSIVE"})


def spans_json(spans: Column | str) -> Column:
    """Source spans as compact JSON with polygons as [x, y] pairs (F43); null where there are none.

    spans: ARRAY<STRUCT<page_index, text_block_id, polygon ARRAY<STRUCT<x, y>>>>.
    """
    spans = F.col(spans) if isinstance(spans, str) else spans
    flat = F.transform(spans, lambda s: F.struct(s["page_index"].alias("page_index"), s["text_block_id"].alias("text_block_id"), F.transform(s["polygon"], lambda p: F.array(p["x"], p["y"])).alias("polygon")))
    return F.when(F.size(spans) > 0, F.to_json(flat))


def ordered_distinct(*arrays: Column) -> Column:
    """Distinct elements of some arrays, in order of first occurrence (U7, F45); null arrays are empty."""
    first = arrays[0]
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array_compact(F.array(F.get(first, F.lit(-1))))) for a in arrays]))
