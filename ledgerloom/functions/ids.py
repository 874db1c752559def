"""Stable identifiers and fingerprints as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_id(logical_key: Column) -> Column:
    """'stream-' and the first 16 hex digits of the key's SHA-256."""
    return F.concat(F.lit("stream-"), F.substring(F.sha2(logical_key, 256), 1, 16))


def transaction_id(stream: Column, page: Column, row: Column) -> Column:
    """stream:page4:row4."""
    return F.concat_ws(":", stream, F.format_string("%04d", page), F.format_string("%04d", row))


def comparison_id(ordinal: Column) -> Column:
    """T0001, T0002, ...."""
    return F.format_string("T%04d", ordinal)


def block_id(page: Column, source: Column, text: Column, box: Column) -> Column:
    """pPPPP:source: and 20 hex digits of the SHA-256 of the block's canonical JSON (F32)."""
    body = F.to_json(F.struct(page.alias("page"), source.alias("source"), text.alias("text"), box.alias("box")))
    return F.concat(F.format_string("p%04d:", page), source, F.lit(":"), F.substring(F.sha2(body, 256), 1, 20))


def content_fingerprint(text: Column, images: Column) -> Column:
    """SHA-256 of a page's text and image descriptors, blind to size and rotation."""
    return F.sha2(F.to_json(F.struct(text.alias("text"), images.alias("images"))), 256)


def template_fingerprint(name: str = "name", digest: str = "sha256") -> Column:
    """Aggregate: SHA-256 over the sorted name:digest lines of a pack's files."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(name, digest))), lambda f: F.concat_ws(":", f[name], f[digest]))
    return F.sha2(F.array_join(lines, "\n"), 256)
