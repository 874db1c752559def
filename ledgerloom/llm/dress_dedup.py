"""Problem 5: duplicates hidden by formatting differences.

A record's fields are canonicalised (characters, case, spacing, punctuation, field order; money by exact
value), hashed to 128 bits and counted with map-side combining. Everything is a JVM expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_amount_text
from ledgerloom.functions.text import NON_ASCII, casefold, let, nfc
from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import written

MONEY_FIELDS = ("transaction_amount", "balance")
#: Unicode punctuation and separators, white space, and the ASCII signs that Unicode files as symbols.
DROPPED = r"[\p{P}\p{Z}\s$+<=>^`|~]"


def plain_text(text: Column) -> Column:
    """Text without letter case, spacing and punctuation; nothing else is equated, so x² stays apart from x2."""
    return let(text, lambda t: F.regexp_replace(F.when(t.rlike(NON_ASCII), nfc(casefold(nfc(t)))).otherwise(F.lower(t)), DROPPED, ""))


def canonical_record(fields: Column) -> Column:
    """One text per record, equal exactly for records that differ in dress only."""

    def one(e: Column) -> Column:
        raw = e["value"]["raw_text"]
        value = F.when(e["key"].isin(*MONEY_FIELDS), F.coalesce(F.concat(F.lit("="), parse_amount_text(raw)), F.concat(F.lit("?"), plain_text(raw)))).otherwise(plain_text(raw))
        shown = F.coalesce(F.concat(F.lit("+"), value), F.lit("-"))
        return F.concat(F.length(e["key"]).cast("string"), F.lit(":"), e["key"], F.lit(":"), F.length(shown).cast("string"), F.lit(":"), shown)

    return F.coalesce(F.array_join(F.sort_array(F.transform(F.map_entries(fields), one)), ""), F.lit(""))


def record_keys(records: DataFrame, key: str, fields: str) -> DataFrame:
    """(key, h BINARY of 128 bits, c BIGINT): the hash of the canonical record and an independent check hash."""
    text = records.select(F.col(key), canonical_record(F.col(fields)).alias("_text"))
    return text.select(key, F.unhex(F.md5("_text")).alias("h"), F.xxhash64("_text").alias("c"))


def collapse(records: DataFrame, key: str = "candidate_id", fields: str = "fields") -> DataFrame:
    """One row per set of copies: (key: smallest of the set, copies BIGINT).

    fields is MAP<STRING, STRUCT<raw_text, ...>>; only names and raw_text count. A null map equals an empty
    one, null raw_text equals null raw_text only, repeated rows count as copies, an empty table gives no
    rows. Records whose 128-bit hashes collide stay apart by the check hash, which is grouped with it.
    """
    return record_keys(records, key, fields).groupBy("h", "c").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).drop("h", "c")


def copy_pairs(records: DataFrame, key: str = "candidate_id", fields: str = "fields") -> DataFrame:
    """(key_a, key_b): the smallest key of each set of copies beside each other key of the set.

    Very large sets are spread over salts, so a set of a third of all rows meets no
    single task; membership of the others is a plain equi-join of 24-byte keys.
    """
    rows = written(record_keys(records, key, fields))  # canonicalised once; some 40 bytes a row are read again
    sets = rows.groupBy("h", "c").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted_lookup(rows, sets, ["h", "c"], key).where(F.col(key) != F.col("first")).select(F.col("first").alias(f"{key}_a"), F.col(key).alias(f"{key}_b"))
