"""Equi-joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with so many rows is spread over SALTS partitions; at most rows / HOT_ROWS keys are hot, which bounds the broadcast.
HOT_ROWS = 100_000
SALTS = 64


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: str, count: str = "n") -> DataFrame:
    """Inner join of rows with a lookup whose rows also say how many rows have their key; a key may have several lookup rows.

    Hot keys are marked by a broadcast of the hot keys alone; their rows are salted by the ``spread``
    column and their lookup rows are repeated per salt. The count column is dropped. Null keys match nothing.
    """
    hot = lookup.where(F.col(count) >= HOT_ROWS).select(*keys, F.lit(True).alias("_hot")).distinct()
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col(count) >= HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    lookup = lookup.withColumn("_salt", F.explode(salts)).drop(count)
    return rows.join(lookup, [*keys, "_salt"]).drop("_salt")
