"""Problem 3: differences between two copies of keyed nested rows, by content-defined chunking.

Only keys and 64-bit hashes of rows travel at first: they are routed by a block of the key space, sorted by
key and cut into chunks where a rolling hash over the last keys meets a condition. A chunk whose
fingerprint the other copy has too is equal and goes no further; of the others, keys whose row hash the
other copy lacks are marked in a bitmap of fixed size, and only the full rows it lets through are read again,
gathered and compared field by field. A cut depends on nearby keys only, so an insertion moves no cut
further off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_amount_text

#: Fields compared by exact decimal value; all others compare as text.
MONEY_FIELDS = ("transaction_amount", "balance")
#: Rows of one sample and page whose row_index falls into one block stay together; it bounds what a hot sample puts into one place.
BLOCK_ROWS = 4096
#: Keys the rolling hash sees, and the mean chunk length 2**CUT_BITS.
ROLL = 3
CUT_BITS = 5
#: Input bytes whose keys are sorted together, at most on average.
PART_BYTES = 32 << 20
#: The bitmap of marked keys has 2**WORD_BITS words of 64 bits and no more, whatever the data: some megabytes.
WORD_BITS = 17

_KEY = ["sample_id", "page_index", "row_index"]


def _canonical_fields(fields: Column) -> Column:
    """Sorted (name, value) pairs without nulls; money as exact value, marked apart from unreadable text."""

    def pair(e: Column) -> Column:
        value = e["value"]
        money = F.coalesce(F.concat(F.lit("="), parse_amount_text(value)), F.concat(F.lit("?"), value))
        shown = F.when(e["key"].isin(*MONEY_FIELDS), money).otherwise(value)
        return F.struct(e["key"].alias("name"), shown.alias("value"))

    kept = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    return F.coalesce(F.sort_array(F.transform(kept, pair)), F.array().cast("array<struct<name:string,value:string>>"))


def _rows(samples: DataFrame, mirrored: bool) -> DataFrame:
    """One row per row of a copy: its key, its fields as they stand, and the copy."""
    rows = samples.select("sample_id", F.explode("transactions").alias("t")).where("t is not null")
    return rows.select("sample_id", "t.page_index", "t.row_index", "t.fields", F.lit(mirrored).alias("mirrored"))


def _key_hash() -> Column:
    """64 bits of a key; which parts are null is hashed too."""
    return F.xxhash64(*_KEY, *[F.col(c).isNull() for c in _KEY])


def _input_bytes(*inputs: DataFrame) -> int:
    """What the planner knows of the inputs' size, without a job; 0 for an input it knows nothing of."""
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs]
    return sum(n for n in sizes if n < 1 << 60)


def differing_keys(rows: DataFrame, cut_bits: int, parts: int, tasks: int | None) -> DataFrame:
    """Keys that one copy lacks or whose rows have other hashes there, by the fingerprints of chunks.

    rows hold a key, fields and mirrored. Repeats collapse before the first shuffle, and no row is wider than
    its key and two numbers. The 64-bit hash of a row is only compared with that of the same key.
    """
    own = rows.select(*_KEY, "mirrored", F.xxhash64(_canonical_fields(F.col("fields"))).alias("h")).distinct()
    block = F.xxhash64("sample_id", "page_index", F.floor(F.col("row_index") / BLOCK_ROWS))
    routed = own.withColumn("part", F.pmod(block, F.lit(parts)).cast("int"))
    routed = routed.repartition(tasks, "part") if tasks else routed.repartition("part")
    # One hash per key and copy: of the set of its rows, nearly always one.
    keyed = routed.groupBy("part", "mirrored", *_KEY).agg(F.bit_xor(F.xxhash64("h")).alias("h")).withColumn("kh", _key_hash())

    by_key = Window.partitionBy("part", "mirrored").orderBy(*[F.col(c).asc_nulls_first() for c in _KEY])
    rolling = F.lit(0).cast("long")
    for back in range(ROLL):
        rolling = rolling.bitwiseXOR(F.shiftleft(F.coalesce(F.lag("kh", back).over(by_key), F.lit(back).cast("long")), back))
    keyed = keyed.withColumn("cut", (F.shiftrightunsigned(rolling, 64 - cut_bits - 8).bitwiseAND((1 << cut_bits) - 1) == 0).cast("int") if cut_bits else F.lit(1))
    chunks = keyed.withColumn("chunk", F.sum("cut").over(by_key)).groupBy("part", "mirrored", "chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("kh", "h")).alias("lo"),
        F.bit_xor(F.xxhash64(F.lit("again"), "h", "kh")).alias("hi"),
        F.collect_list(F.struct(*_KEY, "h")).alias("rows"),
    )
    # The anti-join of fingerprints, both ways at once: chunks of both copies share a partition, so it needs no shuffle.
    unmatched = chunks.groupBy("part", "n", "lo", "hi").agg(F.count(F.lit(1)).alias("sides"), F.first("rows").alias("rows")).where("sides = 1")
    pairs = unmatched.select("part", F.inline("rows")).groupBy("part", *_KEY).agg(F.count(F.lit(1)).alias("sides"), F.min("h").alias("a"), F.max("h").alias("b"))
    return pairs.where("sides = 1 or a <> b").select(*_KEY)


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose key is among keys, and a few others: a semi-join by a bitmap of fixed size, which moves no row."""
    word = F.col("kh").bitwiseAND((1 << WORD_BITS) - 1)
    bit = F.shiftrightunsigned("kh", WORD_BITS).bitwiseAND(63).cast("int")
    words = keys.select(_key_hash().alias("kh")).groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(kh, {WORD_BITS}) & 63 as int))")).alias("bits"))
    rows = rows.withColumn("kh", _key_hash())
    return rows.join(F.broadcast(words), word == F.col("word")).where(F.getbit("bits", bit) == 1).drop("kh", "word", "bits")


def diff_snapshots(primary: DataFrame, mirror: DataFrame, cut_bits: int = CUT_BITS, parts: int | None = None) -> DataFrame:
    """Rows missing on a side and fields that differ: (sample_id, page_index, row_index, difference).

    Inputs have sample_id and transactions ARRAY<STRUCT<page_index, row_index, fields MAP<STRING,STRING>>>;
    other columns are ignored. Null or empty transactions and null elements hold no rows. A null in a key
    part is a key value of its own. A null field value and an absent key are the same and differ from any
    value. Repeated rows count once; if a side repeats a key with different values, a field differs unless
    both sides hold the same set of values for it. Either input may be empty. ``parts`` routes of the key
    space are sorted and cut on their own; by default as many as the inputs' size asks for, at least eight
    for each shuffle partition.
    """
    at_least = 8 * int(primary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_size = _input_bytes(primary, mirror) // PART_BYTES
    parts = parts or max(at_least, by_size)
    rows = _rows(primary, False).unionByName(_rows(mirror, True))
    keys = differing_keys(rows, cut_bits, parts, parts // 8 if parts > at_least else None)

    full = _marked(rows, keys).select(*_KEY, "mirrored", _canonical_fields(F.col("fields")).alias("fields"))
    side = lambda mirrored: F.collect_set(F.when(F.col("mirrored") == mirrored, F.col("fields")))
    pairs = full.groupBy(*_KEY).agg(side(False).alias("p"), side(True).alias("m"))

    def values(versions: Column, name: Column) -> Column:
        """The sorted set of values that a side has for a field; an absent field is an empty set."""
        hit = F.transform(versions, lambda v: F.get(F.filter(v, lambda e: e["name"] == name), F.lit(0))["value"])
        return F.array_sort(F.array_distinct(F.transform(hit, lambda x: F.struct(x.isNull().alias("absent"), x.alias("value")))))

    names = F.array_distinct(F.transform(F.flatten(F.concat("p", "m")), lambda e: e["name"]))
    changed = F.filter(names, lambda n: values(F.col("p"), n) != values(F.col("m"), n))
    what = F.when(F.size("m") == 0, F.array(F.lit("only_primary"))).when(F.size("p") == 0, F.array(F.lit("only_mirror"))).otherwise(changed)
    return pairs.select(*_KEY, F.explode(what).alias("difference"))
