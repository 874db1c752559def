"""Differences of two copies against brute force, with nulls, repeats, order and clashing columns."""

import random
from decimal import Decimal

from ledgerloom.operators.snapshot_diff import diff_snapshots
from tests.test_values import plain_amount

SCHEMA = "sample_id string, transactions array<struct<page_index:int,row_index:int,fields:map<string,string>>>, part int, side string, fields string"


def table(spark, rows):
    return spark.createDataFrame([(s, t, 1, "x", "y") for s, t in rows], SCHEMA)


def value(name, v):
    if name in ("transaction_amount", "balance"):
        n = plain_amount(v)
        return n if n is not None else ("?", v)
    return v


def brute(primary, mirror):
    def load(rows):
        out = {}
        for s, ts in rows:
            for t in ts or []:
                if t is not None:
                    f = {k: value(k, v) for k, v in (t[2] or {}).items() if v is not None}
                    out.setdefault((s, t[0], t[1]), []).append(f)
        return out

    p, m = load(primary), load(mirror)
    found = set()
    for k in p.keys() | m.keys():
        if k not in m:
            found.add((*k, "only_primary"))
        elif k not in p:
            found.add((*k, "only_mirror"))
        else:
            names = {n for f in p[k] + m[k] for n in f}
            found |= {(*k, n) for n in names if {str(f.get(n)) if not isinstance(f.get(n), Decimal) else f[n] for f in p[k]} != {str(f.get(n)) if not isinstance(f.get(n), Decimal) else f[n] for f in m[k]}}
    return found


def check(spark, primary, mirror, **kw):
    got = [tuple(r) for r in diff_snapshots(table(spark, primary), table(spark, mirror), **kw).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(primary, mirror)
    return set(got)


def test_cases(spark):
    base = {"transaction_date": "2026-01-01", "transaction_amount": "1,234.50", "balance": None}
    p = [("a", [(0, 0, base), (0, 1, {"balance": "x?"}), (0, 2, {"counterparty_name": "A"}), None, (None, None, {})]), ("only", [(0, 0, {})]), ("n", None), (None, [(0, 0, {"balance": "1"})])]
    m = [("a", [(0, 2, {"counterparty_name": "a"}), (0, 1, {"balance": "x?"}), (0, 0, {"balance": None, "transaction_amount": "+1234.5", "transaction_date": "2026-01-01"})]), ("a", [(0, 0, base)]), (None, [(0, 0, {"balance": "2"})]), ("e", [])]
    assert check(spark, p, m) == {("a", 0, 2, "counterparty_name"), ("a", None, None, "only_primary"), ("only", 0, 0, "only_primary"), (None, 0, 0, "balance")}


def test_empty(spark):
    rows = [("a", [(0, 0, {"balance": "1"})])]
    assert check(spark, [], []) == set()
    assert check(spark, rows, []) == {("a", 0, 0, "only_primary")}
    assert check(spark, [], rows) == {("a", 0, 0, "only_mirror")}


def test_random_and_chunking(spark):
    rng = random.Random(6)
    amounts = ["1.00", "1", "+1,00", "(1)", "-1", "1O", "2.50", "1,234.00", "1234", None]

    def sample(s, n):
        return (s, [(k // 9, k % 9, {n: v for n, v in (("transaction_amount", rng.choice(amounts)), ("transaction_date", rng.choice(["x", "y"])), ("counterparty_name", rng.choice(["A", None]))) if rng.random() < 0.9}) for k in range(n)])

    primary = [sample(f"s{k}", rng.randint(0, 30)) for k in range(60)]
    mirror = []
    for s, ts in primary:
        kept = [t if rng.random() < 0.93 else (t[0], t[1], {**t[2], "balance": "9"}) for t in ts if rng.random() < 0.96]
        rng.shuffle(kept)
        mirror.append((s, kept))
        if rng.random() < 0.1:
            mirror.append((s, kept[:3]))
    for kw in ({}, {"parts": 1}, {"cut_bits": 5, "parts": 2}, {"cut_bits": 0}):
        check(spark, primary, mirror, **kw)


def test_hot_sample_is_spread(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40_000).select(F.lit("hot").alias("sample_id"), F.array(F.struct(F.lit(0).alias("page_index"), F.col("id").cast("int").alias("row_index"), F.create_map(F.lit("balance"), F.col("id").cast("string")).alias("fields"))).alias("transactions"))
    changed = rows.withColumn("transactions", F.when(F.col("transactions")[0]["row_index"] % 10_000 == 0, F.lit(None)).otherwise(F.col("transactions")))
    assert diff_snapshots(rows, changed).count() == 4


def test_hot_key_and_few_differences(spark):
    """A third of all rows repeat one key; one other row differs, one is only printed differently."""
    from pyspark.sql import functions as F

    def copy(amount):
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).cast("int")
        value = F.when(F.col("id") == 1, F.lit(amount)).when(F.col("id") % 3 == 0, F.lit("7.00")).otherwise(F.concat(F.col("id").cast("string"), F.lit(".50")))
        row = F.struct(F.lit(0).alias("page_index"), key.alias("row_index"), F.create_map(F.lit("balance"), value, F.lit("note"), F.lit(None).cast("string")).alias("fields"))
        return spark.range(30_000).select((F.col("id") % 3).cast("string").alias("sample_id"), F.array(row).alias("transactions"))

    assert diff_snapshots(copy("2,000.00"), copy("+2000")).count() == 0
    assert [tuple(r) for r in diff_snapshots(copy("2,000.00"), copy("2000.01")).collect()] == [("1", 0, 1, "balance")]
