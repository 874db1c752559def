"""Queries of the general training-data problems 3 and 4, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.moments import account_moments, candidate_zones, estimate_zones, utc_moments, zone_evidence
from ledgerloom.operators.snapshot_diff import diff_snapshots
from ledgerloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_snapshots(table(spark, sf_dir, "golden_primary"), table(spark, sf_dir, "golden_mirror"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utc_moments(table(spark, sf_dir, "accounts"), table(spark, sf_dir, "ledger_transactions"), table(spark, sf_dir, "field_values"))


def p4_zone_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone estimated for every account from its evidence alone, beside the stated one."""
    accounts = table(spark, sf_dir, "accounts")
    at, bt = account_moments(accounts, table(spark, sf_dir, "ledger_transactions"), table(spark, sf_dir, "field_values"))
    estimated = estimate_zones(zone_evidence(at, bt), candidate_zones(accounts))
    return accounts.select("account_number", F.col("tz_name").alias("stated_zone")).join(estimated, "account_number")


def p4_hidden_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of each account if no account stated its zone: how many there are, and how many the estimated zones get right."""
    accounts, ledger, fields = (table(spark, sf_dir, n) for n in ("accounts", "ledger_transactions", "field_values"))
    at, bt = account_moments(accounts, ledger, fields)
    guess = estimate_zones(zone_evidence(at, bt), candidate_zones(accounts)).select("account_number", F.col("zone_name").alias("tz_name"))
    hidden = accounts.drop("tz_name").join(guess, "account_number", "left")
    pairs = []
    for stated, guessed in zip((at, bt), account_moments(hidden, ledger, fields)):
        row = ["account_number", "row_id"]
        pairs.append(stated.select(*row, "utc_micros").where("utc_micros is not null").join(guessed.select(*row, F.col("utc_micros").alias("guess")), row))
    both = pairs[0].unionByName(pairs[1])
    return both.groupBy("account_number").agg(F.count(F.lit(1)).alias("moments"), F.count_if(F.col("utc_micros") == F.col("guess")).alias("found"), F.count("guess").alias("read"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_zone_estimates": p4_zone_estimates, "p4_hidden_zones": p4_hidden_zones}

#: Value of an amount text b, for oracle SQL over ASCII amounts; the pattern rules are those of functions.money.
AMOUNT_SQL = r"""
CASE WHEN regexp_full_match(b, '[+-]?\d+(\.\d{1,2})?') THEN CAST(b AS DECIMAL(38,2))
     WHEN regexp_full_match(b, '[+-]?\d{1,3}(,\d{3})+\.\d{1,2}|[+-]?\d{1,3}(,\d{3}){2,}|[+-]?\d+,\d{3}') THEN CAST(replace(b, ',', '') AS DECIMAL(38,2))
     WHEN regexp_full_match(b, '[+-]?\d+,\d{1,2}') THEN CAST(replace(b, ',', '.') AS DECIMAL(38,2)) END
"""


def _p3_side(name: str) -> str:
    return rf"""
SELECT DISTINCT sample_id, page_index, row_index, k,
       CASE WHEN k NOT IN ('transaction_amount', 'balance') THEN v
            WHEN amount IS NULL THEN '?' || v
            ELSE '=' || CAST(CASE WHEN wrapped THEN -amount ELSE amount END AS VARCHAR) END AS v
FROM (SELECT *, {AMOUNT_SQL} AS amount
      FROM (SELECT *, regexp_replace(CASE WHEN wrapped THEN substr(a, 2, length(a) - 2) ELSE a END, '^¥?(CNY)?', '') AS b
            FROM (SELECT *, starts_with(a, '(') AND ends_with(a, ')') AS wrapped
                  FROM (SELECT sample_id, t.page_index AS page_index, t.row_index AS row_index, e.key AS k, e.value AS v,
                               replace(regexp_replace(e.value, '\s', '', 'g'), '￥', '¥') AS a
                        FROM (SELECT sample_id, t, unnest(map_entries(t.fields)) AS e
                              FROM (SELECT sample_id, unnest(transactions) AS t FROM {name}))
                        WHERE e.value IS NOT NULL))))
"""


def _p3_keys(name: str) -> str:
    return f"SELECT DISTINCT sample_id, t.page_index AS page_index, t.row_index AS row_index FROM (SELECT sample_id, unnest(transactions) AS t FROM {name})"


ORACLE = {
    "p3_found": f"""
WITH pk AS ({_p3_keys("golden_primary")}), mk AS ({_p3_keys("golden_mirror")}),
     pv AS ({_p3_side("golden_primary")}), mv AS ({_p3_side("golden_mirror")})
SELECT *, 'only_primary' AS difference FROM (SELECT * FROM pk EXCEPT SELECT * FROM mk)
UNION ALL SELECT *, 'only_mirror' FROM (SELECT * FROM mk EXCEPT SELECT * FROM pk)
UNION ALL SELECT DISTINCT sample_id, page_index, row_index, k
FROM ((SELECT * FROM pv EXCEPT SELECT * FROM mv) UNION ALL (SELECT * FROM mv EXCEPT SELECT * FROM pv)) d
JOIN pk USING (sample_id, page_index, row_index) JOIN mk USING (sample_id, page_index, row_index)
"""
}
