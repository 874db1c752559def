"""Queries of the llm problems, over whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import canonical_text, dress_dedup, name_link, packing, reading_level, tokenize
from ledgerloom.plans.general_data import AMOUNT_SQL
from ledgerloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.same_look(table(spark, sf_dir, "field_values").select("field_id", "raw_text", "suggested_text"), "raw_text", "suggested_text").select("field_id")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of both texts of every field value."""
    rows = table(spark, sf_dir, "field_values")
    return rows.select("field_id", canonical_text.canonical_text("raw_text").alias("raw_form"), canonical_text.canonical_text("suggested_text").alias("suggested_form"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_link.link_records(table(spark, sf_dir, "ledger_transactions"), table(spark, sf_dir, "counterparties"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register entry that every record means, if any, names written exactly like it included."""
    return name_link.link_records(table(spark, sf_dir, "ledger_transactions"), table(spark, sf_dir, "counterparties"), exact_too=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dress_dedup.copy_pairs(table(spark, sf_dir, "candidates"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dress_dedup.collapse(table(spark, sf_dir, "candidates"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded from its ids: digest and bytes of the text, and whether its last token begins inside of it."""
    encoded = tokenize.encode_documents(table(spark, sf_dir, "documents"), offsets=True)
    last = encoded.withColumn("last_offset", F.coalesce(F.get("offsets", F.size("offsets") - 1), F.lit(-1)))
    size = F.octet_length("text")
    return tokenize.decode_documents(last, keep=("last_offset",)).select("doc_id", F.md5("text").alias("digest"), size.alias("bytes"), (F.col("last_offset") < size).alias("inside"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, sf_dir))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("demanding > 0.5").select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p2_found": p2_found,
    "p2_links": p2_links,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

_P5_KEYS = rf"""
SELECT candidate_id, string_agg(part, '' ORDER BY part) AS k
FROM (SELECT candidate_id, k || ':' || CASE
          WHEN v IS NULL THEN '-'
          WHEN k IN ('transaction_amount', 'balance') AND amount IS NOT NULL THEN '=' || CAST(CASE WHEN wrapped THEN -amount ELSE amount END AS VARCHAR)
          WHEN k IN ('transaction_amount', 'balance') THEN '?' || plain ELSE '+' || plain END || ';' AS part
      FROM (SELECT *, {AMOUNT_SQL} AS amount
            FROM (SELECT *, regexp_replace(CASE WHEN wrapped THEN substr(a, 2, length(a) - 2) ELSE a END, '^¥?(CNY)?', '') AS b
                  FROM (SELECT *, starts_with(a, '(') AND ends_with(a, ')') AS wrapped
                        FROM (SELECT candidate_id, e.key AS k, e.value.raw_text AS v,
                                     replace(regexp_replace(e.value.raw_text, '\s', '', 'g'), '￥', '¥') AS a,
                                     regexp_replace(lower(e.value.raw_text), '[\p{{P}}\p{{Z}}\s$+<=>^`|~]', '', 'g') AS plain
                              FROM (SELECT candidate_id, unnest(map_entries(fields)) AS e FROM candidates))))))
GROUP BY candidate_id
"""

ORACLE = {
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS INTEGER) AS bytes, true AS inside FROM documents",
    "p5_found": f"""
WITH keys AS ({_P5_KEYS})
SELECT candidate_id_a, candidate_id AS candidate_id_b
FROM (SELECT candidate_id, min(candidate_id) OVER (PARTITION BY k) AS candidate_id_a FROM keys)
WHERE candidate_id <> candidate_id_a
""",
    "p5_records": f"WITH keys AS ({_P5_KEYS}) SELECT min(candidate_id) AS candidate_id, count(*) AS copies FROM keys GROUP BY k",
}
