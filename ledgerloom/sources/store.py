"""Tables of project stores: SQLite files, each read where its bytes are."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.nested import fields_from_json

# Tables of a store and their columns; later versions of a store may have more, earlier ones fewer.
TABLES = {
    "projects": "id bigint, name string, source_path string, created_at string",
    "runs": "id bigint, project_id bigint, status string, manifest_json string, source_sha256 string, created_at string, updated_at string",
    "pages": "run_id bigint, page_index int, status string, error string",
    "candidates": "run_id bigint, page_index int, row_index int, parser_id string, status string, fields_json string, duplicate_of_page_index int, duplicate_of_row_index int, review_order int",
    "validation_reports": "run_id bigint, page_index int, checked_rows int, issues_json string, balances_json string, status string, risk_score int, reasons_json string",
    "ocr_blocks": "run_id bigint, page_index int, block_index int, text string, raw_text string, polygon_json string, confidence double, source_type string, engine_id string, text_block_id string",
    "review_events": "id bigint, run_id bigint, page_index int, row_index int, action string, before_json string, after_json string, reviewer string, created_at string",
}


def read_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of one table of all stores below a path: store, the file's path, and the table's columns.

    A file is opened as it is read, so stores of any number are read in parallel; one store is one task's
    work. A table or column that a store lacks gives no rows or null; a file that is no store fails the read.
    """
    schema = TABLES[name]
    wanted = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                store = sqlite3.connect(":memory:")
                store.deserialize(content)
                there = {row[1] for row in store.execute(f"PRAGMA table_info({name})")}
                if there:
                    cursor = store.execute(f"SELECT {', '.join(c if c in there else f'NULL AS {c}' for c in wanted)} FROM {name}")
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=wanted, dtype=object).assign(store=path)[["store", *wanted]]
                store.close()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"store string, {schema}")


def stored_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of read_store(..., 'candidates') as the operators take them; a document is a run of a store."""
    duplicate = F.struct(F.col("duplicate_of_page_index").alias("page_index"), F.col("duplicate_of_row_index").alias("row_index"))
    return rows.select(
        F.xxhash64("store", "run_id", "page_index", "row_index").alias("candidate_id"), F.concat_ws("#", "store", "run_id").alias("statement_id"), "page_index", "row_index", "parser_id",
        fields_from_json("fields_json").alias("fields"), "status", F.when(F.col("duplicate_of_page_index").isNotNull(), duplicate).alias("duplicate_of"), "review_order",
    )
