"""Project stores in SQLite files, and the built-in layouts."""

import json
import sqlite3

import pytest

from ledgerloom.operators import ledger, runs
from ledgerloom.sources import assets, store


@pytest.fixture
def stores(tmp_path):
    for k in range(3):
        db = sqlite3.connect(tmp_path / f"s{k}.sqlite")
        db.execute("create table projects(id integer primary key, name text, source_path text, created_at text)")
        db.execute("create table runs(id integer primary key, project_id integer, status text, manifest_json text, created_at text)")  # an early one, without digests
        db.execute("insert into projects values (1, ?, 'a.pdf', 'now')", (f"p{k}",))
        db.executemany("insert into runs values (?, 1, 'running', '{}', 'now')", [(n,) for n in range(k + 1)])
        if k:
            db.execute("create table candidates(run_id integer, page_index integer, row_index integer, parser_id text, status text, fields_json text, duplicate_of_page_index integer, duplicate_of_row_index integer, review_order integer)")
            fields = lambda a: json.dumps({"transaction_date": {"raw_text": "2026-01-01", "suggested_text": "2026-01-01"}, "transaction_amount": {"raw_text": a, "suggested_text": a, "source_block_indices": [1]}})
            db.executemany("insert into candidates values (0, 0, ?, 'g', 'unreviewed', ?, ?, ?, null)", [(n, fields(f"{n}.00"), *((0, 0) if n == 2 else (None, None))) for n in range(3)])
        db.commit()
        db.close()
    return str(tmp_path)


def test_stores(spark, stores):
    run = store.read_store(spark, stores, "runs")
    assert run.count() == 6 and run.where("source_sha256 is not null").count() == 0
    projects = store.read_store(spark, stores, "projects")
    joined = runs.project_runs(projects.withColumnRenamed("id", "project_id").select("store", "project_id", "name"), run.select("store", "id", "project_id"), ["store", "project_id"])
    assert sorted(r["name"] for r in joined.collect()) == ["p0", "p1", "p1", "p2", "p2", "p2"]
    rows = store.stored_candidates(store.read_store(spark, stores, "candidates"))
    assert rows.count() == 6 and rows.where("duplicate_of is not null").count() == 2
    assert {r["fields"]["transaction_amount"]["raw_text"] for r in rows.collect()} == {"0.00", "1.00", "2.00"}
    assert ledger.reviewed_rows(rows).count() == 6 and store.read_store(spark, stores, "ocr_blocks").count() == 0


def test_known_layouts(spark):
    known = assets.known_templates(spark)
    assert [r["template_id"] for r in known.orderBy("template_ord").collect()] == ["bohai_detail_v1", "online_statement_v1"]
    assert assets.template_faults(known).count() == 0 and all(len(r["columns"]) == len(r["header_tokens"]) == 8 for r in known.collect())


def test_confirmed_templates_requeue_their_runs(spark):
    column = "array<struct<name:string,left_ratio:double,right_ratio:double>>"
    temporary = spark.createDataFrame([("r1", "good", [("a", 0.0, 0.5), ("b", 0.5, 1.0)]), ("r2", "lap", [("a", 0.0, 0.6), ("b", 0.5, 1.0)]), ("r3", "none", [])], f"run string, template_id string, columns {column}")
    pages = spark.createDataFrame([(r, k, s, "why") for r in ("r1", "r2", "r3") for k, s in enumerate(("needs_review", "completed"))], "run string, page_index int, status string, error string")
    confirmed, faults, after = runs.confirm_templates(temporary, pages, ["run"])
    assert [r["template_id"] for r in confirmed.collect()] == ["good"] and {r["template_id"]: r["fault"] for r in faults.collect()} == {"lap": "overlap", "none": "no_columns"}
    state = {(r["run"], r["page_index"]): (r["status"], r["error"]) for r in after.collect()}
    assert state["r1", 0] == ("pending", None) and state["r1", 1] == ("completed", "why") and state["r2", 0] == state["r3", 0] == ("needs_review", "why")
