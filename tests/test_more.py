"""Rows without rules, second readings, merged layers, finished runs, JSON forms, sinks."""

import csv
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import nested, text
from ledgerloom.operators import evaluate, layout, ledger, pages, runs
from ledgerloom.sources import assets
from tests.test_layout import COLUMNS, GRID, blocks, fields, page, template


def test_rows_by_height(spark):
    t = template(spark, COLUMNS, required=("date",), strategy="wired")
    found, outcome = layout.parse_rows(page(spark), blocks(spark, GRID), t)
    assert fields(found) == {1: {"date": "2026-08-01", "amount": "10.00"}, 2: {"date": "2026-08-02", "amount": "20.00"}}
    assert outcome.first()["candidates"] == 2
    lost = [b for b in GRID if b[0] != "2026-08-02"]
    found, outcome = layout.parse_rows(page(spark), blocks(spark, lost), t)
    assert found.count() == 0 and outcome.first()["status"] == "failed" and "2" in outcome.first()["reason"]
    assert layout.parse_rows(page(spark), blocks(spark, GRID[:2]), t)[1].first()["reason"] == "no rows on the page"


def test_recovered_grid(spark):
    p = page(spark, [0.0, 15.0, 45.0])

    def read(regions):
        text_ = F.when(F.col("field_name") == "date", "2026-08-01").otherwise("7,00")
        return regions.select("doc_id", "page_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_index", "x0")).alias("block_index"), text_.alias("text"), "x0", "y0", "x1", "y1", F.lit(0.9).alias("confidence"), F.lit("ocr").alias("source_type"))

    found, _ = layout.recover_grid(p, template(spark, COLUMNS), read)
    assert fields(found) == {1: {"date": "2026-08-01", "amount": "7,00"}}
    assert found.first()["fields"]["amount"]["suggested_text"] == "7.00"


def test_second_readings(spark, candidates):
    c = candidates([("s", 0, 0, {"transaction_date": "2O26", "balance": "x", "note": "n"}), ("s", 0, 1, {"balance": "1"})])
    r = spark.createDataFrame([("s", 0, 0, "transaction_date", "2026年8月1日"), ("s", 0, 0, "balance", "?"), ("s", 0, 0, "note", "  "), ("s", 0, 0, "other", "5")], "statement_id string, page_index int, row_index int, field_name string, text string")
    got = {x["row_index"]: x["fields"] for x in layout.apply_readings(c, r, ledger.KEY).collect()}
    assert (got[0]["transaction_date"]["secondary_text"], got[0]["transaction_date"]["suggested_text"], got[0]["transaction_date"]["raw_text"]) == ("2026年8月1日", "2026-08-01", "2O26")
    assert (got[0]["balance"]["secondary_text"], got[0]["balance"]["suggested_text"]) == ("?", "x")
    assert got[0]["note"]["secondary_text"] is None and got[1]["balance"]["secondary_text"] is None and "other" not in got[0]


def test_layers_and_reading_order(spark):
    native = spark.createDataFrame([("d", 0, 0, "Ａ", 0.0, 0.0, 9.0, 9.0, None, "native_pdf")], schemas.BLOCKS)
    ocr = spark.createDataFrame([("d", 0, 0, "a", 0.0, 0.0, 9.0, 9.0, 0.9, "ocr"), ("d", 0, 1, "b", 20.0, 0.0, 29.0, 9.0, 0.9, "ocr"), ("d", 1, 0, "c", 0.0, 0.0, 9.0, 9.0, 0.9, "ocr")], schemas.BLOCKS)
    both = pages.merge_layers(native, ocr)
    assert sorted((r["page_index"], r["block_index"], r["text"]) for r in both.collect()) == [(0, 0, "Ａ"), (0, 2, "b"), (1, 0, "c")]
    mixed = blocks(spark, [("two", 5, 1, 9, 2), ("three", 0, 5, 4, 6), (" ", 0, 0, 1, 1), ("one", 0, 1, 4, 2)])
    assert pages.reading_text(mixed, ["doc_id"]).first()["text"] == "one two three"


def test_finished_runs(spark, candidates):
    c = candidates([("s", 0, 0, {"transaction_date": "20260801", "transaction_amount": "1", "balance": "1"}), ("t", 0, 0, {"balance": "?"})])
    p = spark.createDataFrame([("s", 0, "completed", None), ("t", 0, "completed", None), ("t", 1, "pending", None)], "statement_id string, page_index int, status string, error string")
    reports, fresh, done = runs.finalize_runs(p, c)
    assert {r["statement_id"]: r["status"] for r in done.collect()} == {"s": "completed", "t": "needs_review"}
    assert {(r["statement_id"], r["page_index"]): r["status"] for r in fresh.collect()} == {("s", 0): "completed", ("t", 0): "needs_review", ("t", 1): "pending"}
    plain = {r["statement_id"]: (r["status"], r["risk_score"], r["reasons"]) for r in ledger.plain_reports(c, ledger.validation_issues(c)).collect()}
    assert plain == {"s": ("pass", 0, []), "t": ("review", 20, ["missing_amount", "invalid_amount", "invalid_balance"])}


def test_json_forms(spark, candidates):
    c = candidates([("s", 0, 0, {"b": ("x", None, "y", 0.5, [1, 2]), "a": ("ü", "u")}), ("s", 0, 1, None)])
    both = c.withColumn("j", nested.fields_to_json("fields")).withColumn("back", nested.fields_from_json("j"))
    rows = both.orderBy("row_index").collect()
    assert rows[0]["back"] == rows[0]["fields"] and list(json.loads(rows[0]["j"])) == ["a", "b"] and rows[1]["j"] is None and rows[1]["back"] is None
    assert spark.createDataFrame([("{nonsense",)], "t string").select(nested.fields_from_json("t")).first()[0] is None
    span = spark.createDataFrame([([(0, "b1", [(1.0, 2.0), (3.0, 4.5)])],), ([],)], "s array<struct<page_index:int,text_block_id:string,polygon:array<struct<x:double,y:double>>>>")
    assert [r[0] for r in span.select(nested.spans_json("s")).collect()] == ['[{"page_index":0,"text_block_id":"b1","polygon":[[1.0,2.0],[3.0,4.5]]}]', None]
    a = spark.createDataFrame([([1, 2], [2, 3]), (None, [3])], "a array<int>, b array<int>")
    assert [r[0] for r in a.select(nested.ordered_distinct(F.col("a"), F.col("b"))).collect()] == [[1, 2, 3], [3]]
    names = spark.createDataFrame([("a/b:c?.pdf",), (" .. ",), (None,)], "n string")
    assert [r[0] for r in names.select(text.safe_name("n")).collect()] == ["a_b_c_.pdf", "results", "results"]
    assert [r[0] for r in names.select(text.needs_wide_font(F.lit("é")), text.needs_wide_font(F.lit("中"))).collect()][0] is False
    specs = spark.createDataFrame([("a:0:0.5, b:0.5:1",), ("a:0",), ("",)], "t string")
    assert [None if r[0] is None else [tuple(c) for c in r[0]] for r in specs.select(layout.column_spec("t")).collect()] == [[("a", 0.0, 0.5), ("b", 0.5, 1.0)], None, None]


def test_lines(spark):
    rows = [("d", 0, 0.0, 10.0, 100.0, 10.0, 1.0), ("d", 0, 0.0, 5.0, 100.0, 6.0, 1.0), ("d", 0, 0.0, 50.0, 20.0, 50.0, 1.0), ("d", 0, 0.0, 60.0, 100.0, 60.0, 30.0), ("d", 0, 5.0, 0.0, 5.0, 90.0, 1.0)]
    lines = spark.createDataFrame(rows, "doc_id string, page_index int, x0 double, y0 double, x1 double, y1 double, thickness double")
    assert layout.ruling_boundaries(lines, 50.0).first()["boundaries"] == [5.5, 10.0]
    assert layout.skew_angle(lines).first()["angle"] == 0.0
    tilted = lines.withColumn("y1", F.col("y0") + (F.col("x1") - F.col("x0")) * 0.02)
    assert round(layout.skew_angle(tilted).first()["angle"], 2) == 1.15


def test_sinks(spark, tmp_path):
    key = ["page_index", "row_index"]
    truth = spark.createDataFrame([(0, 0, {"balance": "5.00"})], "page_index int, row_index int, fields map<string,string>")
    metrics = evaluate.gate_metrics(truth, truth, truth.limit(0), key)
    assert evaluate.write_gate_report(metrics, str(tmp_path / "gate")) is False  # no dates or amounts to be exact about
    part = next((tmp_path / "gate/csv").glob("*.csv"))
    assert next(csv.DictReader(part.open()))["truth_rows"] == "1"
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack/a.json").write_text("{}")
    assets.write_manifest(assets.file_digests(spark, str(tmp_path / "pack")), str(tmp_path / "manifest"))
    assert assets.verify_pack(spark, str(tmp_path / "pack"), str(tmp_path / "manifest")).count() == 0
    (tmp_path / "pack/a.json").write_text("{} ")
    (tmp_path / "pack/b.json").write_text("{}")
    assert {r["name"]: r["verdict"] for r in assets.verify_pack(spark, str(tmp_path / "pack"), str(tmp_path / "manifest")).collect()} == {"a.json": "changed", "b.json": "unlisted"}


def test_task_logs_are_folded_in_chunks(spark, monkeypatch):
    import random

    from ledgerloom.operators import runs

    rng = random.Random(3)
    actions = sorted({a for _, a in runs.TASK_STEPS})
    log = [(t, k, rng.choice(actions)) for t in range(12) for k in range(rng.randint(1, 60))]
    expected = {}
    for t, _, a in log:
        state, attempt = expected.get(t, ("queued", 1))
        to = runs.TASK_STEPS.get((state, a))
        expected[t] = (to or state, attempt + (to is not None and a == "restart"))
    events = spark.createDataFrame(log, "task_id int, ord int, action string")
    for chunk in (1, 7, 1000):
        monkeypatch.setattr(runs, "LOG_CHUNK", chunk)
        assert {r["task_id"]: (r["state"], r["attempt"]) for r in runs.task_states(events).collect()} == expected
    assert runs.task_states(events.limit(0)).count() == 0
