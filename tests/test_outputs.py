"""Exports, evaluation, review, run state, sources and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import geometry
from ledgerloom.operators import evaluate, export, ledger, review, runs
from ledgerloom.plans.layout_queries import templates
from ledgerloom.sources import assets


def everything(c):
    issues = ledger.validation_issues(c)
    return c, issues, ledger.page_reports(c, issues), ledger.transaction_records(c)


@pytest.fixture
def built(candidates):
    rows = [
        ("s", 0, 0, {"transaction_date": "2026-08-01", "transaction_amount": ("10,00", "10.00", None, 0.5, [0, 1]), "balance": "110"}, "accepted"),
        ("s", 0, 1, {"transaction_date": "2026-08-02", "transaction_amount": "-5", "balance": "999"}, "duplicate", (0, 0)),
        ("s", 1, 0, {"description": "x"}, "rejected"),
    ]
    return everything(candidates(rows))


def test_exports(built, spark):
    c, issues, reports, records = built
    rows = ledger.reviewed_rows(c)
    wide = {(r["page_index"], r["row_index"]): r for r in export.transactions_wide(rows).collect()}
    assert wide[0, 0]["date"] == "2026-08-01" and wide[0, 0]["transaction_amount.raw"] == "10,00" and wide[0, 0]["comparison_id"] == "T0001"
    assert wide[0, 1]["transaction_id"] is None and wide[0, 1]["duplicate_reference"] == "0:0" and wide[0, 0]["source_location_status"] == "unlocated"
    assert wide[1, 0]["summary"] == "x" and "description.final" in wide[1, 0].asDict()
    metrics = {r["metric"]: r["value"] for r in export.processing_report(rows).collect()}
    assert (metrics["transaction_count"], metrics["duplicate_count"], metrics["page_count"], metrics["critical_issue_count"]) == ("3", "1", "2", "1")
    index = {(r["row_index"], r["field_name"]): r for r in export.source_index(rows).where("page_index = 0").collect()}
    assert index[0, "transaction_amount"]["source_block_indices"] == "0,1" and index[0, "transaction_amount"]["rule_state"] == "indeterminate"
    assert index[1, "balance"]["rule_state"] == "fail" and index[0, "balance"]["rule_state"] == "pass"
    errors = spark.createDataFrame([("s", 7)], "statement_id string, page_index int")
    queue = export.review_queue(rows, errors).orderBy("queue_order").collect()
    assert queue[-1]["code"] == "page_error" and queue[-1]["row_index"] == -1 and [r["queue_order"] for r in queue] == list(range(1, len(queue) + 1))
    assert export.unresolved_counts(rows, errors).first()["unresolved"] == 4
    colors = {(r["page_index"], r["row_index"]): r["color"] for r in export.marker_colors(rows).collect()}
    assert colors == {(0, 0): "amber", (0, 1): "grey", (1, 0): "grey"}
    assert json.loads(export.run_summaries(c, reports).first()["summary"])["pages"][0]["candidates"] == 2
    assert export.layout_index(c).where("page_index = 1").first()["field_summary"] == "description=x"
    blocks = spark.createDataFrame([("s", 0, 0, 1.0, 2.0, 3.0, 4.0), ("s", 0, 1, 2.0, 0.5, 9.0, 3.0)], "statement_id string, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    stored = ledger.reviewed_rows(c, reports=reports.where("page_index = 0").withColumn("status", F.lit("page_review")))
    assert {(r["page_index"], r["report_status"]) for r in stored.collect()} == {(0, "page_review"), (1, "unknown")}
    assert export.unresolved_counts(stored, errors).first()["unresolved"] == 3
    assert {(r["page_index"], r["status"]) for r in reports.collect()} == {(r["page_index"], r["report_status"]) for r in rows.collect()}
    by_field = {(r["row_index"], r["field_name"]): r["source_bbox"] for r in export.source_index(rows, blocks).where("page_index = 0").collect()}
    assert by_field[0, "transaction_amount"] == "1,0.5,9,4" and by_field[0, "balance"] is None
    assert export.source_index(ledger.reviewed_rows(c.limit(0))).count() == 0
    boxes = export.candidate_boxes(c, blocks)
    located = {r["row_index"]: r["source_box"] for r in export.transactions_wide(rows, boxes).where("page_index = 0").collect()}
    assert located == {0: "1,0.5,9,4", 1: None}


def test_too_many_columns_are_refused(candidates):
    with pytest.raises(ValueError):
        export.field_names(candidates([("s", 0, 0, {f"f{k}": "x" for k in range(5)})]), most=4)


def test_box_text_matches_general_format(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, 0.5, 123.456, 99999.4, 12345.678, 1.25, 100.0] + [round(rng.uniform(0, 2000), rng.randint(0, 2)) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(geometry.box_text(F.col("v"), F.col("v"), F.col("v"), F.col("v"))).collect()]
    assert got == [",".join([f"{v:g}"] * 4) for v in values]


def test_evaluation(spark):
    schema = "page_index int, row_index int, fields map<string,string>"
    truth = spark.createDataFrame([(0, 0, {"transaction_date": "2026-01-01", "balance": "5.00"}), (0, 1, {"transaction_amount": "-43.54"})], schema)
    got = spark.createDataFrame([(0, 0, {"date": "20260101", "transaction_date": "20260101"}), (0, 1, {"transaction_amount": "-43.54"}), (0, 9, {"x": "y"})], schema)
    key = ["page_index", "row_index"]
    verdicts = evaluate.compare_fields(truth, got, key)
    assert sorted((r["row_index"], r["field_name"], r["verdict"]) for r in verdicts.where("field_name is not null").collect()) == [(0, "balance", "missing"), (0, "transaction_date", "mismatch"), (1, "transaction_amount", "exact")]
    r = evaluate.field_accuracy(verdicts, []).first()
    assert (r["total_fields"], r["exact_matches"], r["extra_rows"]) == (3, 1, 1)
    m = evaluate.gate_metrics(truth, got, got.where("row_index = 9"), key).first()
    assert (m["transaction_recall"], m["date_exact"], m["balance_exact"], m["silent_critical_errors"], m["gate_passed"]) == (1.0, 1.0, 0.0, 1, False)
    assert "silent_critical_errors!=0" in m["gate_reasons"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_character_accuracy(spark):
    rng = random.Random(9)
    pairs = [("".join(rng.choice("ab中é") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab中é") for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    t = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "p int, text string")
    r = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(pairs)], "p int, text string")
    got = evaluate.character_accuracy(r, t, ["p"]).first()
    assert got["exact_pages"] == sum(a == b for a, b in pairs) and got["unmatched_pages"] == 0
    assert got["character_accuracy"] == pytest.approx(max(0, 1 - sum(edits(a, b) for a, b in pairs) / sum(len(a) for a, _ in pairs)))
    five = evaluate.character_accuracy(spark.createDataFrame([(0, "ABC"), (1, "12")], "p int, text string"), spark.createDataFrame([(0, "ABC"), (1, "123")], "p int, text string"), ["p"]).first()
    assert five["character_accuracy"] == pytest.approx(5 / 6)


EVENTS = "statement_id string, page_index int, row_index int, ord int, action string, field_name string, value string, related_page_index int, related_row_index int"


def test_review_fold(candidates, spark):
    c = candidates([("s", 0, k, {"balance": (str(k), f"s{k}")}) for k in range(5)])
    ev = [
        ("s", 0, 0, 1, "edit", "balance", "A", None, None), ("s", 0, 0, 2, "edit", "balance", "B", None, None), ("s", 0, 0, 3, "accept", None, None, None, None), ("s", 0, 0, 4, "edit", "balance", "late", None, None),
        ("s", 0, 1, 1, "accept", None, None, None, None), ("s", 0, 2, 1, "accept", None, None, None, None), ("s", 0, 2, 2, "reject", None, None, None, None),
        ("s", 0, 3, 1, "mark_duplicate", None, None, 0, 0), ("s", 0, 4, 1, "mark_duplicate", None, None, 0, 4),
    ]
    events = spark.createDataFrame(ev, EVENTS)
    got = {r["row_index"]: r for r in review.apply_review(c, events).collect()}
    assert [got[k]["status"] for k in range(5)] == ["accepted", "accepted", "rejected", "duplicate", "unreviewed"]
    assert got[0]["fields"]["balance"]["final_text"] == "B" and got[1]["fields"]["balance"]["final_text"] == "s1"
    assert tuple(got[3]["duplicate_of"]) == (0, 0)
    assert {(r["row_index"], r["value"]) for r in review.last_edits(events).collect()} == {(0, "late")}
    changed = review.audit(c, review.apply_review(c, events), ["status"])
    assert sorted(r["row_index"] for r in changed.collect()) == [0, 1, 2, 3]


def test_review_structure(candidates, spark):
    c = candidates([("s", 0, k, {"a": str(k), **({"b": "x"} if k != 1 else {})}) for k in range(4)])
    key = "statement_id string, page_index int, row_index int"
    moved = review.move_rows(c, spark.createDataFrame([("s", 0, 3, 0)], f"{key}, target int"))
    assert [r["row_index"] for r in moved.orderBy("review_order").collect()] == [3, 0, 1, 2]
    down = review.move_rows(c, spark.createDataFrame([("s", 0, 0, 2)], f"{key}, target int"))
    assert [r["row_index"] for r in down.orderBy("review_order").collect()] == [1, 2, 0, 3]
    merged = {r["row_index"]: r for r in review.merge_rows(c, spark.createDataFrame([("s", 0, 0, 1)], f"{key}, second_row int")).collect()}
    assert sorted(merged) == [0, 2, 3] and merged[0]["fields"]["a"]["raw_text"] == "0 | 1" and merged[0]["fields"]["b"]["raw_text"] == "x" and merged[0]["parser_id"].startswith("review:merge:")
    split = {r["row_index"]: r for r in review.split_rows(c, spark.createDataFrame([("s", 0, 0, ["b"]), ("s", 0, 1, ["a"])], f"{key}, names array<string>")).collect()}
    assert sorted(split) == [0, 1, 2, 3, 4] and set(split[4]["fields"]) == {"b"} and set(split[0]["fields"]) == {"a"} and split[4]["review_order"] == 1
    added = review.add_rows(c, c.where("row_index = 2"))
    assert sorted(r["row_index"] for r in added.collect()) == [0, 1, 2, 3, 4]
    text = spark.createDataFrame([("date=2026-08-01; balance = 5",), ("date=",), ("nothing",), ("a=1;a=2",), (None,)], "t string")
    assert [r[0] for r in text.select(review.manual_fields("t")).collect()] == [{"date": "2026-08-01", "balance": "5"}, None, None, None, None]
    bad = candidates([("s", 0, 0, {"a": "1"}, "duplicate", (5, 5)), ("s", 0, 0, {"a": "1"}, "unreviewed", None, 1), ("s", 0, 1, {"a": "1"}, "unreviewed", None, 1)])
    assert sorted(r["fault"] for r in review.snapshot_faults(bad).collect()) == ["duplicate_key", "duplicate_order", "unknown_duplicate_of"]
    assert review.snapshot_faults(c).count() == 0


def test_runs(spark, tmp_path):
    p = spark.createDataFrame([("r", 0, "completed", None), ("r", 1, "needs_review", "why"), ("q", 0, "completed", None), ("f", 0, "failed", "x"), ("f", 1, "pending", None)], "run string, page int, status string, error string")
    assert {r["run"]: r["status"] for r in runs.run_status(p, ["run"]).collect()} == {"r": "needs_review", "q": "completed", "f": "failed"}
    assert sorted((r["run"], r["page"]) for r in runs.resume_pages(runs.requeue_review(p)).collect()) == [("f", 0), ("f", 1), ("r", 1)]
    reports = spark.createDataFrame([("q", 0, "pass", 2), ("r", 1, "pass", 0)], "run string, page int, status string, open_issues int")
    fresh = {(r["run"], r["page"]): (r["status"], r["error"]) for r in runs.refresh_pages(p, reports, ["run", "page"]).collect()}
    assert fresh == {("r", 0): ("completed", None), ("r", 1): ("needs_review", "why"), ("q", 0): ("needs_review", None), ("f", 0): ("failed", "x"), ("f", 1): ("pending", None)}
    assert {r["status"] for r in runs.refresh_pages(p, reports, ["run", "page"], promote_only=True).where("run = 'r'").collect()} == {"completed"}
    up = runs.upsert(p, p.where("run = 'q'").withColumn("status", F.lit("failed")), ["run", "page"])
    assert up.count() == 5 and up.where("run = 'q'").first()["status"] == "failed"
    log = spark.createDataFrame([("s", 1, "activate", "v1"), ("s", 2, "activate", "V1"), ("s", 3, "activate", "v2"), ("s", 4, "rollback", None), ("t", 1, "rollback", None)], "slot string, ord int, action string, version string")
    assert {r["slot"]: (r["current"], r["previous"]) for r in runs.version_slots(log).collect()} == {"s": ("V1", "v2"), "t": (None, None)}
    ev = spark.createDataFrame([("a", k, x) for k, x in enumerate(["start", "pause", "resume", "start", "fail", "restart", "complete"])], "task_id string, ord int, action string")
    assert tuple(runs.task_states(ev).first())[1:] == ("queued", 2)
    a = spark.createDataFrame([("x", "1"), ("y", None)], "name string, value string")
    assert runs.same_run(a, a) and not runs.same_run(a, a.where("name = 'x'"))
    out = str(tmp_path / "t")
    runs.replace_partitions(p, out, ["run"])
    runs.replace_partitions(p.where("run = 'f' and page = 0"), out, ["run"])
    assert spark.read.parquet(out).count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"template_id": "b", "header_tokens": ["x"], "columns": [{"name": "n", "left_ratio": 0.5, "right_ratio": 0.4}]}))
    (tmp_path / "a.json").write_text(json.dumps({"template_id": "a", "version": "2", "header_tokens": ["x"], "columns": [{"name": "n", "left_ratio": 0.0, "right_ratio": 0.6}, {"name": "m", "left_ratio": 0.5, "right_ratio": 0.9}], "row_strategy": "anchor_date", "required_fields": ["n"]}))
    (tmp_path / "manifest.json").write_text("{}")
    got = assets.read_templates(spark, str(tmp_path / "*.json")).orderBy("template_ord").collect()
    assert [(r["template_id"], r["row_strategy"], r["header_y_ratio"], r["required_fields"]) for r in got] == [("a", "anchor_date", 0.25, ["n"]), ("b", "grid", 0.25, [])]
    assert {r["template_id"]: r["fault"] for r in assets.template_faults(assets.read_templates(spark, str(tmp_path / "*.json"))).collect()} == {"a": "overlap", "b": "bad_range"}
    assert assets.template_faults(templates(spark)).count() == 0
    digests = assets.file_digests(spark, str(tmp_path), (".json",))
    assert digests.count() == 3 and len(digests.first()["sha256"]) == 64
    (tmp_path / "c.json").write_text(json.dumps({"template_id": "a", "header_tokens": [], "columns": []}))
    with pytest.raises(ValueError):
        assets.read_templates(spark, str(tmp_path / "*.json"))
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "s1.json").write_text(json.dumps({"transactions": [{"page_index": 0, "row_index": 1, "fields": {"balance": "5"}}]}))
    assert assets.read_truth(spark, str(truth)).first()["sample_id"] == "s1.json"
    (truth / "s2.json").write_text(json.dumps({"transactions": [{"page_index": 0, "row_index": -1, "fields": {}}]}))
    with pytest.raises(ValueError):
        assets.read_truth(spark, str(truth))
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.7 ...")
    assert assets.pdf_files(spark, str(tmp_path)).count() == 1


def test_stream_matches_batch(spark, tmp_path):
    from ledgerloom.streaming.ledger_stream import run_to_table, validate_stream

    rng = random.Random(2)
    rows = [(f"s{k % 3}", 0, k, k, str(rng.randint(-2, 2)), str(rng.randint(0, 3)) if rng.random() < 0.9 else None, rng.choice([None, 1, 2, 3])) for k in range(60)]
    schema = "stream string, page_index int, row_index int, candidate_id bigint, amount string, balance string, day int"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows[:30], schema).coalesce(1).write.parquet(path)
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.mode("append").parquet(path)
    run_to_table(validate_stream(spark.readStream.schema(schema).parquet(path)), "issues_out")
    got = sorted((r["candidate_id"], r["code"]) for r in spark.table("issues_out").collect())
    expected, last, days, turn = [], {}, {}, {}
    for s, _, _, k, a, b, d in rows:
        if last.get(s) is not None and b is not None and last[s] + int(a) != int(b):
            expected += [(k, "balance_mismatch"), (k, "possible_missing_transaction")]
        last[s] = None if b is None else int(b)
        if d is not None:
            t = 0 if s not in days else (d > days[s]) - (d < days[s])
            if t and turn.get(s) and t != turn[s]:
                expected.append((k, "date_order"))
            turn[s], days[s] = turn.get(s) or t, d
    assert got == sorted(expected)
