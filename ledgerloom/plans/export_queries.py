"""Queries of exports, evaluation, review and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import geometry
from ledgerloom.functions.ids import template_fingerprint
from ledgerloom.functions.money import parse_amount
from ledgerloom.functions.nested import fields_from_json, fields_to_json
from ledgerloom.operators import evaluate, export, ledger, review, runs
from ledgerloom.plans import oracle
from ledgerloom.session import table

KEY = ["statement_id", "page_index", "row_index"]
PAGE = ["statement_id", "page_index"]
NAMES = ["balance", "counterparty_name", "transaction_amount", "transaction_date"]


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, their issues, page reports and records."""
    c = table(spark, sf_dir, "candidates")
    issues = ledger.validation_issues(c)
    return c, issues, ledger.page_reports(c, issues), ledger.transaction_records(c)


def comparison_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.comparison_ids(table(spark, sf_dir, "candidates")).select("candidate_id", "comparison_id")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reviewed_rows(table(spark, sf_dir, "candidates"))


def wide_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sheet with the four layers of four fields; column names with underscores for SQL."""
    df = export.transactions_wide(_rows(spark, sf_dir), names=NAMES).drop("source_box", "statement_id", "parser_id")
    return df.toDF(*[n.replace(".", "_") for n in df.columns])


def processing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.processing_report(_rows(spark, sf_dir))


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.source_index(_rows(spark, sf_dir)).select("candidate_id", "transaction_id", "comparison_id", "field_name", "raw_text", "suggested_text", "final_text", "confidence", "source_block_indices", "validation_status", "rule_state", "status")


def _page_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page error for the page after the last of every statement without a source digest."""
    return table(spark, sf_dir, "statements").where("source_sha256 is null").select("statement_id", F.col("page_count").alias("page_index"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = export.review_queue(_rows(spark, sf_dir), _page_errors(spark, sf_dir))
    return df.select("statement_id", "page_index", "row_index", "code", "severity", "rule_state", "field_name", "raw_text", "validation_status", F.col("queue_order").cast("bigint").alias("queue_order"))


def unresolved_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.unresolved_counts(_rows(spark, sf_dir), _page_errors(spark, sf_dir))


def review_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.review_grid(table(spark, sf_dir, "candidates")).select("candidate_id", "field_name", "raw_text", "secondary_text", "suggested_text", "final_text", "status")


def layout_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.layout_index(table(spark, sf_dir, "candidates")).select("candidate_id", "field_summary")


def marker_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.marker_colors(_rows(spark, sf_dir)).select("candidate_id", "color")


def _indexed_blocks(c: DataFrame) -> DataFrame:
    """Blocks for all source indices of the candidates, laid out by their index."""
    index = c.select(*PAGE, F.explode(F.flatten(F.transform(F.map_values("fields"), lambda v: v["source_block_indices"]))).alias("block_index")).where("block_index is not null").distinct()
    return index.select(*PAGE, "block_index", (F.col("block_index") * 10.0).alias("x0"), (F.col("block_index") * 3.0).alias("y0"), (F.col("block_index") * 10.0 + 8).alias("x1"), (F.col("block_index") * 3.0 + 2).alias("y1"))


def issue_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates")
    df = ledger.attach_provenance(ledger.validation_issues(c), c, _indexed_blocks(c))
    return df.select("candidate_id", "emit_ord", F.array_join(F.transform("source_block_indices", lambda i: i.cast("string")), ",").alias("indices"), "x0", "y1")


def candidate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box around each candidate's source blocks, clipped to the page, over blocks laid out by their index."""
    c = table(spark, sf_dir, "candidates")
    blocks = _indexed_blocks(c)
    df = export.candidate_boxes(c, blocks)
    box = geometry.clip(*[F.col(x) for x in ("x0", "y0", "x1", "y1")], F.lit(300.0), F.lit(100.0))
    return df.select(*KEY, "x0", "y0", "x1", "y1", box["x1"].alias("clipped_x1"), box.isNotNull().alias("visible"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON summary of each document says of its pages."""
    c, _, reports, _ = _all(spark, sf_dir)
    df = export.run_summaries(c, reports)
    said = lambda path: F.get_json_object("summary", path)
    return df.select("statement_id", (said("$.document") == F.col("statement_id")).alias("named"), F.json_array_length(said("$.pages")).alias("pages"), said("$.pages[0].status").alias("first_status"), said("$.pages[0].candidates").cast("int").alias("first_rows"), said("$.pages[0].risk_score").cast("int").alias("first_score"))


def _golden(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return evaluate.truth_rows(table(spark, sf_dir, "golden_primary")), evaluate.truth_rows(table(spark, sf_dir, "golden_mirror"))


def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each truth field, the mirror being the prediction."""
    truth, predicted = _golden(spark, sf_dir)
    return evaluate.compare_fields(truth, predicted, ["sample_id", "page_index", "row_index"])


def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.field_accuracy(truth_join(spark, sf_dir), ["sample_id"])
    return df.withColumn("accuracy", F.round("accuracy", 6))


def v1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release metrics of the mirror against the primary; a person looks at every seventh row of a page."""
    key = ["sample_id", "page_index", "row_index"]
    truth, predicted = _golden(spark, sf_dir)
    reviewed = predicted.where(F.col("row_index") % 7 == 0).select(*key)
    df = evaluate.gate_metrics(truth, predicted, reviewed, key)
    return df.select("truth_rows", "predicted_rows", "silent_critical_errors", *[F.round(c, 6).alias(c) for c in ("transaction_recall", "date_exact", "amount_exact", "balance_exact", "row_association", "review_rate")], "gate_passed")


def review_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, issues, reports, _ = _all(spark, sf_dir)
    return evaluate.review_keys(c, reports, issues, PAGE)


def char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of suggested texts as readings of the raw ones, over all field values that have both."""
    rows = table(spark, sf_dir, "field_values").where("suggested_text is not null")
    df = evaluate.character_accuracy(rows.select("field_id", F.col("suggested_text").alias("text")), rows.select("field_id", F.col("raw_text").alias("text")), ["field_id"])
    return df.withColumn("character_accuracy", F.round("character_accuracy", 6))


def reading_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "field_values").select("statement_id", "page_index", F.col("raw_text").alias("text"), "confidence")
    return evaluate.reading_baseline(rows, PAGE)


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page state table from the statements: a row per page, its state from its number and statement."""
    s = table(spark, sf_dir, "statements")
    rows = s.select("statement_id", F.explode(F.sequence(F.lit(0), F.col("page_count"))).alias("page_index"))
    k = F.pmod(F.length("statement_id") * 7 + F.substring("statement_id", -4, 4).cast("int") + F.col("page_index"), F.lit(9))
    state = F.when(k == 0, "failed").when(k == 1, "pending").when(k == 2, "running").when(k == 3, "needs_review").otherwise("completed")
    return rows.select("statement_id", "page_index", state.alias("status"), F.when(k == 0, "unreadable").cast("string").alias("error"))


def resume_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to process after seeding all pages and requeueing those in review."""
    known = _page_table(spark, sf_dir).where("page_index > 0")
    seeds = table(spark, sf_dir, "statements").select("statement_id", F.explode(F.sequence(F.lit(0), F.col("page_count"))).alias("page_index")).withColumn("status", F.lit("pending"))
    return runs.resume_pages(runs.requeue_review(runs.insert_absent(known, seeds, PAGE))).select("statement_id", "page_index", "status")


def page_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_status(_page_table(spark, sf_dir), ["statement_id"])


def refreshed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, issues, reports, _ = _all(spark, sf_dir)
    found = issues.groupBy(*PAGE).agg(F.count_if(~F.col("rule_state").isin("pass", "not_applicable")).alias("open_issues"))
    return runs.refresh_pages(_page_table(spark, sf_dir), reports.join(found, PAGE, "left").fillna(0, ["open_issues"]), PAGE)


def finalized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each statement's run after validating it whole."""
    return runs.finalize_runs(_page_table(spark, sf_dir), table(spark, sf_dir, "candidates"))[2]


def stored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of fields and the amount text of every candidate after a round trip through JSON text."""
    c = table(spark, sf_dir, "candidates").select("candidate_id", fields_from_json(fields_to_json("fields")).alias("f"))
    return c.select("candidate_id", F.size(F.map_keys("f")).alias("fields"), F.try_element_at("f", F.lit("transaction_amount"))["raw_text"].alias("amount_text"))


def plain_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates")
    return ledger.plain_reports(c, ledger.validation_issues(c)).withColumn("reasons", F.array_join("reasons", ","))


def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of each field of each candidate."""
    rows = table(spark, sf_dir, "field_values").select("candidate_id", "field_name", "field_id", "raw_text", "ingested_at")
    return runs.latest_rows(rows, ["candidate_id", "field_name"], ["ingested_at", "field_id"]).select("candidate_id", "field_name", "field_id", "raw_text")


def _edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review events from the event table, dealt to all candidates in turn."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    c = table(spark, sf_dir, "candidates").select(*KEY, "candidate_id")
    last = c.agg(F.max("candidate_id")).first()[0] or 1
    on = e.select((F.pmod("event_id", F.lit(last)) + 1).alias("candidate_id"), F.col("event_id").alias("ord"), "event_type", "value").join(c, "candidate_id")
    action = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "view", "edit").otherwise("reject")
    name = F.when(F.col("event_type") == "click", "balance").otherwise("transaction_amount")
    return on.select(*KEY, "ord", action.alias("action"), name.alias("field_name"), F.col("ord").cast("string").alias("value"), F.lit(None).cast("int").alias("related_page_index"), F.lit(None).cast("int").alias("related_row_index"))


def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.last_edits(_edit_log(spark, sf_dir))


def reviewed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = review.apply_review(table(spark, sf_dir, "candidates"), _edit_log(spark, sf_dir))
    return df.select("candidate_id", "status", F.try_element_at("fields", F.lit("transaction_amount"))["final_text"].alias("final_amount"))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.renumber(table(spark, sf_dir, "candidates")).select("candidate_id", F.col("review_order").cast("bigint").alias("review_order"))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second row of each page merged into the first."""
    c = table(spark, sf_dir, "candidates")
    w = Window.partitionBy(*PAGE).orderBy("row_index")
    pairs = c.select(*KEY, F.lead("row_index").over(w).alias("second_row"), F.row_number().over(w).alias("k")).where("k = 1 and second_row is not null")
    df = review.merge_rows(c, pairs)
    return df.select("candidate_id", F.try_element_at("fields", F.lit("transaction_amount"))["raw_text"].alias("amount_text"), F.size(F.map_keys("fields")).alias("fields"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of every row of an even index split off into a row of its own."""
    c = table(spark, sf_dir, "candidates")
    df = review.split_rows(c, c.where("row_index % 2 = 0").select(*KEY, F.array(F.lit("balance")).alias("names")))
    return df.select("statement_id", "page_index", "row_index", F.size(F.map_keys("fields")).alias("fields"))


def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the candidates after every 33rd was made a copy of no row and every 40th was stored twice."""
    c = table(spark, sf_dir, "candidates")
    lost = F.struct(F.col("page_index"), F.lit(99_999).alias("row_index"))
    c = c.withColumn("duplicate_of", F.when(F.col("candidate_id") % 33 == 0, lost).otherwise(F.col("duplicate_of")))
    return review.snapshot_faults(c.unionByName(c.where("candidate_id % 40 = 0")))


def moved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every page moved to its end, then what was the second one place down."""
    c = table(spark, sf_dir, "candidates")
    w = Window.partitionBy(*PAGE).orderBy(F.coalesce("review_order", "row_index"), "row_index")
    placed = c.select(*KEY, F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*PAGE)).cast("int").alias("n"))
    moves = placed.where("k <= 2").select(*KEY, F.when(F.col("k") == 1, F.col("n") - 1).otherwise(1).alias("target"), F.col("k").alias("ord"))
    return review.move_rows(c, moves).select("candidate_id", F.col("review_order").cast("bigint").alias("review_order"))


def saved_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row accepted and saved, and rows that were never stored: what was updated, what is unknown."""
    c = table(spark, sf_dir, "candidates")
    reviewed = c.where("row_index % 3 = 0").withColumn("status", F.lit("accepted"))
    strange = c.where("row_index % 50 = 0").withColumn("row_index", F.col("row_index") + 100_000)
    after, events, unknown = review.save_review(c, reviewed.unionByName(strange))
    told = events.select(*KEY, F.col("action").alias("what")).unionByName(unknown.withColumn("what", F.lit("unknown")))
    return told.join(after.select(*KEY, "status"), KEY, "left")


def structure_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every even page saved without its last row: an event for each page that changed, with the rows left on it."""
    c = table(spark, sf_dir, "candidates")
    last = F.max("row_index").over(Window.partitionBy(*PAGE))
    reviewed = c.where("page_index % 2 = 0").withColumn("_last", last).where("row_index < _last").drop("_last")
    after, events, _ = review.save_structure_review(c, reviewed)
    return events.select(*KEY, "action").join(after.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("rows")), PAGE, "left")


def affected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of accepted rows and of review events."""
    return review.affected_pages(table(spark, sf_dir, "candidates").where("status = 'accepted'"), _edit_log(spark, sf_dir))


def source_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source index with the box of every field, over blocks laid out by their index."""
    df = export.source_index(_rows(spark, sf_dir), _indexed_blocks(table(spark, sf_dir, "candidates")))
    return df.select("candidate_id", "field_name", "source_spans", "source_bbox")


def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of missing, wrong and extra predictions of each sample."""
    df = evaluate.field_labels(truth_join(spark, sf_dir), ["sample_id"])
    return df.select("sample_id", *[F.array_join(c, ",").alias(c) for c in ("missing", "mismatches", "extra")])


def repeated_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the two copies of the golden samples, taken as one, hold in several versions."""
    return evaluate.repeated_truth(table(spark, sf_dir, "golden_primary").unionByName(table(spark, sf_dir, "golden_mirror")))


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release metrics if the mirror prints every readable amount as income or expense, and the balance as closing balance."""
    key = ["sample_id", "page_index", "row_index"]
    truth, predicted = _golden(spark, sf_dir)
    amount = parse_amount(F.try_element_at("fields", F.lit("transaction_amount")))
    split = F.filter(
        F.array(
            F.struct(F.lit("income_amount").alias("key"), F.when(F.col("_a") >= 0, F.col("_a").cast("string")).alias("value")),
            F.struct(F.lit("expense").alias("key"), F.when(F.col("_a") < 0, (-F.col("_a")).cast("string")).alias("value")),
            F.struct(F.lit("closing_balance").alias("key"), F.try_element_at("fields", F.lit("balance")).alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    rest = F.map_filter("fields", lambda k, _: ~k.isin("transaction_amount", "balance"))
    two = predicted.withColumn("_a", amount).select(*key, F.map_concat(rest, F.map_from_entries(split)).alias("fields"))
    df = evaluate.gate_metrics(truth, two, predicted.limit(0), key)
    return df.select("truth_rows", "predicted_rows", F.round("amount_exact", 6).alias("amount_exact"), F.round("balance_exact", 6).alias("balance_exact"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks from the orders: a queue per priority, the state from the order's status."""
    states = F.create_map(*[F.lit(x) for x in ("F", "completed", "O", "queued", "P", "cancelled")])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("ord"), F.try_element_at(states, F.col("o_orderstatus")).alias("state"))


def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.queue_order(_tasks(spark, sf_dir)).select("task_id", F.col("position").cast("bigint").alias("position"))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.batch_counts(_tasks(spark, sf_dir), ["queue"])


def needs_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reports, _ = _all(spark, sf_dir)
    return runs.needs_review_counts(_page_table(spark, sf_dir), reports, ["statement_id"])


def project_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as runs of their account's project, without the projects of one currency, which are deleted."""
    accounts = table(spark, sf_dir, "accounts").select(F.col("account_number").alias("project_id"), "currency", "bank_code")
    projects, left = runs.delete_project(accounts, table(spark, sf_dir, "statements").select("statement_id", F.col("account_number").alias("project_id")), accounts.where("currency = 'EUR'"))
    return runs.project_runs(projects, left).select("statement_id", "project_id", "currency", "bank_code")


def slot_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after each user's log of activations and rollbacks."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("user_id").alias("slot"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "purchase", "rollback").otherwise("activate").alias("action"), F.col("event_type").alias("version"))
    return runs.version_slots(log)


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task states of each user's events read as task actions."""
    e = table(spark, sf_dir, "events")
    actions = F.array(*[F.lit(a) for a in ("start", "pause", "resume", "complete", "fail", "cancel", "restart")])
    return runs.task_states(e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), F.get(actions, F.pmod(F.col("event_id"), F.lit(7)).cast("int")).alias("action")))


def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against a copy of them with rows lost, added and changed."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_size"), 256).alias("sha256"))
    copy = p.where("p_partkey % 50 <> 0").select(F.when(F.col("p_partkey") % 77 == 0, F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey")).alias("p_partkey"), F.when(F.col("p_partkey") % 31 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return runs.manifest_diff(p, copy, "p_partkey", "sha256")


def pack_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each brand's parts as a pack of files."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), F.sha2(F.concat_ws("|", "p_name", F.col("p_size").cast("string")), 256).alias("sha256"))
    return p.groupBy("p_brand").agg(template_fingerprint().alias("fingerprint"))


def streaming_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity issues of the ledger read as a stream, in one trigger over all files."""
    import uuid

    from pyspark.sql.functions import concat_ws

    from ledgerloom.session import ensure_checkpoint_dir, share_code
    from ledgerloom.streaming.ledger_stream import validate_stream

    share_code(spark)
    mark = f"{ensure_checkpoint_dir(spark)}/ledger-stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/ledger_transactions.parquet"
    schema = spark.read.parquet(path).schema
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    one_file = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isFile()
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "ledger_transactions.parquet" if one_file else "*.parquet").parquet(sf_dir if one_file else path)
    rows = stream.select(
        concat_ws("/", "statement_id", "account_number").alias("stream"), "page_index", "row_index", F.col("record_id").alias("candidate_id"), F.col("amount").cast("string").alias("amount"), F.col("balance").cast("string").alias("balance"), F.lit(None).cast("int").alias("day")
    )
    out = f"{mark}/out"
    validate_stream(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{mark}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream string, page_index int, row_index int, candidate_id bigint, code string").parquet(out).where("code = 'balance_mismatch'").select(F.col("candidate_id").alias("record_id"))


QUERIES = {
    f.__name__: f
    for f in (
        comparison_ids, wide_pivot, processing_report, source_index, review_queue, unresolved_count, review_grid, layout_index, marker_colors, issue_sources, candidate_boxes, run_summaries, truth_join, field_accuracy, v1_metrics,
        review_keys, char_accuracy, reading_baseline, resume_pages, page_status_rollup, refreshed_pages, finalized_runs, stored_fields, plain_reports, upsert_snapshot, review_fold, reviewed_candidates, review_order, merged_rows, split_rows, snapshot_faults,
        slot_rollback, task_states, manifest_diff, pack_fingerprints, streaming_ledger, moved_rows, saved_review, structure_review, affected_pages, source_boxes, field_labels, repeated_truth, split_metrics, queue_order,
        batch_counts, needs_review_counts, project_runs,
    )
}

_ERRORS = "errs AS (SELECT statement_id, page_count AS page_index FROM statements WHERE source_sha256 IS NULL)"
_CANON = {
    "date": oracle.shown("transaction_date"), "income": "CAST(NULL AS VARCHAR)", "expense": "CAST(NULL AS VARCHAR)", "balance": oracle.shown("balance"), "summary": oracle.shown("description"),
    "counterparty_account": oracle.shown("account_number"), "counterparty_name": oracle.shown("counterparty_name"),
}
_LAYER_SQL = ", ".join(f"c.fields['{n}'].{t} AS {n}_{layer}" for n in NAMES for layer, t in export.LAYERS.items())
_STATES = """pg AS (
  SELECT statement_id, page_index, (length(statement_id) * 7 + CAST(right(statement_id, 4) AS INTEGER) + page_index) % 9 AS k
  FROM (SELECT statement_id, unnest(range(0, page_count + 1))::INTEGER AS page_index FROM statements)),
states AS (SELECT *, CASE k WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' WHEN 3 THEN 'needs_review' ELSE 'completed' END AS status, CASE WHEN k = 0 THEN 'unreadable' END AS error FROM pg)"""
_PAIRS = "coalesce(array_to_string(list_sort(list_transform(map_entries(t.fields), lambda e: e.key || '=' || coalesce(e.value, ''))), ';'), '')"
_PF_AMOUNT = "pf['transaction_amount']"
_GOLD = lambda n: f"SELECT sample_id, t.page_index AS page_index, t.row_index AS row_index, arg_min(t.fields, {_PAIRS}) AS fields FROM (SELECT sample_id, unnest(transactions) AS t FROM {n}) GROUP BY ALL"
_VERDICTS = f"""t AS ({_GOLD("golden_primary")}), p AS ({_GOLD("golden_mirror")}),
tf AS (SELECT sample_id, page_index, row_index, e.key AS field_name, e.value AS expected FROM (SELECT *, unnest(map_entries(fields)) AS e FROM t)),
v AS (SELECT sample_id, page_index, row_index, field_name, CASE WHEN p.fields[field_name] IS NULL THEN 'missing' WHEN p.fields[field_name] = expected THEN 'exact' ELSE 'mismatch' END AS verdict
      FROM tf LEFT JOIN p USING (sample_id, page_index, row_index)
      UNION ALL SELECT sample_id, page_index, row_index, NULL, 'extra' FROM p ANTI JOIN t USING (sample_id, page_index, row_index))"""


def _exact(name: str, value: str) -> str:
    return f"count_if(tt AND {value} = tf['{name}']) / count_if(tt AND tf['{name}'] IS NOT NULL)"


_DATE_OF, _MONEY_OF = (lambda n: f"coalesce(CAST({oracle.date(f'''pf['{n}']''')} AS VARCHAR), pf['{n}'])"), (lambda n: f"coalesce(CAST({oracle.amount(f'''pf['{n}']''')} AS VARCHAR), pf['{n}'])")
_LOG = """log AS (
  SELECT statement_id, page_index, row_index, candidate_id, event_id AS ord, event_type,
         CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'click' THEN 'edit' WHEN 'view' THEN 'edit' ELSE 'reject' END AS action,
         CASE event_type WHEN 'click' THEN 'balance' ELSE 'transaction_amount' END AS field_name
  FROM events JOIN candidates ON candidate_id = event_id % (SELECT max(candidate_id) FROM candidates) + 1)"""

ORACLE = {
    "comparison_ids": oracle.ledger("SELECT candidate_id, comparison_id FROM comparison"),
    "wide_pivot": oracle.ledger(f"""
SELECT {", ".join(f"{e.replace('fields[', 'c.fields[')} AS {n}" for n, e in _CANON.items())}, {oracle.date(oracle.shown("transaction_date").replace("fields[", "c.fields["))} AS date_value, CAST(NULL AS DECIMAL(38,2)) AS income_value, CAST(NULL AS DECIMAL(38,2)) AS expense_value,
       {oracle.amount(oracle.shown("balance").replace("fields[", "c.fields["))} AS balance_value, c.page_index + 1 AS page, c.status, comparison_id, c.page_index + 1 AS source_page, 'unlocated' AS source_location_status,
       CASE WHEN c.duplicate_of IS NOT NULL THEN c.duplicate_of.page_index || ':' || c.duplicate_of.row_index END AS duplicate_reference, p.status AS validation_status,
       r.statement_stream_id || ':' || lpad(CAST(c.page_index AS VARCHAR), 4, '0') || ':' || lpad(CAST(c.row_index AS VARCHAR), 4, '0') AS transaction_id, r.statement_stream_id,
       c.page_index, c.row_index, c.candidate_id, {_LAYER_SQL}
FROM candidates c JOIN comparison USING (candidate_id) LEFT JOIN records r USING (candidate_id) LEFT JOIN reports p ON p.statement_id = c.statement_id AND p.page_index = c.page_index"""),
    "processing_report": oracle.ledger("""
, base AS (SELECT statement_id, count(DISTINCT page_index) AS page_count, count(*) AS transaction_count, count_if(status = 'accepted') AS accepted_count, count_if(status = 'rejected') AS rejected_count,
                  count_if(status = 'duplicate') AS duplicate_count, count_if(status = 'unreviewed') AS needs_review_count FROM candidates GROUP BY 1),
iss AS (SELECT statement_id, count(*) AS vi, count_if(rule_state = 'fail') AS cf, count_if(rule_state = 'indeterminate') AS ind, count_if(severity = 'critical') AS crit FROM issues GROUP BY 1),
st AS (SELECT statement_id, string_agg(page_index || ':' || status, ', ' ORDER BY page_index) AS s FROM reports GROUP BY 1),
wide AS (SELECT statement_id, CAST(page_count AS VARCHAR) AS page_count, CAST(transaction_count AS VARCHAR) AS transaction_count, CAST(accepted_count AS VARCHAR) AS accepted_count, CAST(rejected_count AS VARCHAR) AS rejected_count,
                CAST(duplicate_count AS VARCHAR) AS duplicate_count, CAST(needs_review_count AS VARCHAR) AS needs_review_count, CAST(coalesce(vi, 0) AS VARCHAR) AS validation_issue_count,
                CAST(coalesce(cf, 0) AS VARCHAR) AS confirmed_failure_count, CAST(coalesce(ind, 0) AS VARCHAR) AS indeterminate_count, CAST(coalesce(crit, 0) AS VARCHAR) AS critical_issue_count, s AS validation_statuses
         FROM base LEFT JOIN iss USING (statement_id) LEFT JOIN st USING (statement_id))
SELECT statement_id, metric, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE statement_id) INTO NAME metric VALUE value)"""),
    "source_index": oracle.ledger("""
, f AS (SELECT statement_id, page_index, row_index, candidate_id, status, e.key AS field_name, e.value AS v FROM (SELECT *, unnest(map_entries(fields)) AS e FROM candidates)),
rk AS (SELECT *, CASE rule_state WHEN 'fail' THEN 0 WHEN 'indeterminate' THEN 1 WHEN 'pass' THEN 2 ELSE 3 END AS rank FROM issues),
bf AS (SELECT statement_id, page_index, row_index, field_name, arg_min(rule_state, rank) AS fs FROM rk WHERE field_name IS NOT NULL GROUP BY ALL),
br AS (SELECT statement_id, page_index, row_index, arg_min(rule_state, rank) AS rs FROM rk WHERE field_name IS NULL GROUP BY ALL)
SELECT f.candidate_id, r.statement_stream_id || ':' || lpad(CAST(f.page_index AS VARCHAR), 4, '0') || ':' || lpad(CAST(f.row_index AS VARCHAR), 4, '0') AS transaction_id, comparison_id, field_name,
       v.raw_text AS raw_text, v.suggested_text AS suggested_text, v.final_text AS final_text, v.confidence AS confidence, array_to_string(v.source_block_indices, ',') AS source_block_indices,
       coalesce(p.status, 'unknown') AS validation_status, coalesce(fs, rs, 'pass') AS rule_state, f.status
FROM f JOIN (SELECT candidate_id, comparison_id FROM comparison) USING (candidate_id) LEFT JOIN (SELECT candidate_id, statement_stream_id FROM records) r USING (candidate_id)
LEFT JOIN (SELECT statement_id AS ps, page_index AS pp, status FROM reports) p ON ps = f.statement_id AND pp = f.page_index
LEFT JOIN bf USING (statement_id, page_index, row_index, field_name) LEFT JOIN br USING (statement_id, page_index, row_index)"""),
    "review_queue": oracle.ledger(f"""
, {_ERRORS}, q AS (
  SELECT i.statement_id, i.page_index, i.row_index, i.candidate_id, i.emit_ord, i.code, i.severity, i.rule_state, i.field_name, c.fields[i.field_name].raw_text AS raw_text, p.status AS validation_status
  FROM issues i JOIN candidates c USING (candidate_id) JOIN reports p ON p.statement_id = i.statement_id AND p.page_index = i.page_index
  UNION ALL SELECT statement_id, page_index, -1, NULL, 0, 'page_error', 'critical', 'fail', NULL, NULL, 'page_review' FROM errs)
SELECT statement_id, page_index, row_index, code, severity, rule_state, field_name, raw_text, validation_status,
       row_number() OVER (PARTITION BY statement_id ORDER BY page_index, row_index, severity, code, candidate_id, emit_ord) AS queue_order FROM q"""),
    "unresolved_count": oracle.ledger(f"""
, {_ERRORS}, rv AS (SELECT statement_id, page_index FROM reports WHERE status IN ('review', 'page_review')),
a AS (SELECT statement_id, count(*) AS n FROM candidates SEMI JOIN rv USING (statement_id, page_index) GROUP BY 1), b AS (SELECT statement_id, count(*) AS n FROM errs ANTI JOIN rv USING (statement_id, page_index) GROUP BY 1)
SELECT statement_id, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS unresolved FROM (SELECT statement_id FROM candidates UNION SELECT statement_id FROM errs) LEFT JOIN a USING (statement_id) LEFT JOIN b USING (statement_id)"""),
    "review_grid": """SELECT candidate_id, e.key AS field_name, e.value.raw_text AS raw_text, e.value.secondary_text AS secondary_text, e.value.suggested_text AS suggested_text, e.value.final_text AS final_text, status
FROM (SELECT candidate_id, status, unnest(map_entries(fields)) AS e FROM candidates)""",
    "layout_index": """SELECT candidate_id, left(string_agg(k || '=' || coalesce(nullif(v.final_text, ''), nullif(v.suggested_text, ''), nullif(v.secondary_text, ''), v.raw_text, ''), '；' ORDER BY k), 32000) AS field_summary
FROM (SELECT candidate_id, e.key AS k, e.value AS v FROM (SELECT candidate_id, unnest(map_entries(fields)) AS e FROM candidates)) GROUP BY 1""",
    "marker_colors": oracle.ledger("""
, r AS (SELECT statement_id, page_index, row_index, bool_or(severity = 'critical' AND rule_state = 'fail') AS crit, bool_or(true) AS found FROM issues GROUP BY ALL)
SELECT candidate_id, CASE WHEN c.status IN ('rejected', 'duplicate') THEN 'grey' WHEN crit THEN 'red' WHEN found THEN 'amber' WHEN c.status = 'accepted' AND p.status = 'pass' THEN 'green' ELSE 'amber' END AS color
FROM candidates c LEFT JOIN r USING (statement_id, page_index, row_index) LEFT JOIN reports p ON p.statement_id = c.statement_id AND p.page_index = c.page_index"""),
    "issue_sources": oracle.ledger("""
SELECT i.candidate_id, CAST(i.emit_ord AS INTEGER) AS emit_ord, array_to_string(s, ',') AS indices, list_min(s) * 10.0::DOUBLE AS x0, (list_max(s) * 3.0 + 2)::DOUBLE AS y1
FROM (SELECT i.*, c.fields[i.field_name].source_block_indices AS s FROM issues i JOIN candidates c USING (candidate_id)) i"""),
    "candidate_boxes": """
SELECT statement_id, page_index, row_index, min(i) * 10.0::DOUBLE AS x0, min(i) * 3.0::DOUBLE AS y0, (max(i) * 10.0 + 8)::DOUBLE AS x1, (max(i) * 3.0 + 2)::DOUBLE AS y1,
       CASE WHEN min(i) * 10 < 300 AND min(i) * 3 < 100 THEN least(max(i) * 10.0 + 8, 300.0)::DOUBLE END AS clipped_x1, min(i) * 10 < 300 AND min(i) * 3 < 100 AS visible
FROM (SELECT statement_id, page_index, row_index, unnest(flatten(list_transform(map_values(fields), lambda v: v.source_block_indices))) AS i FROM candidates) WHERE i IS NOT NULL GROUP BY ALL""",
    "run_summaries": oracle.ledger("""
SELECT statement_id, true AS named, CAST(count(*) AS INTEGER) AS pages, arg_min(status, page_index) AS first_status, arg_min(checked_rows, page_index) AS first_rows, arg_min(risk_score, page_index) AS first_score FROM reports GROUP BY 1"""),
    "truth_join": f"WITH {_VERDICTS} SELECT * FROM v",
    "field_accuracy": f"""WITH {_VERDICTS} SELECT sample_id, count_if(verdict = 'exact') AS exact_matches, count_if(verdict = 'missing') AS missing, count_if(verdict = 'mismatch') AS mismatches, count_if(verdict = 'extra') AS extra_rows,
       count_if(verdict <> 'extra') AS total_fields, round(coalesce(count_if(verdict = 'exact') / nullif(count_if(verdict <> 'extra'), 0), 0), 6) AS accuracy FROM v GROUP BY 1""",
    "v1_metrics": f"""WITH t AS ({_GOLD("golden_primary")}), p AS ({_GOLD("golden_mirror")}),
j AS (SELECT t.fields AS tf, p.fields AS pf, t.fields IS NOT NULL AS tt, p.fields IS NOT NULL AS pp, row_index % 7 = 0 AS rv FROM t FULL JOIN p USING (sample_id, page_index, row_index)),
m AS (SELECT count_if(tt) AS truth_rows, count_if(pp) AS predicted_rows,
  count_if(tt AND pp AND NOT rv AND ((tf['transaction_date'] IS NOT NULL AND {_DATE_OF("transaction_date")} IS DISTINCT FROM tf['transaction_date']) OR (tf['transaction_amount'] IS NOT NULL AND {_MONEY_OF("transaction_amount")} IS DISTINCT FROM tf['transaction_amount'])
                                     OR (tf['balance'] IS NOT NULL AND {_MONEY_OF("balance")} IS DISTINCT FROM tf['balance']))) AS silent_critical_errors,
  round(count_if(tt AND pp) / count_if(tt), 6) AS transaction_recall, round({_exact("transaction_date", _DATE_OF("transaction_date"))}, 6) AS date_exact, round({_exact("transaction_amount", _MONEY_OF("transaction_amount"))}, 6) AS amount_exact,
  round({_exact("balance", _MONEY_OF("balance"))}, 6) AS balance_exact, round(count_if(tt AND pp) / greatest(count_if(tt), count_if(pp)), 6) AS row_association, round(count_if(pp AND rv) / count_if(pp), 6) AS review_rate FROM j)
SELECT *, transaction_recall >= 0.995 AND date_exact >= 0.995 AND amount_exact >= 0.995 AND balance_exact >= 0.995 AND row_association >= 0.99 AND review_rate <= 0.1 AND silent_critical_errors = 0 AS gate_passed FROM m""",
    "review_keys": oracle.ledger("""
SELECT statement_id, page_index, row_index FROM issues SEMI JOIN (SELECT * FROM reports WHERE status = 'review') USING (statement_id, page_index)
UNION SELECT statement_id, page_index, row_index FROM candidates SEMI JOIN (SELECT * FROM reports WHERE status = 'review') USING (statement_id, page_index) ANTI JOIN issues USING (statement_id, page_index)"""),
    "reading_baseline": "SELECT statement_id, page_index, count(*) AS blocks, CAST(sum(length(raw_text)) AS BIGINT) AS characters, count_if(coalesce(confidence, 0) < 0.8) AS weak_blocks FROM field_values GROUP BY ALL",
    "resume_pages": f"""WITH {_STATES} SELECT statement_id, page_index, CASE WHEN page_index = 0 OR status = 'needs_review' THEN 'pending' ELSE status END AS status FROM states WHERE page_index = 0 OR status <> 'completed'""",
    "page_status_rollup": f"""WITH {_STATES} SELECT statement_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'running' END AS status, count(*) AS pages
FROM states GROUP BY 1""",
    "refreshed_pages": oracle.ledger(f""", {_STATES}, iss AS (SELECT statement_id, page_index, count(*) AS n FROM issues GROUP BY ALL)
SELECT statement_id, page_index, CASE WHEN s.status IN ('failed', 'pending', 'running') THEN s.status WHEN error IS NOT NULL OR n > 0 OR r.status IN ('review', 'page_review') THEN 'needs_review' ELSE 'completed' END AS status, error
FROM states s LEFT JOIN reports r USING (statement_id, page_index) LEFT JOIN iss USING (statement_id, page_index)"""),
    "finalized_runs": oracle.ledger(f""", {_STATES}, iss AS (SELECT statement_id, page_index, count(*) AS n FROM issues GROUP BY ALL),
fresh AS (SELECT statement_id, CASE WHEN s.status IN ('failed', 'pending', 'running') THEN s.status WHEN error IS NOT NULL OR n > 0 OR r.status IN ('review', 'page_review') THEN 'needs_review' ELSE 'completed' END AS status
          FROM states s LEFT JOIN reports r USING (statement_id, page_index) LEFT JOIN iss USING (statement_id, page_index))
SELECT statement_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'needs_review') THEN 'needs_review' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'running' END AS status, count(*) AS pages FROM fresh GROUP BY 1"""),
    "stored_fields": "SELECT candidate_id, CAST(len(map_keys(fields)) AS INTEGER) AS fields, fields['transaction_amount'].raw_text AS amount_text FROM candidates",
    "plain_reports": oracle.ledger("""
, codes AS (SELECT statement_id, page_index, code, min(seq) AS seq FROM ranked GROUP BY ALL), told AS (SELECT statement_id, page_index, string_agg(code, ',' ORDER BY seq) AS reasons FROM codes GROUP BY ALL)
SELECT p.statement_id, p.page_index, CAST(checked_rows AS INTEGER) AS checked_rows, CASE WHEN fails > 0 OR unsure > 0 THEN 'review' ELSE 'pass' END AS status,
       CAST(CASE WHEN criticals > 0 THEN 100 WHEN fails > 0 THEN 40 WHEN unsure > 0 THEN 20 ELSE 0 END AS INTEGER) AS risk_score, coalesce(reasons, '') AS reasons
FROM page_rows p LEFT JOIN sums USING (statement_id, page_index) LEFT JOIN told USING (statement_id, page_index)"""),
    "upsert_snapshot": "SELECT candidate_id, field_name, field_id, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, field_name ORDER BY ingested_at DESC, field_id DESC) AS k FROM field_values) WHERE k = 1",
    "review_fold": f"WITH {_LOG} SELECT statement_id, page_index, row_index, field_name, CAST(max(ord) AS VARCHAR) AS value FROM log WHERE action = 'edit' GROUP BY ALL",
    "reviewed_candidates": f"""WITH {_LOG}, d AS (SELECT candidate_id, max(ord) AS last, arg_max(action, ord) AS action FROM log WHERE action <> 'edit' GROUP BY 1),
before AS (SELECT candidate_id, max(ord) AS spent FROM log JOIN d USING (candidate_id) WHERE log.action <> 'edit' AND ord < last GROUP BY 1),
e AS (SELECT candidate_id, CAST(max(ord) AS VARCHAR) AS value FROM log JOIN d USING (candidate_id) LEFT JOIN before USING (candidate_id) WHERE log.action = 'edit' AND field_name = 'transaction_amount' AND ord < last AND ord > coalesce(spent, -1) GROUP BY 1)
SELECT candidate_id, CASE d.action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE status END AS status,
       CASE WHEN d.action = 'accept' THEN CASE WHEN fields['transaction_amount'] IS NOT NULL THEN coalesce(e.value, fields['transaction_amount'].suggested_text) END ELSE fields['transaction_amount'].final_text END AS final_amount
FROM candidates LEFT JOIN d USING (candidate_id) LEFT JOIN e USING (candidate_id)""",
    "review_order": "SELECT candidate_id, row_number() OVER (PARTITION BY statement_id, page_index ORDER BY coalesce(review_order, row_index), row_index, candidate_id) - 1 AS review_order FROM candidates",
    "merged_rows": """WITH o AS (SELECT *, row_number() OVER w AS k, lead(fields) OVER w AS other FROM candidates WINDOW w AS (PARTITION BY statement_id, page_index ORDER BY row_index)),
m AS (SELECT candidate_id, k, fields, CASE WHEN k = 1 THEN other END AS other FROM o WHERE k <> 2)
SELECT candidate_id, CASE WHEN fields['transaction_amount'] IS NOT NULL AND other['transaction_amount'] IS NOT NULL THEN fields['transaction_amount'].raw_text || ' | ' || other['transaction_amount'].raw_text
                          ELSE coalesce(fields['transaction_amount'].raw_text, other['transaction_amount'].raw_text) END AS amount_text,
       CAST(CASE WHEN other IS NULL THEN len(map_keys(fields)) ELSE len(list_distinct(list_concat(map_keys(fields), map_keys(other)))) END AS INTEGER) AS fields FROM m""",
    "split_rows": """WITH c AS (SELECT *, row_index % 2 = 0 AND fields['balance'] IS NOT NULL AND len(map_keys(fields)) > 1 AS cut, max(row_index) OVER (PARTITION BY statement_id, page_index) AS most FROM candidates)
SELECT statement_id, page_index, row_index, CAST(len(map_keys(fields)) - cut::INT AS INTEGER) AS fields FROM c
UNION ALL SELECT statement_id, page_index, CAST(most + row_number() OVER (PARTITION BY statement_id, page_index ORDER BY row_index, candidate_id) AS INTEGER), 1 FROM c WHERE cut""",
    "snapshot_faults": """WITH planted AS (SELECT statement_id, page_index, row_index, review_order, candidate_id, CASE WHEN candidate_id % 33 = 0 THEN struct_pack(page_index := page_index, row_index := 99999) ELSE duplicate_of END AS duplicate_of FROM candidates),
candidates_ AS (SELECT * FROM planted UNION ALL SELECT * FROM planted WHERE candidate_id % 40 = 0)
SELECT statement_id, page_index, row_index, 'duplicate_key' AS fault FROM candidates_ GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT statement_id, page_index, max(row_index), 'duplicate_order' FROM candidates_ WHERE review_order IS NOT NULL GROUP BY statement_id, page_index, review_order HAVING count(*) > 1
UNION ALL SELECT statement_id, page_index, row_index, 'unknown_duplicate_of' FROM candidates_ c WHERE duplicate_of IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM candidates_ o WHERE o.statement_id = c.statement_id AND o.page_index = c.duplicate_of.page_index AND o.row_index = c.duplicate_of.row_index)""",
    "slot_rollback": """WITH s AS (SELECT user_id, list_reduce(list(event_type ORDER BY event_id), lambda s, e: CASE
    WHEN e = 'purchase' THEN CASE WHEN split_part(s, '|', 1) <> '' AND split_part(s, '|', 2) <> '' THEN split_part(s, '|', 2) || '|' || split_part(s, '|', 1) ELSE s END
    WHEN split_part(s, '|', 1) NOT IN ('', e) THEN e || '|' || split_part(s, '|', 1) ELSE e || '|' || split_part(s, '|', 2) END, '|') AS s FROM events GROUP BY 1)
SELECT user_id AS slot, nullif(split_part(s, '|', 1), '') AS current, nullif(split_part(s, '|', 2), '') AS previous FROM s""",
    "task_states": """WITH s AS (SELECT user_id, list_reduce(list(event_id % 7 ORDER BY event_id)::VARCHAR[], lambda s, a: CASE split_part(s, '|', 1) || a
    WHEN 'queued0' THEN 'running' WHEN 'running3' THEN 'completed' WHEN 'running4' THEN 'failed' WHEN 'queued1' THEN 'paused' WHEN 'running1' THEN 'paused' WHEN 'paused2' THEN 'queued'
    WHEN 'queued5' THEN 'cancelled' WHEN 'running5' THEN 'cancelled' WHEN 'paused5' THEN 'cancelled' WHEN 'completed6' THEN 'queued' WHEN 'failed6' THEN 'queued' WHEN 'cancelled6' THEN 'queued' ELSE split_part(s, '|', 1) END
    || '|' || (CAST(split_part(s, '|', 2) AS INTEGER) + CASE WHEN a = '6' AND split_part(s, '|', 1) IN ('completed', 'failed', 'cancelled') THEN 1 ELSE 0 END), 'queued|1') AS s FROM events GROUP BY 1)
SELECT user_id AS task_id, split_part(s, '|', 1) AS state, CAST(split_part(s, '|', 2) AS INTEGER) AS attempt FROM s""",
    "moved_rows": """WITH o AS (SELECT candidate_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY statement_id, page_index) AS n FROM candidates WINDOW w AS (PARTITION BY statement_id, page_index ORDER BY coalesce(review_order, row_index), row_index))
SELECT candidate_id, CASE WHEN n = 2 THEN k - 1 WHEN k = 1 THEN n - 1 WHEN k = 2 THEN 1 WHEN k = 3 THEN 0 ELSE k - 2 END AS review_order FROM o""",
    "saved_review": """SELECT statement_id, page_index, row_index, 'candidate_updated' AS what, 'accepted' AS status FROM candidates WHERE row_index % 3 = 0 AND status IS DISTINCT FROM 'accepted'
UNION ALL SELECT statement_id, page_index, row_index + 100000, 'unknown', NULL FROM candidates WHERE row_index % 50 = 0""",
    "structure_review": """SELECT statement_id, page_index, -1 AS row_index, 'structure_snapshot' AS action, count(*) - 1 AS rows FROM candidates WHERE page_index % 2 = 0 GROUP BY 1, 2 HAVING count(*) > 1""",
    "affected_pages": f"WITH {_LOG} SELECT statement_id, page_index FROM candidates WHERE status = 'accepted' UNION SELECT statement_id, page_index FROM log",
    "source_boxes": """SELECT candidate_id, e.key AS field_name, CAST(NULL AS VARCHAR) AS source_spans, CASE WHEN len(e.value.source_block_indices) > 0 THEN concat_ws(',', list_min(e.value.source_block_indices) * 10,
       list_min(e.value.source_block_indices) * 3, list_max(e.value.source_block_indices) * 10 + 8, list_max(e.value.source_block_indices) * 3 + 2) END AS source_bbox FROM (SELECT candidate_id, unnest(map_entries(fields)) AS e FROM candidates)""",
    "field_labels": f"""WITH {_VERDICTS}, l AS (SELECT sample_id, verdict, concat_ws(':', page_index, row_index, field_name) AS x FROM v)
SELECT sample_id, {", ".join(f"coalesce(string_agg(x, ',' ORDER BY x) FILTER (verdict = '{v}'), '') AS {n}" for v, n in (("missing", "missing"), ("mismatch", "mismatches"), ("extra", "extra")))} FROM l GROUP BY 1""",
    "repeated_truth": f"""SELECT sample_id, page_index, row_index, count(*) AS versions FROM (SELECT DISTINCT sample_id, t.page_index AS page_index, t.row_index AS row_index, {_PAIRS} AS p FROM (SELECT sample_id, unnest(transactions) AS t FROM (SELECT sample_id, transactions FROM golden_primary UNION ALL SELECT sample_id, transactions FROM golden_mirror)))
GROUP BY ALL HAVING count(*) > 1""",
    "split_metrics": f"""WITH t AS ({_GOLD("golden_primary")}), p AS ({_GOLD("golden_mirror")}), j AS (SELECT t.fields AS tf, p.fields AS pf, t.fields IS NOT NULL AS tt, p.fields IS NOT NULL AS pp FROM t FULL JOIN p USING (sample_id, page_index, row_index))
SELECT count_if(tt) AS truth_rows, count_if(pp) AS predicted_rows, round({_exact("transaction_amount", f"CAST({oracle.amount(_PF_AMOUNT)} AS VARCHAR)")}, 6) AS amount_exact, round({_exact("balance", _MONEY_OF("balance"))}, 6) AS balance_exact FROM j""",
    "queue_order": "SELECT o_orderkey AS task_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'",
    "batch_counts": "SELECT o_orderpriority AS queue, count_if(o_orderstatus = 'F') AS completed, count_if(o_orderstatus = 'P') AS not_completed FROM orders GROUP BY 1",
    "needs_review_counts": oracle.ledger(f""", {_STATES}, a AS (SELECT statement_id, count_if(status = 'needs_review') AS by_state FROM states GROUP BY 1), b AS (SELECT statement_id, count_if(status IN ('review', 'page_review')) AS by_report FROM reports GROUP BY 1)
SELECT statement_id, coalesce(by_state, 0) AS by_state, coalesce(by_report, 0) AS by_report FROM a FULL JOIN b USING (statement_id)"""),
    "project_runs": "SELECT statement_id, account_number AS project_id, currency, bank_code FROM statements JOIN accounts USING (account_number) WHERE currency <> 'EUR'",
    "manifest_diff": """WITH p AS (SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand, p_size)) AS h FROM part),
c AS (SELECT CASE WHEN p_partkey % 77 = 0 THEN p_partkey + 10000000 ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE h END AS g FROM p WHERE p_partkey % 50 <> 0)
SELECT p_partkey, CASE WHEN g IS NULL THEN 'missing' WHEN h IS NULL THEN 'unlisted' ELSE 'changed' END AS verdict FROM p FULL JOIN c USING (p_partkey) WHERE h IS DISTINCT FROM g""",
    "pack_fingerprints": """SELECT p_brand, sha256(string_agg(p_name || ':' || h, chr(10) ORDER BY p_name, h)) AS fingerprint FROM (SELECT p_brand, p_name, sha256(p_name || '|' || p_size) AS h FROM part) GROUP BY 1""",
    "streaming_ledger": "SELECT record_id FROM (SELECT *, lag(balance) OVER (PARTITION BY statement_id, account_number ORDER BY page_index, row_index, record_id) AS pb FROM ledger_transactions) WHERE pb + amount <> balance",
}
