"""Reports and exports over candidates, issues, reports and records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.geometry import box_text, union_box
from ledgerloom.functions.money import parse_amount
from ledgerloom.functions.nested import spans_json
from ledgerloom.operators.ledger import DOC, KEY, ORDER, shown_text, with_values

# Canonical columns and the field names they are filled from, first present one wins.
CANONICAL = {
    "date": ("transaction_date", "accounting_date", "date"),
    "income": ("income_amount", "income"),
    "expense": ("expense_amount", "expense"),
    "balance": ("balance", "online_balance", "closing_balance"),
    "summary": ("summary", "transaction_summary", "description", "customer_summary"),
    "counterparty_account": ("counterparty_account", "account_number", "account"),
    "counterparty_name": ("counterparty_name", "counterparty_info", "name"),
}
LAYERS = {"raw": "raw_text", "secondary": "secondary_text", "suggested": "suggested_text", "final": "final_text"}
# Colours of markers by row state.
GREY, RED, AMBER, GREEN = "grey", "red", "amber", "green"
SUMMARY_CHARS = 32_000


def comparison_ids(candidates: DataFrame) -> DataFrame:
    """T0001, T0002, ... of each document's rows in page and review order (W7): key, candidate_id, comparison_id."""
    order = Window.partitionBy(DOC).orderBy("page_index", F.coalesce("review_order", "row_index"), "row_index", ORDER)
    return candidates.select(*KEY, ORDER, ids.comparison_id(F.row_number().over(order)).alias("comparison_id"))


def candidate_boxes(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Box around all source blocks of a candidate (A25): key and x0, y0, x1, y1; rows without located blocks are absent."""
    page = [DOC, "page_index"]
    source = candidates.select(*KEY, F.explode(F.array_distinct(F.flatten(F.transform(F.map_values("fields"), lambda v: v["source_block_indices"])))).alias("block_index"))
    return source.join(blocks.select(*page, "block_index", "x0", "y0", "x1", "y1"), [*page, "block_index"]).groupBy(*KEY).agg(*union_box())


def typed_value(name: str, text: Column) -> tuple[Column, Column, Column]:
    """(date, amount, text) of an exported cell (P21): by the column's name a date or an amount where it reads as one, else text."""
    date = parse_date(text) if name == "date" or name.endswith("_date") else F.lit(None).cast("date")
    # Names of money columns besides those that end in _amount.
    money = parse_amount(text) if name in {"amount", "balance", "online_balance", "opening_balance", "closing_balance", "income", "expense"} or name.endswith("_amount") else F.lit(None).cast("decimal(38,2)")
    return date, money, F.when(date.isNull() & money.isNull(), text)


def field_names(candidates: DataFrame, most: int = 2_000) -> list[str]:
    """Sorted names of observed fields; refuses more than ``most``, as they become columns (H8)."""
    names = [r[0] for r in candidates.select(F.explode(F.map_keys("fields")).alias("n")).distinct().orderBy("n").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} field names cannot become columns")
    return names


def transactions_wide(rows: DataFrame, boxes: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """The wide transactions sheet of ledger.reviewed_rows (K1, P13): seven canonical columns, typed values of four of them (P21), the technical ones, then four text layers per field name.

    The layers come straight from the field map, so the pivot needs no shuffle.
    """
    names = field_names(rows) if names is None else names
    if boxes is not None:
        df = rows.join(boxes.select(*KEY, box_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("source_box")), KEY, "left")
    else:
        df = rows.withColumn("source_box", F.lit(None).cast("string"))
    layers = [F.try_element_at("fields", F.lit(n))[text].alias(f"{n}.{layer}") for n in names for layer, text in LAYERS.items()]
    money = ("income", "expense", "balance")
    shown = {f"shown_{name}": shown_text(*aliases) for name, aliases in CANONICAL.items()}
    df = df.withColumns(shown).withColumns({f"_{n}_value": F.col(f"shown_{n}") for n in (*money, "date")})
    df = with_values(df, tuple(f"{n}_value" for n in money), ("date_value",))
    return df.select(
        *[F.col(f"shown_{name}").alias(name) for name in CANONICAL], "date_value", *[f"{n}_value" for n in money],
        (F.col("page_index") + 1).alias("page"), "status", "comparison_id", (F.col("page_index") + 1).alias("source_page"), "source_box",
        F.when(F.col("source_box").isNull(), "unlocated").otherwise("located").alias("source_location_status"),
        F.when(F.col("duplicate_of").isNotNull(), F.concat_ws(":", "duplicate_of.page_index", "duplicate_of.row_index")).alias("duplicate_reference"),
        F.col("report_status").alias("validation_status"),
        "transaction_id", "statement_stream_id", *KEY, ORDER, "parser_id", *layers,
    )


def processing_report(rows: DataFrame) -> DataFrame:
    """Metrics of each document of ledger.reviewed_rows as (statement_id, metric, value) (K2, A11, U5); critical issues count whatever their state (Q12)."""
    count = lambda cond: F.count_if(cond).cast("string")
    found = lambda cond: F.sum(F.size(F.filter("issues", cond)).cast("bigint")).cast("string")
    pages = F.array_sort(F.collect_set(F.struct("page_index", "report_status")))
    df = rows.groupBy(DOC).agg(
        F.count_distinct("page_index").cast("string").alias("page_count"), F.count(F.lit(1)).cast("string").alias("transaction_count"),
        *[count(F.col("status") == s).alias(n) for n, s in (("accepted_count", "accepted"), ("rejected_count", "rejected"), ("duplicate_count", "duplicate"), ("needs_review_count", "unreviewed"))],
        F.sum(F.size("issues").cast("bigint")).cast("string").alias("validation_issue_count"), found(lambda i: i["rule_state"] == "fail").alias("confirmed_failure_count"),
        found(lambda i: i["rule_state"] == "indeterminate").alias("indeterminate_count"), found(lambda i: i["severity"] == "critical").alias("critical_issue_count"),
        F.array_join(F.transform(pages, lambda s: F.concat_ws(":", s["page_index"], s["report_status"])), ", ").alias("validation_statuses"),
    )
    return df.unpivot(DOC, [c for c in df.columns if c != DOC], "metric", "value")


def worst_state(issues: Column) -> Column:
    """The worst rule state of an array of issues (P20), null where there are none."""
    of = lambda s: F.exists(issues, lambda i: i["rule_state"] == s)
    return F.when(of("fail"), "fail").when(of("indeterminate"), "indeterminate").when(of("pass"), "pass").when(of("not_applicable"), "not_applicable")


def field_boxes(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Box around the source blocks of each field as text (K3): key, candidate_id, field_name, source_bbox; fields without located blocks are absent."""
    page = [DOC, "page_index"]
    source = candidates.select(*KEY, ORDER, F.explode("fields").alias("field_name", "v")).select(*KEY, ORDER, "field_name", F.explode(F.array_distinct("v.source_block_indices")).alias("block_index"))
    boxed = source.join(blocks.select(*page, "block_index", "x0", "y0", "x1", "y1"), [*page, "block_index"]).groupBy(*KEY, ORDER, "field_name").agg(*union_box())
    return boxed.select(*KEY, ORDER, "field_name", box_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("source_bbox"))


def source_index(rows: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One row per field of ledger.reviewed_rows with its text layers, evidence, rule state and ids (K3).

    The rule state is the worst of the field's issues, else of the row's own, else pass. source_spans is JSON
    where the fields hold source_spans, else null; source_bbox is null without blocks.
    """
    of_row = worst_state(F.filter("key_issues", lambda i: i["field_name"].isNull()))
    df = rows.select(*KEY, ORDER, "status", "transaction_id", "comparison_id", "report_status", "key_issues", of_row.alias("row_state"), F.explode("fields").alias("field_name", "v"))
    of_field = worst_state(F.filter("key_issues", lambda i: i["field_name"] == F.col("field_name")))
    spans = "source_spans" in rows.schema["fields"].dataType.valueType.names
    df = df.withColumn("source_spans", spans_json("v.source_spans") if spans else F.lit(None).cast("string"))
    df = df.join(field_boxes(rows, blocks), [*KEY, ORDER, "field_name"], "left") if blocks is not None else df.withColumn("source_bbox", F.lit(None).cast("string"))
    return df.select(
        *KEY, ORDER, "transaction_id", "comparison_id", "field_name", *[F.col(f"v.{t}").alias(t) for t in LAYERS.values()], F.col("v.confidence").alias("confidence"),
        F.array_join(F.transform("v.source_block_indices", lambda i: i.cast("string")), ",").alias("source_block_indices"), "source_spans", "source_bbox",
        F.col("report_status").alias("validation_status"), F.coalesce(of_field, "row_state", F.lit("pass")).alias("rule_state"), "status",
    )


def review_queue(rows: DataFrame, page_errors: DataFrame | None = None) -> DataFrame:
    """Issues of ledger.reviewed_rows with their row and field, and page errors as row -1 (K4, U2, O6): queue_order sorts by page, row, severity and code inside a document."""
    df = rows.select(*KEY, ORDER, "status", "fields", "report_status", F.inline("issues"))
    value = F.try_element_at("fields", F.col("field_name"))
    df = df.select(*KEY, ORDER, "emit_ord", "code", "severity", "rule_state", "field_name", F.col("status").alias("candidate_status"), value["raw_text"].alias("raw_text"), value["suggested_text"].alias("suggested_text"), F.col("report_status").alias("validation_status"))
    if page_errors is not None:
        error = page_errors.select(
            DOC, "page_index", F.lit(-1).alias("row_index"), F.lit(None).cast("bigint").alias(ORDER), F.lit(0).alias("emit_ord"), F.lit("page_error").alias("code"), F.lit("critical").alias("severity"),
            F.lit("fail").alias("rule_state"), F.lit("page_review").alias("validation_status"),
        )
        df = df.unionByName(error, allowMissingColumns=True)
    order = Window.partitionBy(DOC).orderBy("page_index", "row_index", "severity", "code", ORDER, "emit_ord")
    return df.withColumn("queue_order", F.row_number().over(order))


def unresolved_counts(rows: DataFrame, page_errors: DataFrame) -> DataFrame:
    """Rows of ledger.reviewed_rows on review pages plus error pages not on review, per document (A12, J18, U8): statement_id, unresolved."""
    page = [DOC, "page_index"]
    waits = F.col("report_status").isin("review", "page_review")
    found = rows.select(*page, waits.cast("int").alias("rows"), waits.alias("waits"), F.lit(False).alias("error")).unionByName(page_errors.select(*page, F.lit(0).alias("rows"), F.lit(False).alias("waits"), F.lit(True).alias("error")))
    per_page = found.groupBy(*page).agg(F.sum("rows").alias("rows"), (F.bool_or("error") & ~F.bool_or("waits")).cast("int").alias("lone"))
    return per_page.groupBy(DOC).agg(F.sum(F.col("rows") + F.col("lone")).alias("unresolved"))


def review_grid(candidates: DataFrame) -> DataFrame:
    """One row per candidate and field with the four text layers and the row's status (P25)."""
    return candidates.select(*KEY, ORDER, "status", F.explode("fields").alias("field_name", "v")).select(*KEY, ORDER, "field_name", *[F.col(f"v.{t}").alias(t) for t in LAYERS.values()], "status")


def layout_index(candidates: DataFrame) -> DataFrame:
    """Index of the page-image workbook (K5): key and a summary 'name=text' of all fields by name, cut at the cell limit of the format."""
    shown = lambda v: F.coalesce(F.nullif(v["final_text"], F.lit("")), F.nullif(v["suggested_text"], F.lit("")), F.nullif(v["secondary_text"], F.lit("")), v["raw_text"], F.lit(""))
    parts = F.transform(F.array_sort(F.map_keys("fields")), lambda n: F.concat(n, F.lit("="), shown(F.element_at("fields", n))))
    return candidates.select(*KEY, ORDER, F.left(F.array_join(parts, "；"), F.lit(SUMMARY_CHARS)).alias("field_summary"))


def marker_colors(rows: DataFrame) -> DataFrame:
    """Colour of each row's marker in the comparison view (P19): grey rejected or duplicate, red critical failure, amber anything open, green accepted on a passed page."""
    critical = F.exists("key_issues", lambda i: (i["severity"] == "critical") & (i["rule_state"] == "fail"))
    open_ = F.exists("key_issues", lambda i: ~i["rule_state"].isin("pass", "not_applicable"))
    reported = F.col("report_status") != "unknown"
    color = (
        F.when(F.col("status").isin("rejected", "duplicate"), GREY).when(reported & critical, RED).when(reported & open_, AMBER)
        .when((F.col("status") == "accepted") & (F.col("report_status") == "pass"), GREEN).otherwise(AMBER)
    )
    return rows.select(*KEY, ORDER, color.alias("color"))


def export_manifest(files: DataFrame) -> DataFrame:
    """Name, size and SHA-256 of exported files (K8, F39); files come from spark.read.format('binaryFile')."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def export_record(artifacts: DataFrame, unresolved: int, run_id: int | None = None, source_sha256: str | None = None, export_id: str | None = None) -> DataFrame:
    """One row that describes an export (K8): format_version, export_id, run_id, source_sha256, exported_at, unresolved_count, outputs.

    artifacts come from export_manifest, a few files; without any there is no row. export_id is random unless given.
    """
    if unresolved < 0 or source_sha256 is not None and len(source_sha256) != 64:
        raise ValueError("unresolved must not be negative and source_sha256 must be a SHA-256 in hex")
    outputs = F.array_sort(F.collect_list(F.struct("name", "size", "sha256")))
    row = artifacts.agg(outputs.alias("outputs")).where(F.size("outputs") > 0)
    return row.select(
        F.lit(1).alias("format_version"), F.lit(export_id or uuid.uuid4().hex).alias("export_id"), F.lit(run_id).cast("bigint").alias("run_id"), F.lit(source_sha256).cast("string").alias("source_sha256"),
        F.current_timestamp().alias("exported_at"), F.lit(unresolved).cast("bigint").alias("unresolved_count"), "outputs",
    )


def run_summaries(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """One JSON text per document (K9, A13): pages with their row count, status, score and reasons, in page order."""
    page = [DOC, "page_index"]
    counts = candidates.groupBy(*page).agg(F.count(F.lit(1)).cast("int").alias("candidates"))
    rows = counts.join(reports, page, "full_outer")
    entry = F.struct("page_index", F.coalesce("candidates", F.lit(0)).alias("candidates"), "status", "risk_score", "reasons")
    return rows.groupBy(DOC).agg(F.to_json(F.struct(F.first(DOC).alias("document"), F.array_sort(F.collect_list(entry)).alias("pages"))).alias("summary"))
