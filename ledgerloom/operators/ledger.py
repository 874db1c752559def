"""Validation rules, risk reports and transaction records over candidate rows.

All rules are column expressions plus two window passes: one over (page, row) keys for repeats and one
over statement streams for balances and dates. Rows arrive in no order of their own, so candidate_id is
the order of ingestion and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import ids
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import account_ok, currency_ok, net_amount, parse_amount_text
from ledgerloom.functions.text import casefold, compact, no_space, present

DOC, ORDER = "statement_id", "candidate_id"
KEY = [DOC, "page_index", "row_index"]
MIN_CONFIDENCE = 0.80

# Names a field may have, first present one wins. Validation and record building know different sets.
DATE_NAMES = ("transaction_date", "accounting_date", "date")
AMOUNT_NAMES = ("transaction_amount", "amount")
CURRENCY_NAMES = ("currency", "currency_code")
OWN_ACCOUNT_NAMES = ("account_number", "account_id", "own_account", "account")
CHECKED_ACCOUNT_NAMES = ("counterparty_account", "account_number", "account")
VALIDATED_STREAM_NAMES = ("statement_stream_id", "stream_id")
BUILT_STREAM_NAMES = ("statement_stream_id", "stream_id", "section_id")
BUILT_INCOME_NAMES, BUILT_EXPENSE_NAMES = ("income_amount", "income"), ("expense_amount", "expense")
BUILT_BALANCE_NAMES = ("balance", "online_balance", "closing_balance")

# Severity and rule state of each issue code.
ISSUES = {
    "duplicate_row": ("critical", "fail"),
    "invalid_date": ("error", "indeterminate"),
    "low_confidence": ("error", "indeterminate"),
    "invalid_account": ("error", "indeterminate"),
    "invalid_currency": ("error", "indeterminate"),
    "invalid_amount": ("error", "indeterminate"),
    "missing_amount": ("error", "indeterminate"),
    "invalid_balance": ("error", "indeterminate"),
    "balance_mismatch": ("critical", "fail"),
    "possible_missing_transaction": ("error", "indeterminate"),
    "date_order": ("error", "fail"),
}


def field(name: str) -> Column:
    """The field struct of a name, null where the map lacks it."""
    return F.try_element_at("fields", F.lit(name))


def checked_text(name: str) -> Column:
    """Text that validation reads: final, else suggested, else empty; null only where the field is absent."""
    return F.when(field(name).isNotNull(), F.coalesce(field(name)["final_text"], field(name)["suggested_text"], F.lit("")))


def shown_text(*names: str) -> Column:
    """Text that records and exports show: of the first present field, the first of final, suggested and raw that is not empty."""
    one = lambda n: F.coalesce(present(field(n)["final_text"]), present(field(n)["suggested_text"]), field(n)["raw_text"])
    chain = F.when(field(names[0]).isNotNull(), one(names[0]))
    for n in names[1:]:
        chain = chain.when(field(n).isNotNull(), one(n))
    return chain


def first_name(*names: str) -> Column:
    """The first of some names that the field map has."""
    return F.coalesce(*[F.when(field(n).isNotNull(), F.lit(n)) for n in names])


def first_checked(*names: str) -> Column:
    return F.coalesce(*[checked_text(n) for n in names])


def validation_stream() -> Column:
    """Stream of a row as validation sees it: explicit id and own account without white space, currency case-folded."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(no_space(first_checked(*VALIDATED_STREAM_NAMES)), empty), F.lit("\x1f"),
        F.coalesce(no_space(first_checked(*OWN_ACCOUNT_NAMES)), empty), F.lit("\x1f"),
        F.coalesce(casefold(first_checked(*CURRENCY_NAMES)), empty),
    )


def logical_stream() -> Column:
    """Logical key of a record's stream: explicit id, else account and currency, else the layout."""
    explicit, account, currency = shown_text(*BUILT_STREAM_NAMES), shown_text(*OWN_ACCOUNT_NAMES), shown_text(*CURRENCY_NAMES)
    known = present(account).isNotNull() | present(currency).isNotNull()
    return (
        F.when(present(explicit).isNotNull(), F.concat(F.lit("explicit:"), compact(explicit)))
        .when(known, F.concat(F.lit("account:"), compact(F.coalesce(account, F.lit(""))), F.lit("|currency:"), compact(F.coalesce(currency, F.lit("")))))
        .otherwise(F.concat(F.lit("layout:"), F.col("parser_id")))
    )


def with_values(df: DataFrame, money: tuple[str, ...], dates: tuple[str, ...]) -> DataFrame:
    """df with text columns _<x> read as money or dates x; the text columns are dropped.

    All texts of a kind go through one expression as an array: parsers are large, and plans with a copy of
    one for each column are slow to build.
    """
    texts = lambda names: F.array(*[F.col(f"_{n}") for n in names]).cast("array<string>")
    df = df.withColumns({"_money": F.transform(texts(money), lambda t: parse_amount_text(t)), "_dates": F.transform(texts(dates), lambda t: parse_date(t))})
    read = {n: F.get("_money", F.lit(k)).try_cast("decimal(38,2)") for k, n in enumerate(money)} | {n: F.get("_dates", F.lit(k)) for k, n in enumerate(dates)}
    return df.withColumns(read).drop("_money", "_dates", *[f"_{n}" for n in (*money, *dates)])


def checked_rows(candidates: DataFrame, also: tuple[Column | str, ...] = (), money: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate with its parsed values: stream, date_name, date, amount_name, amount, income, expense, balance, online_balance.

    A value is null where the field is absent or unreadable; columns <x>_there say whether it is present.
    ``also`` are further columns to carry, of which those called _<x> for x in money and dates are read too.
    """
    df = candidates.select(
        *KEY, ORDER, "fields", "status", *also,
        validation_stream().alias("stream"),
        first_name(*DATE_NAMES).alias("date_name"), first_checked(*DATE_NAMES).alias("_date"),
        first_name(*CHECKED_ACCOUNT_NAMES).alias("account_name"), first_checked(*CHECKED_ACCOUNT_NAMES).alias("_account"),
        first_name(*CURRENCY_NAMES).alias("currency_name"), first_checked(*CURRENCY_NAMES).alias("_currency"),
        first_checked(*AMOUNT_NAMES).alias("_direct"),
        *[checked_text(n).alias(f"_{n}") for n in ("income_amount", "expense_amount", "balance", "online_balance")],
    )
    checked = ("direct", "income_amount", "expense_amount", "balance", "online_balance")
    there = {f"{n}_there": F.col(f"_{n}").isNotNull() for n in checked}
    df = df.withColumns({"account_ok": account_ok(F.col("_account")), "currency_ok": currency_ok(F.col("_currency"))} | there).drop("_account", "_currency")
    df = with_values(df, (*checked, *money), ("date", *dates))
    amount = F.when(F.col("direct_there"), F.col("direct")).otherwise(net_amount(F.col("income_amount"), F.col("expense_amount")))
    return df.withColumns({"amount": amount, "known_balance": F.coalesce("balance", "online_balance")})


def chained_rows(rows: DataFrame) -> DataFrame:
    """checked_rows with occurrence of the (page, row) key, previous balance of the stream, and the date-order verdict.

    Only the row just before in the stream counts, so an unknown balance breaks the chain (W1). Dates must
    keep the direction of the stream's first change; rows without a date are passed over (W2).
    """
    order = ["page_index", "row_index", ORDER]
    by_key = Window.partitionBy(*KEY).orderBy(ORDER)
    by_stream = Window.partitionBy(DOC, "stream").orderBy(*order)
    dated = Window.partitionBy(DOC, "stream", F.col("date").isNull()).orderBy(*order)
    dated_whole = dated.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("occurrence", F.row_number().over(by_key)).withColumn("previous_balance", F.lag("known_balance").over(by_stream))
    rows = rows.withColumn("turn", F.when(F.col("date").isNotNull(), F.signum(F.datediff("date", F.lag("date").over(dated)))))
    first_turn = F.first(F.nullif("turn", F.lit(0.0)), ignorenulls=True).over(dated_whole)
    return rows.withColumn("date_breaks", F.coalesce((F.col("turn") != 0) & (F.col("turn") == -first_turn), F.lit(False)))


def validation_issues(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per issue: key, candidate_id, emit_ord, code, severity, rule_state, field_name.

    emit_ord orders the issues of a row. Rejected and duplicate rows are validated like all others, and
    review order does not matter (Q1). A null field map is an empty one; an empty table gives no rows.
    """
    # All windows are inside a document, so one shuffle by document serves them all.
    return chained_rows(checked_rows(candidates).repartition(DOC)).select(*KEY, ORDER, F.inline(row_issues(candidates, min_confidence)))


def row_issues(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """The issues of a row of chained_rows as an array, as validation_issues describes them."""

    def issue(order: int, code: str, when: Column, name: Column | str | None) -> Column:
        severity, state = ISSUES[code]
        shown = F.lit(name) if isinstance(name, str) or name is None else name
        return F.when(when, F.struct(F.lit(order).alias("emit_ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(state).alias("rule_state"), shown.cast("string").alias("field_name")))

    def unreadable(order: int, column: str, name: str, when: Column | None = None) -> Column:
        bad = F.col(f"{column}_there") & F.col(column).isNull()
        return issue(order, "invalid_amount", bad if when is None else bad & when, name)

    split = ~F.col("direct_there")
    weak = F.array_sort(F.map_keys(F.map_filter(F.coalesce("fields", F.expr("map()").cast(candidates.schema["fields"].dataType)), lambda _, v: v["confidence"] < min_confidence)))
    severity, state = ISSUES["low_confidence"]
    low = F.transform(
        weak,
        lambda n, i: F.struct((F.lit(100) + i).cast("int").alias("emit_ord"), F.lit("low_confidence").alias("code"), F.lit(severity).alias("severity"), F.lit(state).alias("rule_state"), n.alias("field_name")),
    )
    broken = F.coalesce(F.try_add("previous_balance", "amount") != F.col("known_balance"), F.lit(False))
    fixed = F.array(
        issue(0, "duplicate_row", F.col("occurrence") > 1, None),
        issue(1, "invalid_date", F.col("date_name").isNotNull() & F.col("date").isNull(), F.col("date_name")),
        issue(1000, "invalid_account", F.col("account_name").isNotNull() & ~F.col("account_ok"), F.col("account_name")),
        issue(1001, "invalid_currency", F.col("currency_name").isNotNull() & ~F.col("currency_ok"), F.col("currency_name")),
        unreadable(1002, "direct", "transaction_amount"),
        unreadable(1003, "income_amount", "income_amount", split),
        unreadable(1004, "expense_amount", "expense_amount", split),
        issue(1005, "missing_amount", split & F.col("income_amount").isNull() & F.col("expense_amount").isNull(), "amount"),
        unreadable(1006, "balance", "balance"),
        unreadable(1007, "online_balance", "online_balance", F.col("balance").isNull()),
        issue(1008, "invalid_balance", F.col("known_balance").isNull(), "balance"),
        issue(1009, "balance_mismatch", broken, "balance"),
        issue(1010, "possible_missing_transaction", broken, "transaction_amount"),
        issue(1011, "date_order", F.col("date_breaks"), "date"),
    )
    return F.concat(F.array_compact(fixed), low)


def reviewed_rows(candidates: DataFrame, min_confidence: float = MIN_CONFIDENCE, reports: DataFrame | None = None) -> DataFrame:
    """Each candidate with all that exports show of it, in one scan and one shuffle, by document.

    Adds to the candidate's columns: issues (its own, an array), key_issues (those of all rows of its key),
    report_status (of its page), comparison_id, and statement_stream_id and transaction_id, which a row
    marked duplicate lacks. reports may give the status of pages, as after stored reviews; a page without
    one is 'unknown'. Without them it follows from the issues as in page_reports.
    """
    record = {"r_direct": AMOUNT_NAMES, "r_income": BUILT_INCOME_NAMES, "r_expense": BUILT_EXPENSE_NAMES, "r_balance": BUILT_BALANCE_NAMES}
    also = (*[c for c in candidates.columns if c not in (*KEY, ORDER, "fields", "status")], logical_stream().alias("_logical"), shown_text(*DATE_NAMES).alias("_r_date"), *[shown_text(*n).alias(f"_{x}") for x, n in record.items()])
    by_document = checked_rows(candidates, also, tuple(record), ("r_date",)).repartition(DOC)
    rows = chained_rows(by_document).withColumn("issues", row_issues(candidates, min_confidence))
    by_key, by_page, by_doc = Window.partitionBy(*KEY), Window.partitionBy(DOC, "page_index"), Window.partitionBy(DOC).orderBy("page_index", F.coalesce("review_order", "row_index"), "row_index", ORDER)
    stream = F.when(F.coalesce(F.col("status"), F.lit("")) != "duplicate", ids.stream_id(F.col("_logical")))
    rows = rows.withColumns({
        "key_issues": F.flatten(F.collect_list("issues").over(by_key)), "comparison_id": ids.comparison_id(F.row_number().over(by_doc)), "statement_stream_id": stream,
    }).withColumn("transaction_id", F.when(F.col("statement_stream_id").isNotNull(), ids.transaction_id(F.col("statement_stream_id"), F.col("page_index"), F.col("row_index"))))
    if reports is not None:
        rows = rows.join(reports.select(DOC, "page_index", F.col("status").alias("report_status")), [DOC, "page_index"], "left")
    else:
        anywhere = lambda c: F.coalesce(F.bool_or(c).over(by_page), F.lit(False))
        open_ = F.exists("issues", lambda i: i["rule_state"].isin("fail", "indeterminate"))
        status = F.when(anywhere(open_) | anywhere(F.col("status") == "rejected"), "review").when(anywhere(is_normalized()), "pass_with_normalization").otherwise("pass")
        rows = rows.withColumn("report_status", status)
    return rows.select(*candidates.columns, "issues", "key_issues", F.coalesce("report_status", F.lit("unknown")).alias("report_status"), "comparison_id", "statement_stream_id", "transaction_id")


def is_normalized() -> Column:
    """Whether a field's suggestion differs from what was read."""
    return F.exists(F.map_values("fields"), lambda v: v["raw_text"] != F.coalesce(present(v["suggested_text"]), v["raw_text"]))


def attach_provenance(issues: DataFrame, candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Issues with the source blocks of their field and the box around them (J8, V12): adds source_block_indices, x0, y0, x1, y1.

    Row-level issues, absent fields and unlocated blocks have null. blocks hold statement_id, page_index,
    block_index and a box; where a row key repeats, the last ingested row is the source.
    """
    page = [DOC, "page_index"]
    last = candidates.groupBy(*KEY).agg(F.max_by("fields", ORDER).alias("_fields"))
    df = issues.join(last, KEY, "left").withColumn("source_block_indices", F.try_element_at("_fields", F.col("field_name"))["source_block_indices"]).drop("_fields")
    wanted = df.select(*page, F.col("source_block_indices").alias("_i")).where(F.size("_i") > 0).distinct()
    parts = wanted.select(*page, "_i", F.explode("_i").alias("block_index")).join(blocks.select(*page, "block_index", "x0", "y0", "x1", "y1"), [*page, "block_index"])
    boxes = parts.groupBy(*page, F.col("_i").alias("source_block_indices")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return df.join(boxes, [*page, "source_block_indices"], "left").select(*issues.columns, "source_block_indices", "x0", "y0", "x1", "y1")


def page_reports(candidates: DataFrame, issues: DataFrame, outcomes: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Risk report per page (A7, A9, A10, R1-R7): checked_rows, status, risk_score, reasons, final_balances.

    The first rule that holds decides: page error or parser status failed/page_review; a critical fail;
    any fail; any indeterminate issue; a rejected candidate; a normalised value; none. Issues in state
    pass or not_applicable never count. reasons are distinct, in order of first occurrence; the date-order
    issues of a page follow all others. outcomes may give parser_status and page_error per page. With
    ``by`` = [statement_id] the report is one per document (A8).
    """
    group = by or [DOC, "page_index"]
    rows = candidates.select(*KEY, ORDER, "fields", "status", *[checked_text(n).alias(f"_{n}") for n in ("balance", "online_balance")])
    rows = with_values(rows, ("balance", "online_balance"), ()).withColumn("known_balance", F.coalesce("balance", "online_balance"))
    per_page = rows.groupBy(*group).agg(
        F.count(F.lit(1)).cast("int").alias("checked_rows"),
        F.coalesce(F.bool_or(F.col("status") == "rejected"), F.lit(False)).alias("rejected"),
        F.coalesce(F.bool_or(is_normalized()), F.lit(False)).alias("normalized"),
        F.transform(F.array_sort(F.collect_list(F.struct("page_index", "row_index", ORDER, "known_balance"))), lambda r: r["known_balance"]).alias("final_balances"),
    )
    late = (F.col("code") == "date_order").cast("int")
    counted = issues.where(F.col("rule_state").isin("fail", "indeterminate"))
    entry = F.struct("page_index", late.alias("late"), "row_index", ORDER, "emit_ord", "code", "severity", "rule_state")
    per_issue = counted.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("list"))
    df = per_page.join(per_issue, group, "left").withColumn("list", F.coalesce("list", F.array().cast(per_issue.schema["list"].dataType)))
    df = df.withColumns({
        "fails": F.filter("list", lambda i: i["rule_state"] == "fail"),
        "critical": F.filter("list", lambda i: (i["rule_state"] == "fail") & (i["severity"] == "critical")),
        "unsure": F.filter("list", lambda i: i["rule_state"] == "indeterminate"),
    })
    if outcomes is None:
        df = df.withColumns({"parser_status": F.lit(None).cast("string"), "page_error": F.lit(None).cast("string")})
    else:
        df = df.join(outcomes.select(*group, "parser_status", "page_error"), group, "left")
    error = present(F.col("page_error")).isNotNull()
    stopped = error | F.col("parser_status").isin("failed", "page_review")
    stopped = F.coalesce(stopped, F.lit(False))
    told = lambda prefix, column: F.array_distinct(F.transform(column, lambda i: F.concat(F.lit(prefix), i["code"])))
    none = F.array().cast("array<string>")
    n = lambda column: F.size(column)
    case = lambda a, b, c, d, e, f, g: F.when(stopped, a).when(n("critical") > 0, b).when(n("fails") > 0, c).when(n("unsure") > 0, d).when(F.col("rejected"), e).when(F.col("normalized"), f).otherwise(g)
    review, lit = F.lit("review"), F.lit
    return df.select(
        *group,
        "checked_rows",
        case(lit("page_review"), review, review, review, review, lit("pass_with_normalization"), lit("pass")).alias("status"),
        case(lit(100), lit(100), F.least(lit(99), n("fails") * 40), F.least(lit(80), n("unsure") * 20), lit(80), lit(10), lit(0)).cast("int").alias("risk_score"),
        case(
            F.array_compact(F.array(F.when(error, lit("page_error")), F.when(F.col("parser_status").isNotNull(), F.concat(lit("parser:"), F.col("parser_status"))))),
            told("critical:", F.col("critical")), told("issue:", F.col("fails")), told("indeterminate:", F.col("unsure")),
            F.array(lit("candidate_rejected")), F.array(lit("normalized_value")), none,
        ).alias("reasons"),
        "final_balances",
    )


def plain_reports(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """Reports before risk is assessed (V13): review where any issue is open, score 100, 40, 20 or 0 by the worst, and the distinct codes in order."""
    page = [DOC, "page_index"]
    state, severity = F.col("rule_state"), F.col("severity")
    order = F.struct("page_index", (F.col("code") == "date_order").cast("int").alias("late"), "row_index", ORDER, "emit_ord", "code")
    found = issues.groupBy(*page).agg(
        F.bool_or((state == "fail") & (severity == "critical")).alias("critical"), F.bool_or(state == "fail").alias("fail"), F.bool_or(state == "indeterminate").alias("unsure"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda i: i["code"])).alias("reasons"),
    )
    rows = candidates.groupBy(*page).agg(F.count(F.lit(1)).cast("int").alias("checked_rows")).join(found, page, "left")
    score = F.when(F.col("critical"), 100).when(F.col("fail"), 40).when(F.col("unsure"), 20).otherwise(0)
    return rows.select(*page, "checked_rows", F.when(score > 0, "review").otherwise("pass").alias("status"), score.alias("risk_score"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def transaction_records(candidates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Ledger records of all candidates not marked duplicate (D18): ids, stream, date, amount, balance, and their order in the document.

    overrides may give logical_key per (statement_id, page_index, row_index), which replaces the derived
    key (J19). Unreadable dates and amounts are null.
    """
    kept = candidates.where(F.coalesce(F.col("status"), F.lit("")) != "duplicate")
    df = kept.select(
        *KEY, ORDER, "parser_id", "review_order", logical_stream().alias("_key"),
        shown_text(*DATE_NAMES).alias("_date"), shown_text(*AMOUNT_NAMES).alias("_direct"),
        shown_text(*BUILT_INCOME_NAMES).alias("_income"), shown_text(*BUILT_EXPENSE_NAMES).alias("_expense"), shown_text(*BUILT_BALANCE_NAMES).alias("_balance"),
    )
    if overrides is not None:
        df = df.join(overrides.select(*KEY, "logical_key"), KEY, "left").withColumn("_key", F.coalesce("logical_key", "_key"))
    df = df.withColumns({"statement_stream_id": ids.stream_id(F.col("_key")), "direct_there": present(F.col("_direct")).isNotNull()})
    df = with_values(df, ("direct", "income", "expense", "balance"), ("date",))
    amount = F.when(F.col("direct_there"), F.col("direct")).otherwise(net_amount(F.col("income"), F.col("expense")))
    in_document = Window.partitionBy(DOC).orderBy("page_index", F.coalesce("review_order", "row_index"), "row_index", ORDER)
    return df.select(
        *KEY, ORDER,
        ids.transaction_id(F.col("statement_stream_id"), F.col("page_index"), F.col("row_index")).alias("transaction_id"),
        "statement_stream_id",
        F.col("date").alias("transaction_date"), amount.alias("amount"), "balance",
        F.row_number().over(in_document).alias("record_order"),
    )


def stream_summary(records: DataFrame) -> DataFrame:
    """Records of each stream: how many, first and last date, net amount."""
    return records.groupBy("statement_stream_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"), F.sum("amount").alias("net_amount")
    )


def continuity(rows: DataFrame, stream: list[str], order: list[str], amount: str = "amount", balance: str = "balance") -> DataFrame:
    """Rows of typed ledgers whose balance does not follow from the row before it in its stream (W1, V9): all columns plus previous_balance and expected."""
    w = Window.partitionBy(*stream).orderBy(*order)
    df = rows.withColumn("previous_balance", F.lag(balance).over(w)).withColumn("expected", F.try_add(F.col("previous_balance"), F.col(amount)))
    return df.where(F.col("expected") != F.col(balance))
