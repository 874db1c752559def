"""Queries over candidates and ledgers: values, validation, risk, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import account_ok, currency_ok, net_amount, parse_amount
from ledgerloom.operators import ledger
from ledgerloom.plans import oracle
from ledgerloom.session import table

KEY = ["statement_id", "page_index", "row_index"]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "candidates")


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ledger_transactions")
    return rows.select("record_id", "account_number", *KEY, "amount", "balance")


def ledger_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ledger.continuity(ledger_rows(spark, sf_dir), ["statement_id", "account_number"], ["page_index", "row_index", "record_id"])
    return df.select("record_id", "previous_balance", "amount", "balance", F.col("expected").cast("decimal(38,2)").alias("expected"))


def ledger_chain_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cannot be checked because the balance before them in their stream is unknown."""
    from pyspark.sql import Window

    w = Window.partitionBy("statement_id", "account_number").orderBy("page_index", "row_index", "record_id")
    df = ledger_rows(spark, sf_dir).withColumn("prev", F.lag("balance").over(w)).withColumn("place", F.row_number().over(w))
    return df.where("place > 1 and prev is null and balance is not null").select("record_id", "balance")


def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.validation_issues(candidates(spark, sf_dir))


def _codes(*codes: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return validation_issues(spark, sf_dir).where(F.col("code").isin(*codes)).select("candidate_id", "code", "field_name")

    return run


def _codes_sql(*codes: str) -> str:
    return oracle.ledger(f"SELECT candidate_id, code, field_name FROM issues WHERE code IN ({', '.join(repr(c) for c in codes)})")


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    return ledger.page_reports(c, ledger.validation_issues(c)).select("statement_id", "page_index", "checked_rows", "status", "risk_score", F.array_join("reasons", ",").alias("reasons"))


def document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    df = ledger.page_reports(c, ledger.validation_issues(c), by=["statement_id"])
    return df.select("statement_id", "checked_rows", "status", "risk_score", F.size("final_balances").alias("balances"))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later deliveries of the same field of the same candidate."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "field_values").select("field_id", "candidate_id", "field_name")
    w = Window.partitionBy("candidate_id", "field_name").orderBy("field_id")
    return rows.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1").select("field_id", F.col("occurrence").cast("bigint").alias("occurrence"))


def amount_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda n: F.try_element_at("fields", F.lit(n))["raw_text"]
    return candidates(spark, sf_dir).select("candidate_id", parse_amount(raw("transaction_amount")).alias("amount"), parse_amount(raw("balance")).alias("balance"))


def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.try_element_at("fields", F.lit("transaction_date"))["raw_text"]
    return candidates(spark, sf_dir).select("candidate_id", parse_date(raw).alias("transaction_date"))


def text_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of every document's text with white space dropped and letters lowered."""
    plain = F.lower(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0b]+", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(plain).alias("characters"), F.md5(plain).alias("digest"))


def text_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text layer function over every raw text of the field values."""
    rows = table(spark, sf_dir, "field_values")
    named = {"tidy": text.normalize_text, "token": text.normalize_token, "header": text.normalize_header, "block": text.normalize_block, "compact": text.compact}
    return rows.select("field_id", *[f("raw_text").alias(n) for n, f in named.items()])


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine suggestion for the money and date fields of every candidate."""
    rows = candidates(spark, sf_dir).select("candidate_id", F.explode("fields").alias("field_name", "v")).where(F.col("field_name").isin("transaction_amount", "balance", "transaction_date"))
    return rows.select("candidate_id", "field_name", text.suggested_text("field_name", F.col("v.raw_text")).alias("suggestion"))


def account_currency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda n: F.try_element_at("fields", F.lit(n))["raw_text"]
    return candidates(spark, sf_dir).select("candidate_id", account_ok(raw("account_number")).alias("account_ok"), currency_ok(raw("currency")).alias("currency_ok"))


def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.functions.ids import stream_id

    return candidates(spark, sf_dir).select("candidate_id", ledger.logical_stream().alias("k")).select("candidate_id", stream_id(F.col("k")).alias("statement_stream_id"))


def transaction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ledger.transaction_records(candidates(spark, sf_dir))
    return df.select("candidate_id", "transaction_id", "statement_stream_id", "transaction_date", "amount", "balance", F.col("record_order").cast("bigint").alias("record_order"))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stream_summary(ledger.transaction_records(candidates(spark, sf_dir)))


def net_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net of income (returned lines) and expense (accepted lines) per order line; lines of neither kind are null."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem")
    net = net_amount(F.when(F.col("l_returnflag") == "R", price), F.when(F.col("l_returnflag") == "A", price))
    return rows.select("l_orderkey", "l_linenumber", net.cast("decimal(20,2)").alias("net_amount"))


QUERIES = {
    "ledger_balance_check": ledger_balance_check,
    "ledger_chain_break": ledger_chain_break,
    "validation_issues": validation_issues,
    "possible_missing": _codes("balance_mismatch", "possible_missing_transaction"),
    "date_order_issues": _codes("date_order"),
    "low_confidence": _codes("low_confidence"),
    "risk_report": risk_report,
    "document_report": document_report,
    "duplicate_rows": duplicate_rows,
    "amount_normalize": amount_normalize,
    "date_normalize": date_normalize,
    "text_compact": text_compact,
    "text_nfkc": text_nfkc,
    "suggestions": suggestions,
    "account_currency_check": account_currency_check,
    "stream_ids": stream_ids,
    "transaction_records": transaction_records,
    "stream_summary": stream_summary,
    "net_amount": net_amounts,
}

_RAW = lambda n: f"fields['{n}'].raw_text"
_STREAM = "statement_id, account_number ORDER BY page_index, row_index, record_id"
ORACLE = {
    "ledger_balance_check": f"""
SELECT record_id, previous_balance, amount, balance, CAST(previous_balance + amount AS DECIMAL(38,2)) AS expected
FROM (SELECT *, lag(balance) OVER (PARTITION BY {_STREAM}) AS previous_balance FROM ledger_transactions) WHERE previous_balance + amount <> balance""",
    "ledger_chain_break": f"""
SELECT record_id, balance FROM (SELECT *, lag(balance) OVER w AS prev, row_number() OVER w AS place FROM ledger_transactions WINDOW w AS (PARTITION BY {_STREAM}))
WHERE place > 1 AND prev IS NULL AND balance IS NOT NULL""",
    "validation_issues": oracle.ledger("SELECT statement_id, page_index, row_index, candidate_id, CAST(emit_ord AS INTEGER) AS emit_ord, code, severity, rule_state, field_name FROM issues"),
    "possible_missing": _codes_sql("balance_mismatch", "possible_missing_transaction"),
    "date_order_issues": _codes_sql("date_order"),
    "low_confidence": _codes_sql("low_confidence"),
    "risk_report": oracle.ledger("SELECT statement_id, page_index, checked_rows, status, risk_score, reasons FROM reports"),
    "document_report": oracle.ledger("""
SELECT statement_id, CAST(sum(checked_rows) AS INTEGER) AS checked_rows,
       CASE WHEN coalesce(sum(fails), 0) > 0 OR coalesce(sum(unsure), 0) > 0 OR bool_or(rejected) THEN 'review' WHEN bool_or(normalized) THEN 'pass_with_normalization' ELSE 'pass' END AS status,
       CAST(CASE WHEN coalesce(sum(criticals), 0) > 0 THEN 100 WHEN coalesce(sum(fails), 0) > 0 THEN least(99, 40 * sum(fails)) WHEN coalesce(sum(unsure), 0) > 0 THEN least(80, 20 * sum(unsure))
                 WHEN bool_or(rejected) THEN 80 WHEN bool_or(normalized) THEN 10 ELSE 0 END AS INTEGER) AS risk_score,
       CAST(sum(checked_rows) AS INTEGER) AS balances
FROM page_rows LEFT JOIN sums USING (statement_id, page_index) GROUP BY statement_id"""),
    "duplicate_rows": "SELECT field_id, occurrence FROM (SELECT field_id, row_number() OVER (PARTITION BY candidate_id, field_name ORDER BY field_id) AS occurrence FROM field_values) WHERE occurrence > 1",
    "amount_normalize": f"SELECT candidate_id, {oracle.amount(_RAW('transaction_amount'))} AS amount, {oracle.amount(_RAW('balance'))} AS balance FROM candidates",
    "date_normalize": f"SELECT candidate_id, {oracle.date(_RAW('transaction_date'))} AS transaction_date FROM candidates",
    "text_compact": r"SELECT doc_id, CAST(length(p) AS INTEGER) AS characters, md5(p) AS digest FROM (SELECT doc_id, lower(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) AS p FROM documents)",
    "suggestions": f"""
SELECT candidate_id, field_name, CASE WHEN field_name = 'transaction_date' THEN CAST({oracle.date('r')} AS VARCHAR) ELSE CAST({oracle.amount('r')} AS VARCHAR) END AS suggestion
FROM (SELECT candidate_id, e.key AS field_name, e.value.raw_text AS r FROM (SELECT candidate_id, unnest(map_entries(fields)) AS e FROM candidates))
WHERE field_name IN ('transaction_amount', 'balance', 'transaction_date')""",
    "account_currency_check": rf"""
SELECT candidate_id, regexp_full_match(regexp_replace({_RAW('account_number')}, '[\s-]', '', 'g'), '\d{{6,30}}') AS account_ok,
       upper({oracle.squeezed(_RAW('currency'))}) IN ('RMB', '人民币', '人民币元') OR regexp_full_match(upper({oracle.squeezed(_RAW('currency'))}), '[A-Z]{{3}}') AS currency_ok
FROM candidates""",
    "stream_ids": f"""
SELECT candidate_id, 'stream-' || substr(sha256('account:' || lower({oracle.squeezed('sa')}) || '|currency:' || lower({oracle.squeezed('sc')})), 1, 16) AS statement_stream_id
FROM (SELECT candidate_id, {oracle.shown('account_number')} AS sa, {oracle.shown('currency')} AS sc FROM candidates)""",
    "transaction_records": oracle.ledger("""
SELECT candidate_id, statement_stream_id || ':' || lpad(CAST(page_index AS VARCHAR), 4, '0') || ':' || lpad(CAST(row_index AS VARCHAR), 4, '0') AS transaction_id,
       statement_stream_id, transaction_date, amount, balance, record_order FROM records"""),
    "stream_summary": oracle.ledger("""
SELECT statement_stream_id, count(*) AS records, min(transaction_date) AS first_date, max(transaction_date) AS last_date, sum(amount) AS net_amount FROM records GROUP BY 1"""),
    "net_amount": """
SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN CAST(l_extendedprice AS DECIMAL(20,2)) WHEN 'A' THEN -CAST(l_extendedprice AS DECIMAL(20,2)) END AS net_amount FROM lineitem""",
}
