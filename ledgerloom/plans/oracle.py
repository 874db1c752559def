"""Pieces of DuckDB SQL that several oracles share; written from the value contracts, not from the Spark plans."""

from __future__ import annotations


def amount(e: str) -> str:
    """Exact value of an ASCII (or full-width yen) amount text as DECIMAL(38,2)."""
    a = f"replace(regexp_replace({e}, '\\s', '', 'g'), '￥', '¥')"
    wrapped = f"(starts_with({a}, '(') AND ends_with({a}, ')') AND length({a}) > 1)"
    b = f"regexp_replace(CASE WHEN {wrapped} THEN substr({a}, 2, length({a}) - 2) ELSE {a} END, '^¥?(CNY)?', '')"
    value = rf"""CASE WHEN regexp_full_match({b}, '[+-]?\d+(\.\d{{1,2}})?') THEN try_cast({b} AS DECIMAL(38,2))
        WHEN regexp_full_match({b}, '[+-]?\d{{1,3}}(,\d{{3}})+\.\d{{1,2}}|[+-]?\d{{1,3}}(,\d{{3}}){{2,}}|[+-]?\d+,\d{{3}}') THEN try_cast(replace({b}, ',', '') AS DECIMAL(38,2))
        WHEN regexp_full_match({b}, '[+-]?\d+,\d{{1,2}}') THEN try_cast(replace({b}, ',', '.') AS DECIMAL(38,2)) END"""
    return f"((CASE WHEN {wrapped} THEN -1 ELSE 1 END) * ({value}))::DECIMAL(38,2)"


def date(e: str) -> str:
    """DATE of a text by the separated, compact or single-token rule."""
    t = f"trim(regexp_replace(replace(replace(replace({e}, '年', '/'), '月', '/'), '日', ''), '\\s+', ' ', 'g'))"
    tokens = rf"regexp_extract_all({t}, '(?:^|\D)(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}})(?:\D|$)', 1)"
    one = rf"CASE WHEN regexp_full_match({t}, '\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}') THEN {t} WHEN len({tokens}) = 1 THEN {tokens}[1] END"
    part = lambda k: rf"regexp_extract({one}, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})$', {k})"
    iso = f"{part(1)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(3)}, 2, '0')"
    packed = f"substr({t}, 1, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2)"
    return rf"(CASE WHEN regexp_full_match({t}, '\d{{8}}') THEN try_cast({packed} AS DATE) WHEN {one} IS NOT NULL THEN try_cast({iso} AS DATE) END)"


def checked(name: str) -> str:
    """Text that validation reads of a field."""
    return f"CASE WHEN fields['{name}'] IS NOT NULL THEN coalesce(fields['{name}'].final_text, fields['{name}'].suggested_text, '') END"


def shown(name: str) -> str:
    """Text that records and exports show of a field."""
    return f"CASE WHEN fields['{name}'] IS NOT NULL THEN coalesce(nullif(fields['{name}'].final_text, ''), nullif(fields['{name}'].suggested_text, ''), fields['{name}'].raw_text) END"


def squeezed(e: str) -> str:
    return f"regexp_replace({e}, '\\s', '', 'g')"


#: The candidate table's values as validation reads them, its chains and issues, reports per page, and records.
LEDGER = rf"""
texts AS (
  SELECT statement_id, page_index, row_index, candidate_id, parser_id, status, review_order, duplicate_of, fields,
         {checked("transaction_date")} AS d, {checked("account_number")} AS a, {checked("currency")} AS c, {checked("transaction_amount")} AS m, {checked("balance")} AS b
  FROM candidates),
checked AS (
  SELECT *, {squeezed("coalesce(a, '')")} || chr(31) || lower(coalesce(c, '')) AS stream, {date("d")} AS dd, {amount("m")} AS mm, {amount("b")} AS bb
  FROM texts),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY statement_id, page_index, row_index ORDER BY candidate_id) AS occurrence,
         lag(bb) OVER (PARTITION BY statement_id, stream ORDER BY page_index, row_index, candidate_id) AS pb,
         CASE WHEN dd IS NOT NULL THEN sign(dd - lag(dd) OVER (PARTITION BY statement_id, stream, dd IS NULL ORDER BY page_index, row_index, candidate_id)) END AS turn
  FROM checked),
chained AS (
  SELECT *, first_value(nullif(turn, 0) IGNORE NULLS) OVER (PARTITION BY statement_id, stream, dd IS NULL ORDER BY page_index, row_index, candidate_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS way
  FROM turned),
weak AS (
  SELECT statement_id, page_index, row_index, candidate_id, e.key AS field_name,
         99 + row_number() OVER (PARTITION BY candidate_id ORDER BY e.key) AS emit_ord
  FROM (SELECT statement_id, page_index, row_index, candidate_id, unnest(map_entries(fields)) AS e FROM candidates) WHERE e.value.confidence < 0.8),
issues AS (
  SELECT statement_id, page_index, row_index, candidate_id, 0 AS emit_ord, 'duplicate_row' AS code, 'critical' AS severity, 'fail' AS rule_state, NULL AS field_name FROM chained WHERE occurrence > 1
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1, 'invalid_date', 'error', 'indeterminate', 'transaction_date' FROM chained WHERE d IS NOT NULL AND dd IS NULL
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, emit_ord, 'low_confidence', 'error', 'indeterminate', field_name FROM weak
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1000, 'invalid_account', 'error', 'indeterminate', 'account_number' FROM chained WHERE NOT regexp_full_match(regexp_replace(a, '[\s-]', '', 'g'), '\d{{6,30}}')
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1001, 'invalid_currency', 'error', 'indeterminate', 'currency' FROM chained
    WHERE NOT (upper({squeezed("c")}) IN ('RMB', '人民币', '人民币元') OR regexp_full_match(upper({squeezed("c")}), '[A-Z]{{3}}'))
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1002, 'invalid_amount', 'error', 'indeterminate', 'transaction_amount' FROM chained WHERE m IS NOT NULL AND mm IS NULL
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1005, 'missing_amount', 'error', 'indeterminate', 'amount' FROM chained WHERE m IS NULL
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1006, 'invalid_amount', 'error', 'indeterminate', 'balance' FROM chained WHERE b IS NOT NULL AND bb IS NULL
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1008, 'invalid_balance', 'error', 'indeterminate', 'balance' FROM chained WHERE bb IS NULL
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1009, 'balance_mismatch', 'critical', 'fail', 'balance' FROM chained WHERE pb + mm <> bb
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1010, 'possible_missing_transaction', 'error', 'indeterminate', 'transaction_amount' FROM chained WHERE pb + mm <> bb
  UNION ALL SELECT statement_id, page_index, row_index, candidate_id, 1011, 'date_order', 'error', 'fail', 'date' FROM chained WHERE turn <> 0 AND turn = -way),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY statement_id, page_index ORDER BY page_index, (code = 'date_order')::INT, row_index, candidate_id, emit_ord) AS seq FROM issues),
firsts AS (
  SELECT statement_id, page_index, rule_state, severity, code, min(seq) AS seq, count(*) AS n FROM ranked GROUP BY ALL),
sums AS (
  SELECT statement_id, page_index, coalesce(sum(n) FILTER (rule_state = 'fail'), 0) AS fails, coalesce(sum(n) FILTER (rule_state = 'fail' AND severity = 'critical'), 0) AS criticals,
         coalesce(sum(n) FILTER (rule_state = 'indeterminate'), 0) AS unsure,
         string_agg('critical:' || code, ',' ORDER BY seq) FILTER (rule_state = 'fail' AND severity = 'critical') AS r_critical,
         string_agg('indeterminate:' || code, ',' ORDER BY seq) FILTER (rule_state = 'indeterminate') AS r_unsure,
         string_agg('issue:' || code, ',' ORDER BY seq) FILTER (rule_state = 'fail') AS r_fail
  FROM firsts GROUP BY ALL),
page_rows AS (
  SELECT statement_id, page_index, count(*) AS checked_rows, bool_or(status = 'rejected') AS rejected,
         bool_or(len(list_filter(map_values(fields), lambda v: v.raw_text <> coalesce(nullif(v.suggested_text, ''), v.raw_text))) > 0) AS normalized
  FROM candidates GROUP BY ALL),
reports AS (
  SELECT p.statement_id, p.page_index, CAST(checked_rows AS INTEGER) AS checked_rows,
         CASE WHEN criticals > 0 OR fails > 0 OR unsure > 0 OR rejected THEN 'review' WHEN normalized THEN 'pass_with_normalization' ELSE 'pass' END AS status,
         CAST(CASE WHEN criticals > 0 THEN 100 WHEN fails > 0 THEN least(99, 40 * fails) WHEN unsure > 0 THEN least(80, 20 * unsure) WHEN rejected THEN 80 WHEN normalized THEN 10 ELSE 0 END AS INTEGER) AS risk_score,
         CASE WHEN criticals > 0 THEN r_critical WHEN fails > 0 THEN r_fail WHEN unsure > 0 THEN r_unsure WHEN rejected THEN 'candidate_rejected' WHEN normalized THEN 'normalized_value' ELSE '' END AS reasons
  FROM page_rows p LEFT JOIN sums USING (statement_id, page_index)),
shown AS (
  SELECT *, {shown("account_number")} AS sa, {shown("currency")} AS sc, {shown("transaction_date")} AS sd, {shown("transaction_amount")} AS sm, {shown("balance")} AS sb FROM candidates),
records AS (
  SELECT statement_id, page_index, row_index, candidate_id,
         'stream-' || substr(sha256('account:' || lower({squeezed("sa")}) || '|currency:' || lower({squeezed("sc")})), 1, 16) AS statement_stream_id,
         {date("sd")} AS transaction_date, {amount("sm")} AS amount, {amount("sb")} AS balance,
         row_number() OVER (PARTITION BY statement_id ORDER BY page_index, coalesce(review_order, row_index), row_index, candidate_id) AS record_order
  FROM shown WHERE status IS DISTINCT FROM 'duplicate'),
comparison AS (
  SELECT statement_id, page_index, row_index, candidate_id,
         'T' || lpad(CAST(row_number() OVER (PARTITION BY statement_id ORDER BY page_index, coalesce(review_order, row_index), row_index, candidate_id) AS VARCHAR), 4, '0') AS comparison_id
  FROM candidates)
"""


def ledger(select: str) -> str:
    return f"WITH {LEDGER} {select}"
