"""Validation rules, risk and records: small cases, and random streams against a sequential fold."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

from ledgerloom.operators import ledger


def codes(df):
    return [(r["page_index"], r["row_index"], r["code"]) for r in ledger.validation_issues(df).orderBy("statement_id", "page_index", "row_index", "candidate_id", "emit_ord").collect()]


def row(page, index, amount, balance, day="2026-08-01", **more):
    return ("s", page, index, {"transaction_date": day, "transaction_amount": amount, "balance": balance, **more})


def test_continuous_and_broken(candidates):
    assert codes(candidates([row(0, 0, "10.00", "110.00"), row(0, 1, "-5.00", "105.00")])) == []
    assert codes(candidates([row(0, 0, "10.00", "110.00"), row(0, 1, "-5.00", "999.00")])) == [(0, 1, "balance_mismatch"), (0, 1, "possible_missing_transaction")]


def test_split_columns_and_junk(candidates):
    split = [("s", 0, k, {"date": "20260801", **f}) for k, f in enumerate(({"income_amount": "100", "balance": "100"}, {"expense_amount": "30", "balance": "70"}))]
    assert codes(candidates(split)) == []
    assert codes(candidates([row(0, 0, "1O.00", "5")])) == [(0, 0, "invalid_amount")]
    assert codes(candidates([("s", 0, 0, {"online_balance": "5"})])) == [(0, 0, "missing_amount")]
    assert codes(candidates([("s", 0, 0, {"balance": "x", "amount": "1"})])) == [(0, 0, "invalid_amount"), (0, 0, "invalid_balance")]
    assert codes(candidates([("s", 0, 0, None)])) == [(0, 0, "missing_amount"), (0, 0, "invalid_balance")]
    assert codes(candidates([])) == []


def test_order_duplicates_formats(candidates):
    rows = [row(0, 0, "1", "1", "2026-08-01"), row(0, 1, "1", "2", "2026-08-03"), row(0, 1, "1", "3", "2026-08-02")]
    assert codes(candidates(rows)) == [(0, 1, "duplicate_row"), (0, 1, "date_order")]
    assert codes(candidates([row(0, 0, "1", "1", currency="CN¥")])) == [(0, 0, "invalid_currency")]
    weak = row(0, 0, "1", "1", account_number=("6222O", "6222O", None, 0.40))
    assert codes(candidates([weak])) == [(0, 0, "low_confidence"), (0, 0, "invalid_account")]


def test_streams_are_apart_and_cross_pages(candidates):
    assert codes(candidates([row(0, 0, "100", "100", account_number="622200001"), row(0, 1, "50", "50", account_number="622200002")])) == []
    rows = [row(0, 0, "100", "100"), row(1, 0, "-20", "80"), row(1, 1, "-10", "75")]
    assert [c for c in codes(candidates(rows)) if c[2] == "balance_mismatch"] == [(1, 1, "balance_mismatch")]


def test_random_streams_match_a_fold(candidates):
    rng = random.Random(8)
    rows = []
    for doc in range(30):
        for k in range(rng.randint(1, 14)):
            day = (date(2026, 1, 1) + timedelta(days=rng.randint(0, 4))).isoformat() if rng.random() < 0.85 else "?"
            rows.append((f"d{doc}", k // 5, k % 5, {"transaction_date": day, "transaction_amount": str(rng.randint(-2, 2)), "balance": str(rng.randint(0, 3)) if rng.random() < 0.8 else "x", "account_number": f"62220000{rng.randint(1, 2)}"}))
    expected = []
    balance, dates, turn = {}, {}, defaultdict(int)
    for doc, page, index, f in rows:
        key = (doc, f["account_number"])
        now = Decimal(f["balance"]) if f["balance"] != "x" else None
        if balance.get(key) is not None and now is not None and balance[key] + Decimal(f["transaction_amount"]) != now:
            expected.append((doc, page, index, "balance_mismatch"))
        balance[key] = now
        if f["transaction_date"] != "?":
            d = date.fromisoformat(f["transaction_date"])
            if key in dates and d != dates[key]:
                sign = 1 if d > dates[key] else -1
                if turn[key] and sign != turn[key]:
                    expected.append((doc, page, index, "date_order"))
                turn[key] = turn[key] or sign
            dates[key] = d
    got = ledger.validation_issues(candidates(rows)).where("code in ('balance_mismatch', 'date_order')").collect()
    assert sorted((r[0], r[1], r[2], r["code"]) for r in got) == sorted(expected)


def report(candidates, rows, **kw):
    c = candidates(rows)
    r = ledger.page_reports(c, ledger.validation_issues(c), **kw).collect()
    return [(x["status"], x["risk_score"], x["reasons"]) for x in r]


def test_risk_levels(candidates, spark):
    assert report(candidates, [row(0, 0, "10", "110"), row(0, 1, "-5", "999")]) == [("review", 100, ["critical:balance_mismatch"])]
    assert report(candidates, [row(0, 0, "1", "1", "2026-08-01"), row(0, 1, "1", "2", "2026-08-03"), row(0, 2, "1", "3", "2026-08-02")]) == [("review", 40, ["issue:date_order"])]
    assert report(candidates, [row(0, 0, "x", "1", "?")]) == [("review", 40, ["indeterminate:invalid_date", "indeterminate:invalid_amount"])]
    assert report(candidates, [(*row(0, 0, "1", "1"), "rejected")]) == [("review", 80, ["candidate_rejected"])]
    assert report(candidates, [row(0, 0, ("1,0", "1.0"), "1")]) == [("pass_with_normalization", 10, ["normalized_value"])]
    assert report(candidates, [row(0, 0, "1", "1")]) == [("pass", 0, [])]
    outcomes = spark.createDataFrame([("s", 0, "failed", "broken")], "statement_id string, page_index int, parser_status string, page_error string")
    assert report(candidates, [row(0, 0, "x", "1")], outcomes=outcomes) == [("page_review", 100, ["page_error", "parser:failed"])]


def test_records(candidates, spark):
    rows = [
        ("s", 0, 0, {"account_number": "A 1", "currency": "cny", "transaction_date": "20260801", "transaction_amount": ("10,00", "10.00"), "balance": "5"}, "unreviewed", None, 5),
        ("s", 0, 1, {"account_number": "B", "currency": "cny", "income": "3", "expense": "1", "closing_balance": "7"}),
        ("s", 0, 2, {"balance": "1"}, "duplicate", (0, 0)),
        ("s", 0, 3, {"balance": "1"}),
    ]
    got = {r["row_index"]: r for r in ledger.transaction_records(candidates(rows)).collect()}
    assert sorted(got) == [0, 1, 3] and len({r["statement_stream_id"] for r in got.values()}) == 3
    assert got[0]["amount"] == Decimal("10.00") and got[1]["amount"] == Decimal("2.00") and got[1]["balance"] == Decimal("7.00") and got[3]["amount"] is None
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["record_order"])] == [1, 3, 0]
    over = spark.createDataFrame([("s", 0, 3, "explicit:x")], "statement_id string, page_index int, row_index int, logical_key string")
    moved = {r["row_index"]: r["statement_stream_id"] for r in ledger.transaction_records(candidates(rows), over).collect()}
    assert moved[3] != got[3]["statement_stream_id"] and moved[0] == got[0]["statement_stream_id"]
