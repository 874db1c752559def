"""Text, money and date functions against value tables and plain restatements."""

import random
import re
import unicodedata
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ids, text
from ledgerloom.functions.dates import parse_date
from ledgerloom.functions.money import account_ok, currency_ok, net_amount, parse_amount, parse_amount_text


def apply(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).collect()]


@pytest.mark.parametrize("chunk", [0])
def test_amount_table(spark, chunk):
    table = {
        "1,234.50": "1234.50", "299,00": "299.00", "10,000": "10000.00", "￥ 20.00": "20.00", "(20.00)": "-20.00", "-0.50": "-0.50", "10,000.00": "10000.00", "(-5)": "5.00", "0,123": "123.00",
        "¥CNY5": "5.00", "4 861.75": "4861.75", "1,234,567": "1234567.00", "-0": "0.00", "+007.5": "7.50", "１２３": "123.00", "9" * 40: "9" * 40 + ".00",
        "1O.00": None, "12.3.4": None, "": None, "N/A": None, "1.234": None, "1,234,56": None, "-¥5": None, "CNY¥5": None, "1e5": None, "(": None, "()": None, "+-5,00": None, None: None,
    }
    assert [r[0] for r in apply(spark, table, parse_amount_text("v"))] == list(table.values())
    assert apply(spark, ["9" * 40, "5"], parse_amount("v")) == [(None,), (Decimal("5.00"),)]


def plain_amount(raw):
    t = re.sub(r"\s", "", unicodedata.normalize("NFKC", raw))
    negative = t.startswith("(") and t.endswith(")") and len(t) > 1
    t = t[1:-1] if negative else t
    for sign in ("¥", "CNY"):
        t = t.removeprefix(sign)
    if re.fullmatch(r"[+-]?\d+,\d{1,2}", t):
        t = t.replace(",", ".")
    elif re.fullmatch(r"[+-]?(\d{1,3}(,\d{3})+\.\d{1,2}|\d{1,3}(,\d{3}){2,}|\d+,\d{3})", t):
        t = t.replace(",", "")
    if not re.fullmatch(r"[+-]?\d+(\.\d{1,2})?", t):
        return None
    return -Decimal(t) if negative else Decimal(t)


def test_amount_random(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("0123456789,,..+-() ¥") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    got = [r[0] for r in apply(spark, values, parse_amount("v"))]
    assert got == [plain_amount(v) for v in values]


def test_dates(spark):
    table = {
        "2026/08/01": date(2026, 8, 1), "2026-8-1": date(2026, 8, 1), "20260801": date(2026, 8, 1), "2026年8月1日": date(2026, 8, 1), "2026-1/2": date(2026, 1, 2), "end 2026-08-01 x": date(2026, 8, 1),
        "2026/99/01": None, "2026-02-31": None, "unknown": None, "2026-08-01 2026-08-02": None, "0000-01-01": None, "12026-01-01": None, "": None, None: None,
    }
    assert [r[0] for r in apply(spark, table, parse_date("v"))] == list(table.values())


def test_text_forms(spark):
    values = ["ＡＢ  ﬁ　x", "Straße ΣΑΣ", None, "", "余额（元）: ①", "é"]
    got = apply(spark, values, text.nfkc("v"), text.casefold("v"), text.normalize_text("v"), text.normalize_token("v"), text.normalize_header("v"), text.compact("v"))
    for v, row in zip(values, got):
        if v is None:
            assert row == (None,) * 6
            continue
        n = unicodedata.normalize("NFKC", v)
        assert row[0] == n and row[1] == v.casefold() and row[2] == " ".join(n.split())
        assert row[3] == "".join(c for c in n if c.isalnum() or "㐀" <= c <= "鿿").casefold()
        assert row[4] == re.sub(r"[^0-9a-z㐀-鿿]+", "", n.casefold())
        assert row[5] == re.sub(r"\s+", "", v).casefold()


def test_checks_and_ids(spark):
    assert apply(spark, ["6222 0012-3456", "6222O", "12345"], account_ok(F.col("v"))) == [(True,), (False,), (False,)]
    assert apply(spark, ["rmb", "人民币元", " u s d", "CN¥"], currency_ok(F.col("v"))) == [(True,), (True,), (True,), (False,)]
    assert apply(spark, ["a"], ids.transaction_id(F.lit("s"), F.lit(2), F.lit(31)), ids.comparison_id(F.lit(7))) == [("s:0002:0031", "T0007")]
    none = F.lit(None).cast("decimal(18,2)")
    assert apply(spark, ["x"], net_amount(none, F.lit("43.54").cast("decimal(18,2)")), net_amount(none, none)) == [(Decimal("-43.54"), None)]
