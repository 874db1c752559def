"""Layout reconstruction on hand-made pages."""

import random

from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import layout, pages

W = 100.0


def blocks(spark, rows, doc="d", page=0):
    return spark.createDataFrame([(doc, page, k, t, *map(float, (x0, y0, x1, y1)), None, "native_pdf") for k, (t, x0, y0, x1, y1) in enumerate(rows)], schemas.BLOCKS)


def template(spark, columns, tokens=("日期", "金额"), required=(), strategy="grid", name="t1", ratio=0.25):
    return spark.createDataFrame([(name, "1", 0, list(tokens), columns, list(required), strategy, ratio)], schemas.TEMPLATES)


def page(spark, boundaries=None, template_id="t1", height=200.0):
    return spark.createDataFrame([("d", 0, W, height, boundaries, template_id)], "doc_id string, page_index int, page_width double, page_height double, boundaries array<double>, template_id string")


def fields(df):
    return {r["row_index"]: {n: v["raw_text"] for n, v in r["fields"].items()} for r in df.collect()}


GRID = [("日期", 5, 2, 20, 10), ("金额", 60, 2, 80, 10), ("2026-08-01", 5, 20, 30, 28), ("10.00", 60, 20, 80, 28), ("2026-08-02", 5, 50, 30, 58), ("20.00", 60, 50, 80, 58)]
COLUMNS = [("date", 0.0, 0.5), ("amount", 0.5, 1.0)]


def test_grid(spark):
    found, outcome = layout.parse_grid(page(spark, [0.0, 15.0, 45.0, 75.0]), blocks(spark, GRID), template(spark, COLUMNS, required=("date", "amount")))
    assert fields(found) == {1: {"date": "2026-08-01", "amount": "10.00"}, 2: {"date": "2026-08-02", "amount": "20.00"}}
    assert {r["fields"]["amount"]["source_block_indices"][0] for r in found.collect()} == {3, 5}
    assert [tuple(r) for r in outcome.collect()] == [("d", 0, "success", None, 2)]


def test_grid_fails_whole(spark):
    found, outcome = layout.parse_grid(page(spark, [0.0, 15.0, 45.0, 75.0]), blocks(spark, GRID[:-1]), template(spark, COLUMNS, required=("date", "amount")))
    assert found.count() == 0 and outcome.first()["status"] == "failed" and "2" in outcome.first()["reason"]
    assert layout.parse_grid(page(spark, [0.0, 45.0, 15.0]), blocks(spark, GRID), template(spark, COLUMNS))[1].first()["reason"] == "boundaries do not increase"
    assert layout.parse_grid(page(spark, [0.0, 1.0]), blocks(spark, GRID), template(spark, COLUMNS))[1].first()["reason"] == "no rows in the grid"


ANCHORED = [("日期", 2, 80, 18, 90), ("2026-08-01", 2, 100, 18, 108), ("9.00", 25, 100, 40, 108), ("first", 60, 102, 70, 108), ("line", 60, 113, 70, 119), ("2026-08-02", 2, 150, 18, 158), ("8.00", 25, 150, 40, 158)]
ANCHOR_COLUMNS = [("accounting_date", 0.0, 0.2), ("online_balance", 0.2, 0.5), ("summary", 0.5, 1.0)]


def test_anchors(spark):
    t = template(spark, ANCHOR_COLUMNS, required=("accounting_date", "online_balance"), strategy="anchor_date")
    found, outcome = layout.parse_anchors(page(spark), blocks(spark, ANCHORED), t)
    assert fields(found) == {0: {"accounting_date": "2026-08-01", "online_balance": "9.00", "summary": "first line"}, 1: {"accounting_date": "2026-08-02", "online_balance": "8.00"}}
    assert outcome.first()["candidates"] == 2
    assert layout.parse_anchors(page(spark), blocks(spark, ANCHORED[:1]), t)[1].first()["reason"] == "no date anchors"


def test_anchor_intervals_match_brute_force(spark):
    rng = random.Random(2)
    tops = sorted({float(rng.randint(0, 300)) for _ in range(25)})
    anchors = [(k, y, (tops[k + 1] - 5) if k + 1 < len(tops) else 400.0) for k, y in enumerate(tops)]
    marks = [float(rng.randint(0, 320)) for _ in range(200)]
    a = spark.createDataFrame([("d", 0, k, y, n) for k, y, n in anchors], "doc_id string, page_index int, row_index int, y0 double, next_top double")
    b = blocks(spark, [("x", 0.0, y - 1, 5.0, y + 1) for y in marks])
    got = {r["block_index"]: r["row_index"] for r in layout.attach_to_anchors(b, a, ["doc_id", "page_index"]).collect()}
    assert got == {i: k for i, y in enumerate(marks) for k, top, end in anchors if top <= y < end}


def test_row_grouping(spark):
    got = layout.group_rows(blocks(spark, [("amount", 80.0, 102.0, 90.0, 110.0), ("date", 10.0, 100.0, 20.0, 108.0), ("next", 10.0, 140.0, 20.0, 148.0), ("description", 40.0, 101.0, 70.0, 109.0)]), y_tolerance=4.0)
    assert [r["text"] for r in got.orderBy("row_index", "place").collect()] == ["date", "description", "amount", "next"]
    assert got.agg(F.max("row_index")).first()[0] == 1


def test_template_choice(spark):
    one = template(spark, COLUMNS, ("交易日期", "金额", "余额"), name="a")
    rows = [("交易日期", 0.0, 5.0, 9.0, 9.0), ("金 额", 20.0, 5.0, 29.0, 9.0), ("余额", 0.0, 190.0, 9.0, 199.0)]
    assert [(r["template_id"], round(r["score"], 3)) for r in layout.match_templates(page(spark), blocks(spark, rows), one).collect()] == [("a", 0.667)]
    tie = one.unionByName(template(spark, COLUMNS, ("交易日期", "金额", "无"), name="b"))
    assert layout.match_templates(page(spark), blocks(spark, rows), tie).count() == 0
    assert layout.match_templates(page(spark), blocks(spark, rows[2:]), one).count() == 0


def test_inferred_layouts(spark):
    head = [("交易日期", 0.0, 5.0, 20.0, 9.0), ("收入金额", 25.0, 5.0, 45.0, 9.0), ("账户余额", 50.0, 5.0, 70.0, 9.0), ("摘要", 75.0, 5.0, 95.0, 9.0)]
    r = layout.infer_layouts(page(spark), blocks(spark, head)).first()
    assert [c["name"] for c in r["columns"]] == ["accounting_date", "income_amount", "balance", "transaction_summary"]
    assert [round(c["left_ratio"], 3) for c in r["columns"]] == [0.0, 0.225, 0.475, 0.725] and r["columns"][-1]["right_ratio"] == 1.0
    assert "balance" in layout.infer_layouts(page(spark), blocks(spark, [*head, ("余额", 96.0, 5.0, 99.0, 9.0)])).first()["reason"]
    assert layout.infer_layouts(page(spark), blocks(spark, head[:1])).first()["reason"] == "no single date and balance column"


def test_dispatch(spark):
    both = template(spark, COLUMNS, ("日期", "金额"), required=("date",), name="t1")
    found, outcome = layout.parse_pages(page(spark, [0.0, 15.0, 45.0, 75.0]).drop("template_id"), blocks(spark, GRID), both)
    assert found.count() == 2 and outcome.first()["status"] == "success"
    flat = layout.parse_pages(page(spark).drop("template_id"), blocks(spark, GRID), both)[1]
    assert [(r["status"], r["reason"]) for r in flat.collect()] == [("failed", "a grid needs ruling lines")]
    unknown = layout.parse_pages(page(spark).drop("template_id"), blocks(spark, [("hello", 0.0, 1.0, 5.0, 9.0)]), both)[1]
    assert [r["status"] for r in unknown.collect()] == ["page_review"]


def test_inferred_layout_is_the_pages_own(spark):
    def rows(date, amount, balance, summary):
        heads = zip(("交易日期", "收入金额", "账户余额", "摘要"), (date, amount, balance, summary))
        cells = zip(("2026-08-01", "10.00", "9.00", "rent"), (date, amount, balance, summary))
        return [(t, c - 4, 5.0, c + 4, 9.0) for t, c in heads] + [(t, c - 4, 100.0, c + 4, 108.0) for t, c in cells]

    both = page(spark).unionByName(page(spark).withColumn("page_index", F.lit(1))).drop("template_id")
    text = blocks(spark, rows(10.0, 35.0, 60.0, 85.0)).unionByName(blocks(spark, rows(5.0, 17.0, 29.0, 70.0), page=1))
    found, outcome = layout.parse_pages(both, text, template(spark, COLUMNS, ("无", "没有")))
    assert sorted((r["page_index"], r["status"], r["candidates"]) for r in outcome.collect()) == [(0, "success", 1), (1, "success", 1)]
    want = {"accounting_date": "2026-08-01", "income_amount": "10.00", "balance": "9.00", "transaction_summary": "rent"}
    assert {r["page_index"]: {n: v["raw_text"] for n, v in r["fields"].items()} for r in found.collect()} == {0: want, 1: want}


def test_recovery(spark, candidates):
    from ledgerloom.operators.ledger import validation_issues

    c = candidates([("d", 0, k, {"transaction_amount": ("x", "x", None, None, [k]), "balance": ("1", "1", None, None, [40])}) for k in range(30)])
    targets = layout.recovery_targets(validation_issues(c), c, ["statement_id", "page_index"])
    assert targets.count() == 24 and [r["row_index"] for r in targets.orderBy("target_order").collect()] == list(range(24))
    b = spark.createDataFrame([("d", 0, k, 10.0 * k, 0.0, 10.0 * k + 5, 4.0) for k in range(5)], "statement_id string, page_index int, block_index int, x0 double, y0 double, x1 double, y1 double")
    got = layout.field_regions(targets, c, b, ["statement_id", "page_index"]).orderBy("row_index").collect()
    assert len(got) == 5 and (got[1]["x0"], got[1]["y1"]) == (8.0, 6.0)


def test_pages(spark):
    rows = [("a", 0, 120, 0, None, 9.0, 9.0, 0, "f"), ("a", 1, 0, 1, None, 9.0, 9.0, 90, "f"), ("a", 2, 120, 1, None, 9.0, 9.0, 0, "g"), ("a", 3, None, None, None, 9.0, 9.0, None, None), ("a", 4, 1, 1, "bad", 9.0, 9.0, 0, "")]
    p = spark.createDataFrame(rows, schemas.PAGES)
    assert [r["kind"] for r in pages.classify_pages(p).orderBy("page_index").collect()] == ["native_text", "scan_image", "hybrid", "blank", "page_error"]
    r = pages.preflight(p).first()
    assert (r["blank_pages"], r["rotated_pages"], r["error_pages"], r["repeated_pages"], len(r["warnings"])) == ([3], [1], [4], [[0, 1]], 4)


def test_quality_and_copies(spark):
    p = spark.createDataFrame([("d", k, 100.0, 100.0) for k in range(3)], "doc_id string, page_index int, page_width double, page_height double")
    b = blocks(spark, [("ok text", -1.0, 0.0, 5.0, 5.0), ("bad\x01", 0.0, 0.0, 5.0, 60.0)]).unionByName(blocks(spark, [("fine", 0.0, 0.0, 5.0, 5.0)], page=1))
    got = {r["page_index"]: r["reasons"] for r in pages.text_quality(p, b).collect()}
    assert got == {0: ["bbox_out_of_bounds", "invalid_characters", "bbox_height_anomaly"], 1: [], 2: ["empty_text_layer", "text_layer_too_sparse"]}
    two = spark.createDataFrame([("d", 0, 0, "A b", 0.0, 0.0, 10.0, 10.0, 0.9, "ocr"), ("d", 0, 1, "ＡB", 0.0, 0.0, 10.0, 10.0, None, "native_pdf"), ("d", 0, 2, "ab", 0.0, 0.0, 10.0, 9.0, 0.8, "ocr"), ("d", 0, 3, "ab", 50.0, 0.0, 60.0, 9.0, 0.8, "ocr")], schemas.BLOCKS)
    assert [r["block_index"] for r in pages.deduplicate_blocks(two).collect()] == [1, 3]
    assert sorted(r["block_index"] for r in pages.drop_ocr_copies(two).collect()) == [1, 3]


def test_rows_by_height_match_comparing_all():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        tolerance, least = rng.choice([0.0, 4.0, 8.0]), rng.choice([0.0, 0.25, 0.6])
        boxes = sorted((rng.uniform(0, 120), rng.uniform(1, 25)) for _ in range(40))
        tops, bottoms = np.array([a for a, _ in boxes]), np.array([a + h for a, h in boxes])
        rows, expected = [], []
        for a, b in zip(tops, bottoms):
            fit = []
            for k, (low, high) in enumerate(rows):
                share, away = max(0.0, min(b, high) - max(a, low)) / (b - a), abs((low + high) / 2 - (a + b) / 2)
                if share >= least or away <= tolerance:
                    fit.append((-share, away, k))
            k = min(fit)[2] if fit else len(rows)
            if not fit:
                rows.append((a, b))
            rows[k] = (min(rows[k][0], a), max(rows[k][1], b))
            expected.append(k)
        assert layout.rows_by_height(tops, bottoms, tolerance, least).tolist() == expected


def test_many_templates_and_bands(spark, monkeypatch):
    one = template(spark, COLUMNS)
    for at_once in (1, 2, 500):
        monkeypatch.setattr(layout, "TEMPLATES_AT_ONCE", at_once)
        many = one.unionByName(template(spark, COLUMNS, tokens=("日期", "柜员"), name="t2")).unionByName(template(spark, COLUMNS, tokens=("金额", "2026-08-02"), name="t3", ratio=0.5)).unionByName(template(spark, COLUMNS, tokens=("x",), name="t0"))
        assert {(r["template_id"], r["score"]) for r in layout.match_templates(page(spark), blocks(spark, GRID), many).collect()} == set()  # t1 and t3 tie
        best = many.where("template_id <> 't3'")
        assert [(r["template_id"], r["score"]) for r in layout.match_templates(page(spark), blocks(spark, GRID), best).collect()] == [("t1", 1.0)]
    assert layout.match_templates(page(spark), blocks(spark, GRID), one.limit(0)).count() == 0


def test_anchor_without_a_block_is_a_row(spark):
    """The centre of the first date lies below the top of the second one, so the first row has no block."""
    close = [("2026-08-01", 2, 97, 18, 105), ("2026-08-02", 2, 100, 18, 108), ("9.00", 25, 100, 40, 108)]
    strict = template(spark, ANCHOR_COLUMNS, required=("accounting_date",), strategy="anchor_date")
    found, outcome = layout.parse_anchors(page(spark), blocks(spark, close), strict)
    assert found.count() == 0 and outcome.first()["reason"] == "anchor row 0 lacks required fields: accounting_date"
    found, outcome = layout.parse_anchors(page(spark), blocks(spark, close), template(spark, ANCHOR_COLUMNS, strategy="anchor_date"))
    assert [r["row_index"] for r in found.collect()] == [1] and outcome.first()["candidates"] == 2
