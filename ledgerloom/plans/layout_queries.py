"""Queries of page and layout operators over pages printed from the candidate table.

``printed_pages`` sets each candidate's fields into columns of a page, a row per candidate, under a header;
the layout operators then have to win the candidates back. Text-layer pages come from the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import geometry
from ledgerloom.operators import layout, pages
from ledgerloom.session import table, written

#: Printed columns: field, left and right ratio, header wording.
COLUMNS = [
    ("transaction_date", 0.0, 0.15, "记账日期"), ("transaction_amount", 0.15, 0.3, "发生金额"), ("balance", 0.3, 0.45, "账户余额"),
    ("description", 0.45, 0.7, "交易用途栏"), ("counterparty_name", 0.7, 1.0, "对方户名栏"),
]
WIDTH, HEIGHT, TOP, PITCH = 600.0, 2000.0, 30.0, 20.0
PAGE = ["doc_id", "page_index"]
#: Order of the lines of an order; line numbers alone repeat.
LINE = "cast(l_linenumber * 1000000 + l_partkey as int)"


def templates(spark: SparkSession, strategy: str = "grid", required: tuple[str, ...] = ("transaction_date", "transaction_amount")) -> DataFrame:
    columns = [(n, a, b) for n, a, b, _ in COLUMNS]
    rows = [
        ("printed_v1", "1", 0, [h for *_, h in COLUMNS], columns, list(required), strategy, 0.25),
        ("other_v1", "1", 1, ["发生金额", "摘要", "柜员", "凭证号"], columns, [], strategy, 0.25),
    ]
    from ledgerloom import schemas

    return spark.createDataFrame(rows, schemas.TEMPLATES)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates")
    rank = F.row_number().over(Window.partitionBy("statement_id", "page_index").orderBy("row_index", "candidate_id"))
    return c.select("candidate_id", F.col("statement_id").alias("doc_id"), "page_index", "row_index", "fields", rank.alias("place"))


def printed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, blocks) of all candidates; boundaries are the ruling lines around the header and each row."""
    rows = _ranked(spark, sf_dir)
    n = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).cast("int").alias("n"))
    page = n.select(*PAGE, F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), F.expr(f"concat(array(0D), transform(sequence(0, n), k -> {TOP}D + {PITCH}D * k))").alias("boundaries"), "n")
    cells = []
    for k, (name, left, right, _) in enumerate(COLUMNS):
        text = F.try_element_at("fields", F.lit(name))["raw_text"]
        y = TOP + PITCH * (F.col("place") - 1) + 5.0
        cells.append(F.when(text.isNotNull(), F.struct((F.col("place") * 10 + k).alias("block_index"), text.alias("text"), F.lit(left * WIDTH + 4).alias("x0"), y.alias("y0"), F.lit(right * WIDTH - 4).alias("x1"), (y + 10.0).alias("y1"))))
    body = rows.select(*PAGE, F.inline(F.array_compact(F.array(*cells))))
    # A header wording is missing where (rows + column) is a multiple of four, so that pages match their template differently well.
    head = F.array(*[
        F.when((F.col("n") + k) % 4 != 0, F.struct(F.lit(k).alias("block_index"), F.lit(h).alias("text"), F.lit(a * WIDTH + 4).alias("x0"), F.lit(8.0).alias("y0"), F.lit(b * WIDTH - 4).alias("x1"), F.lit(18.0).alias("y1")))
        for k, (_, a, b, h) in enumerate(COLUMNS)
    ])
    header = page.select(*PAGE, F.inline(F.array_compact(head)))
    blocks = header.unionByName(body).select(*PAGE, F.col("block_index").cast("int").alias("block_index"), "text", "x0", "y0", "x1", "y1", F.lit(None).cast("double").alias("confidence"), F.lit("native_pdf").alias("source_type"))
    return page, blocks


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages from the documents: a thousand neighbours of a source are one, with text length, an image for scanned kinds, and the content's fingerprint."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("doc_id"), (F.col("doc_id") % 1000).cast("int").alias("page_index"), F.length(F.trim(text)).alias("native_text_chars"),
        F.when(F.col("kind").isin("statement_page", "process_log"), 1).otherwise(0).alias("image_count"), F.when(F.col("text").isNull(), "no text layer").alias("error"),
        F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), F.when(F.col("doc_id") % 10 == 0, 90).otherwise(0).cast("int").alias("rotation"), F.sha2(text, 256).alias("content_fingerprint"), "doc_id",
    ).toDF("doc_id", "page_index", "native_text_chars", "image_count", "error", "page_width", "page_height", "rotation", "content_fingerprint", "source_doc")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from order lines: a page per order, native where the line is open, else read; every third box repeats the text of the first."""
    rows = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 5) * 40.0, (F.col("l_suppkey") % 3) * 30.0
    return rows.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.expr(LINE).alias("block_index"),
        F.concat(F.lit("Line "), (F.col("l_linenumber") % 2).cast("string")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 30 + (F.col("l_quantity") % 3)).alias("x1"), (y + 20).alias("y1"),
        (F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_linestatus") == "O", "native_pdf").otherwise("ocr").alias("source_type"),
    )


def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.classify_pages(text_pages(spark, sf_dir)).select(F.col("source_doc").alias("page_id"), "kind")


def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages.repeated_pages(text_pages(spark, sf_dir))
    return df.select("doc_id", "content_fingerprint", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages.preflight(text_pages(spark, sf_dir))
    size = lambda c: F.size(c).alias(c)
    return df.select("doc_id", "page_count", size("blank_pages"), size("rotated_pages"), size("error_pages"), size("repeated_pages"), F.array_join("warnings", ";").alias("warnings"))


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each document's text as one block of a page, its width from the text's length."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    page = d.select("doc_id", F.lit(0).alias("page_index"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    n = F.length("text")
    blocks = d.where("text is not null").select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("block_index"), "text", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (n % 700).cast("double").alias("x1"), (n % 300 + 1).cast("double").alias("y1"))
    df = pages.text_quality(page, blocks)
    return df.select("doc_id", "accepted", F.array_join("reasons", ",").alias("reasons"))


def block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.drop_ocr_copies(line_blocks(spark, sf_dir)).select("doc_id", "block_index", "source_type")


def block_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.deduplicate_blocks(line_blocks(spark, sf_dir)).select("doc_id", "block_index", "source_type")


def block_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    return pages.block_evidence(blocks, page).select("doc_id", "page_index", "block_index", "box", "center_ratio")


def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("left_ratio"), F.lit(b).alias("right_ratio")) for n, a, b in (("first", 0.0, 0.3), ("second", 0.25, 0.5), ("third", 0.5, 0.9))])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.column_at(columns, (F.col("l_partkey") % 1000) / 1000.0).alias("field_name"))


def band_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = F.array(*[F.lit(float(b)) for b in (5, 15, 30, 45)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layout.band_at(bands, F.col("l_quantity")).alias("band"))


def anchor_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user attached to the purchase before them, up to five minutes before the next purchase."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 6e7).alias("m"))
    w = Window.partitionBy("user_id").orderBy("m", "event_id")
    anchors = e.where("event_type = 'purchase'").select("user_id", F.col("m").alias("y0"), (F.row_number().over(w) - 1).alias("row_index"), F.coalesce(F.lead("m").over(w) - 5.0, F.lit(1e18)).alias("next_top"))
    blocks = e.select("event_id", "user_id", F.col("m").alias("y0"), F.col("m").alias("y1"))
    return layout.attach_to_anchors(blocks, anchors, ["user_id"]).select("event_id", "row_index")


def cell_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of order lines of one flag joined into cells in line order."""
    placed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("field_name"), F.expr(LINE).alias("block_index"), F.concat(F.lit(" p"), F.col("l_partkey"), F.lit(" ")).alias("text"), (F.col("l_quantity") / 50).alias("confidence"),
        *[F.col("l_quantity").alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    df = layout.assemble_cells(placed, ["l_orderkey"])
    return df.select("l_orderkey", "field_name", "raw_text", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("source_block_indices", lambda i: i.cast("string")), ",").alias("indices"), "x0", "x1")


def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    return layout.match_templates(page, blocks, templates(spark)).select("doc_id", "page_index", "template_id", F.round("score", 6).alias("score"))


def _grid(spark: SparkSession, sf_dir: str, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    page, blocks = printed_pages(spark, sf_dir)
    return layout.parse_grid(page.withColumn("template_id", F.lit("printed_v1")), blocks, templates(spark, required=required))


def _cells(candidates: DataFrame) -> DataFrame:
    return candidates.select("doc_id", "page_index", "row_index", F.explode("fields").alias("field_name", "v")).select("doc_id", "page_index", "row_index", "field_name", F.col("v.raw_text").alias("raw_text"))


def grid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(_grid(spark, sf_dir, ("transaction_date", "transaction_amount"))[0])


def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each page if every row must have a balance and a counterparty."""
    return _grid(spark, sf_dir, ("balance", "counterparty_name"))[1].select("doc_id", "page_index", "status", "candidates")


def anchor_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    return _cells(layout.parse_anchors(page.withColumn("template_id", F.lit("printed_v1")), blocks, templates(spark, "anchor_date"))[0])


def generic_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    df = layout.infer_layouts(page.withColumn("page_height", F.lit(80.0)), blocks)
    edges = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], F.round(c["left_ratio"], 4).cast("string"))), ",")
    return df.select("doc_id", "page_index", edges.alias("columns"), F.col("reason").isNull().alias("inferred"))


def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every page by its own way: matched grid, or a layout inferred from its header, or review.

    The template asks for two of the printed headers and a third that no page has, so that pages which lack one of the two are on their own.
    """
    page, blocks = printed_pages(spark, sf_dir)
    asked = templates(spark).where("template_id = 'printed_v1'").withColumn("header_tokens", F.array(F.lit(COLUMNS[1][3]), F.lit(COLUMNS[3][3]), F.lit("凭证号")))
    return layout.parse_pages(page.withColumn("page_height", F.lit(80.0)), written(blocks), asked)[1].select("doc_id", "page_index", "status", "candidates")


def row_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    return layout.group_rows(blocks).select("doc_id", "page_index", "block_index", "row_index", "place")


def row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows won back by height alone, without ruling lines or dates."""
    page, blocks = printed_pages(spark, sf_dir)
    return _cells(layout.parse_rows(page.withColumn("template_id", F.lit("printed_v1")), blocks, templates(spark))[0])


def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of every candidate after a second reading that equals the printed text."""
    c = table(spark, sf_dir, "candidates")
    key = ["statement_id", "page_index", "row_index"]
    value = F.try_element_at("fields", F.lit("balance"))
    readings = c.where(value.isNotNull()).select(*key, F.lit("balance").alias("field_name"), value["raw_text"].alias("text"))
    return layout.apply_readings(c, readings, key).where(value.isNotNull()).select("candidate_id", value["secondary_text"].alias("secondary_text"), value["suggested_text"].alias("suggested_text"))


def hybrid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native boxes of the order lines merged with the read ones."""
    lines = line_blocks(spark, sf_dir)
    return pages.merge_layers(lines.where("source_type = 'native_pdf'"), lines.where("source_type = 'ocr'")).select("doc_id", "block_index", "source_type")


def cell_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = printed_pages(spark, sf_dir)
    df = layout.cell_regions(page.withColumn("template_id", F.lit("printed_v1")), templates(spark))
    return df.select("doc_id", "page_index", "row_index", "field_name", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


def topk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.ledger import validation_issues

    c = table(spark, sf_dir, "candidates")
    targets = layout.recovery_targets(validation_issues(c), c, ["statement_id", "page_index"])
    return targets.select("statement_id", "page_index", "row_index", "field_name", F.col("target_order").cast("bigint").alias("target_order"))


def field_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions around the source blocks of all recovery targets, over blocks laid out by their index."""
    from ledgerloom.operators.ledger import validation_issues

    c = table(spark, sf_dir, "candidates")
    page = ["statement_id", "page_index"]
    targets = layout.recovery_targets(validation_issues(c), c, page)
    index = c.select(*page, F.explode(F.flatten(F.transform(F.map_values("fields"), lambda v: v["source_block_indices"]))).alias("block_index")).where("block_index is not null").distinct()
    x = (F.col("block_index") % 10) * 50.0
    blocks = index.select(*page, "block_index", x.alias("x0"), (F.col("block_index") * 3.0).alias("y0"), (x + 40).alias("x1"), (F.col("block_index") * 3.0 + 2).alias("y1"))
    return layout.field_regions(targets, c, blocks, page)


def variant_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three readings of each candidate's amount: as printed, without its separators, with an O for a zero."""
    raw = F.try_element_at("fields", F.lit("transaction_amount"))["raw_text"]
    c = table(spark, sf_dir, "candidates").select(F.col("candidate_id").alias("region_id"), raw.alias("t"), F.coalesce(F.try_element_at("fields", F.lit("transaction_amount"))["confidence"], F.lit(0.0)).alias("p"))
    three = [("original", F.replace("t", F.lit("0"), F.lit("O")), 0), ("contrast", F.col("t"), 1), ("upscale", F.regexp_replace("t", "[,.]", ""), 2)]
    parts = [c.select("region_id", F.lit("transaction_amount").alias("field_name"), F.lit(k).alias("variant_ord"), F.lit(n).alias("variant"), t.alias("text"), (F.col("p") * (1 - 0.25 * k)).alias("confidence_sum")) for n, t, k in three]
    return layout.variant_scores(reduce(DataFrame.unionByName, parts)).select("region_id", "variant")


def ruling_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of each order's page from lines drawn by its order lines."""
    rows = table(spark, sf_dir, "lineitem")
    y = F.col("l_suppkey").cast("double")
    lines = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0.0).alias("x0"), y.alias("y0"), (F.col("l_quantity") * 5).alias("x1"), (y + (F.col("l_quantity") > 40).cast("int") * 10).alias("y1"), F.lit(2.0).alias("thickness"))
    return layout.ruling_boundaries(lines, 50.0).select("doc_id", F.array_join(F.transform("boundaries", lambda b: b.cast("int").cast("string")), ",").alias("boundaries"))


def header_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, blocks = printed_pages(spark, sf_dir)
    df = layout.header_suggestions(blocks.where("y0 < 20"))
    return df.select("doc_id", "page_index", F.array_join("suggestions", "|").alias("suggestions"))


def geometry_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_partkey") % 500).cast("double").alias("y"))
    m = geometry.compose(geometry.quarter_turn(600.0, 800.0, 90), [0.5, 0.0, 0.0, 0.5, 10.0, 20.0])
    px, py = geometry.to_pdf(F.col("x"), F.col("y"), m)
    bx, by = geometry.from_pdf(px, py, m)
    left, top, right, bottom = geometry.crop_bounds(px - 1.5, py - 1.5, px + 1.5, py + 1.5, 300, 200)
    return rows.select("l_orderkey", "l_linenumber", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.round(bx, 6).alias("bx"), F.round(by, 6).alias("by"), left, top, right, bottom, geometry.font_size(F.col("y"), F.col("y") + F.col("x")).alias("font"))


QUERIES = {
    f.__name__: f
    for f in (
        page_classify, repeated_pages, preflight, text_quality, block_dedup, block_dedup_exact, block_evidence, column_assign, band_assign, anchor_attach, cell_assembly, template_match, grid_parse,
        required_missing, anchor_parse, generic_layouts, page_parse, row_grouping, row_parse, second_readings, hybrid_blocks, cell_regions, topk_targets, field_regions, variant_choice, ruling_boundaries, header_suggestions, geometry_transform,
    )
}

_RANKED = """ranked AS (
  SELECT statement_id AS doc_id, page_index, row_index, candidate_id, fields, row_number() OVER (PARTITION BY statement_id, page_index ORDER BY row_index, candidate_id) AS place,
         count(*) OVER (PARTITION BY statement_id, page_index) AS n FROM candidates),
sizes AS (SELECT DISTINCT doc_id, page_index, n FROM ranked)"""
_VALUES = ", ".join(f"({k}, '{n}', {a}, {b}, '{h}')" for k, (n, a, b, h) in enumerate(COLUMNS))
_COLS = f"cols AS (SELECT * FROM (VALUES {_VALUES}) AS t(k, name, l, r, header))"
_TEXT_PAGES = """pg AS (
  SELECT coalesce(source, '') || '/' || (doc_id // 1000) AS doc, CAST(doc_id % 1000 AS INTEGER) AS page, doc_id AS page_id, length(trim(coalesce(text, ''))) AS chars,
         kind IN ('statement_page', 'process_log') AS image, text IS NULL AS broken, doc_id % 10 = 0 AS turned, sha256(coalesce(text, '')) AS print FROM documents),
kinds AS (SELECT *, CASE WHEN broken THEN 'page_error' WHEN chars > 0 AND image THEN 'hybrid' WHEN chars > 0 THEN 'native_text' WHEN image THEN 'scan_image' ELSE 'blank' END AS kind FROM pg),
groups AS (SELECT doc, print, list(page ORDER BY page) AS pages FROM pg GROUP BY ALL HAVING count(*) > 1)"""
_CELLS_OF = "SELECT doc_id, page_index, place, n, trim(fields['{0}'].raw_text, ' ' || chr(9) || chr(10) || chr(13)) AS t, '{0}' AS field_name FROM ranked"
_ALL_CELLS = "cells AS (" + " UNION ALL ".join(_CELLS_OF.format(n) for n, *_ in COLUMNS) + ")"
_BLOCKS = """blocks AS (
  SELECT doc_id, page_index, CAST(k AS INTEGER) AS block_index, k, 0 AS r, header AS text, l, r AS right_, 8 AS y FROM (SELECT * FROM sizes, cols) WHERE (n + k) % 4 <> 0
  UNION ALL SELECT doc_id, page_index, CAST(place * 10 + k AS INTEGER), k, place, fields[name].raw_text, l, r, 35 + 20 * (place - 1) FROM ranked, cols WHERE fields[name].raw_text IS NOT NULL)"""
_LINES = """lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_linenumber * 1000000 + l_partkey AS INTEGER) AS block_index, 'line' || (l_linenumber % 2) AS t, (l_partkey % 5) * 40.0 AS x0, (l_suppkey % 3) * 30.0 AS y0,
         (l_partkey % 5) * 40.0 + 30 + (l_quantity % 3) AS x1, (l_suppkey % 3) * 30.0 + 20 AS y1, CASE WHEN l_linestatus = 'O' THEN 'native_pdf' ELSE 'ocr' END AS source_type FROM lineitem)"""

from ledgerloom.plans import oracle  # noqa: E402


def _folded(lines: str) -> str:
    """Blocks left of each page: a fold over its equal texts, in order, of lists of one block each."""
    inter = "greatest(0, least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0)) * greatest(0, least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0))"
    whole = "(k.x1 - k.x0) * (k.y1 - k.y0) + (e[1].x1 - e[1].x0) * (e[1].y1 - e[1].y0)"
    at = f"coalesce(list_position(list_transform(a, lambda k: ({inter}) >= 0.75 * ({whole} - ({inter}))), true), 0)"
    return f"""folded AS (
  SELECT doc_id, list_reduce(list([struct_pack(block_index := block_index, source_type := source_type, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] ORDER BY block_index),
         lambda a, e: CASE WHEN {at} = 0 THEN list_concat(a, e) WHEN e[1].source_type = 'native_pdf' AND a[{at}].source_type <> 'native_pdf' THEN list_concat(list_concat(a[1:{at} - 1], e), a[{at} + 1:]) ELSE a END) AS left_
  FROM {lines} GROUP BY doc_id, t),
kept AS (SELECT doc_id, unnest(left_, recursive := true) FROM folded)"""

_TARGETS = """
, wide AS (
  SELECT i.*, f.name, f.k FROM (SELECT i.*, c.fields FROM issues i JOIN (SELECT DISTINCT ON (statement_id, page_index, row_index) * FROM candidates) c USING (statement_id, page_index, row_index)
                                WHERE code IN ('invalid_amount', 'invalid_balance', 'invalid_date', 'low_confidence', 'balance_mismatch')) i,
       LATERAL (SELECT unnest(CASE WHEN list_contains(map_keys(i.fields), coalesce(i.field_name, '')) THEN [i.field_name]
                                   WHEN code = 'invalid_balance' THEN list_filter(['balance', 'online_balance', 'closing_balance'], lambda n: list_contains(map_keys(i.fields), n))
                                   WHEN code = 'balance_mismatch' THEN list_filter(['transaction_amount', 'amount', 'income_amount', 'expense_amount', 'balance', 'online_balance'], lambda n: list_contains(map_keys(i.fields), n)) END) AS name,
                       0 AS k) f),
numbered AS (SELECT statement_id, page_index, row_index, name, min(struct_pack(r := row_index, e := emit_ord, k := k)) AS pos FROM wide GROUP BY ALL),
targets AS (SELECT statement_id, page_index, row_index, name AS field_name, o AS target_order FROM (SELECT *, row_number() OVER (PARTITION BY statement_id, page_index ORDER BY pos) AS o FROM numbered) WHERE o <= 24)"""

ORACLE = {
    "page_classify": f"WITH {_TEXT_PAGES} SELECT page_id, kind FROM kinds",
    "repeated_pages": f"WITH {_TEXT_PAGES} SELECT doc AS doc_id, print AS content_fingerprint, array_to_string(pages, ',') AS pages FROM groups",
    "preflight": f"""WITH {_TEXT_PAGES}, reps AS (SELECT doc, count(*) AS r FROM groups GROUP BY doc)
SELECT doc AS doc_id, CAST(count(*) AS INTEGER) AS page_count, CAST(count_if(kind = 'blank') AS INTEGER) AS blank_pages, CAST(count_if(turned) AS INTEGER) AS rotated_pages,
       CAST(count_if(kind = 'page_error') AS INTEGER) AS error_pages, CAST(coalesce(any_value(r), 0) AS INTEGER) AS repeated_pages,
       concat_ws(';', CASE WHEN any_value(r) > 0 THEN 'repeated pages' END, CASE WHEN count_if(kind = 'blank') > 0 THEN 'blank pages' END,
                 CASE WHEN count_if(kind = 'page_error') > 0 THEN 'unreadable pages' END, CASE WHEN count_if(turned) > 0 THEN 'rotated pages' END) AS warnings
FROM kinds LEFT JOIN reps USING (doc) GROUP BY doc""",
    "block_dedup": f"""WITH {_LINES}, pairs AS (
  SELECT o.doc_id, o.block_index, greatest(0, least(o.x1, n.x1) - greatest(o.x0, n.x0)) * greatest(0, least(o.y1, n.y1) - greatest(o.y0, n.y0)) AS i,
         (o.x1 - o.x0) * (o.y1 - o.y0) + (n.x1 - n.x0) * (n.y1 - n.y0) AS s
  FROM lines o JOIN lines n ON o.doc_id = n.doc_id AND o.t = n.t AND o.source_type = 'ocr' AND n.source_type = 'native_pdf')
SELECT doc_id, block_index, source_type FROM lines l WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE l.source_type = 'ocr' AND p.doc_id = l.doc_id AND p.block_index = l.block_index AND i / (s - i) >= 0.75)""",
    "block_dedup_exact": f"""WITH {_LINES}, {_folded("lines")} SELECT doc_id, block_index, source_type FROM kept""",
    "hybrid_blocks": f"""WITH {_LINES}, last AS (SELECT doc_id, max(block_index) + 1 AS n FROM lines WHERE source_type = 'native_pdf' GROUP BY 1),
merged AS (SELECT l.* REPLACE (CAST(CASE WHEN source_type = 'ocr' THEN block_index + coalesce(n, 0) ELSE block_index END AS INTEGER) AS block_index) FROM lines l LEFT JOIN last USING (doc_id)),
{_folded("merged")} SELECT doc_id, block_index, source_type FROM kept""",
    "column_assign": """SELECT l_orderkey, l_linenumber, CASE WHEN r < 0.3 THEN 'first' WHEN r < 0.5 THEN 'second' WHEN r < 0.9 THEN 'third' END AS field_name
FROM (SELECT *, (l_partkey % 1000) / 1000.0 AS r FROM lineitem)""",
    "band_assign": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity >= 5 AND l_quantity < 15 THEN 0 WHEN l_quantity >= 15 AND l_quantity < 30 THEN 1 WHEN l_quantity >= 30 AND l_quantity < 45 THEN 2 END AS INTEGER) AS band FROM lineitem",
    "anchor_attach": """WITH e AS (SELECT *, epoch_us(ts) / 6e7 AS m FROM events),
a AS (SELECT user_id, m AS top, CAST(row_number() OVER w - 1 AS INTEGER) AS row_index, coalesce(lead(m) OVER w - 5.0, 1e18) AS bottom FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY m, event_id))
SELECT event_id, row_index FROM e JOIN a USING (user_id) WHERE m >= top AND m < bottom""",
    "cell_assembly": """SELECT l_orderkey, l_returnflag AS field_name, string_agg('p' || l_partkey, ' ' ORDER BY l_linenumber * 1000000 + l_partkey) AS raw_text, round(min(l_quantity / 50), 6) AS confidence,
       string_agg(CAST(l_linenumber * 1000000 + l_partkey AS VARCHAR), ',' ORDER BY l_linenumber * 1000000 + l_partkey) AS indices, min(l_quantity) AS x0, max(l_quantity) AS x1 FROM lineitem GROUP BY 1, 2""",
    "block_evidence": f"""WITH {_RANKED}, {_COLS}, {_BLOCKS}
SELECT doc_id, page_index, block_index, concat_ws(',', CAST(round(l * 600 + 4) AS INTEGER), y, CAST(round(right_ * 600 - 4) AS INTEGER), y + 10) AS box, printf('%.4f', CAST((l + right_) / 2 AS DOUBLE)) AS center_ratio FROM blocks""",
    "row_grouping": f"""WITH {_RANKED}, {_COLS}, {_BLOCKS}
SELECT doc_id, page_index, block_index, CAST(dense_rank() OVER (PARTITION BY doc_id, page_index ORDER BY r) - 1 AS INTEGER) AS row_index, CAST(row_number() OVER (PARTITION BY doc_id, page_index, r ORDER BY k) - 1 AS INTEGER) AS place FROM blocks""",
    "generic_layouts": f"""WITH {_RANKED}
SELECT doc_id, page_index, CASE WHEN n % 4 = 1 THEN 'accounting_date:0.0,transaction_amount:0.15,balance:0.3,counterparty_name:0.6125' END AS columns, n % 4 = 1 AS inferred FROM sizes""",
    "page_parse": f"""WITH {_RANKED}, {_ALL_CELLS},
flat AS (SELECT doc_id, page_index, n, place, max(CASE WHEN field_name = 'transaction_date' THEN t END) AS d, max(CASE WHEN field_name = 'transaction_amount' THEN t END) AS m,
                bool_or(t <> '' AND field_name IN ('balance', 'description')) AS rest, bool_or(t <> '') AS inked FROM cells GROUP BY ALL),
grid AS (SELECT doc_id, page_index, bool_and(coalesce(d, '') <> '' AND coalesce(m, '') <> '') AS ok, count(*) AS c FROM flat WHERE n % 2 = 0 AND inked GROUP BY ALL),
owned AS (SELECT *, sum(CASE WHEN {oracle.date("d")} IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_index ORDER BY place) AS anchor FROM flat WHERE n % 4 = 1),
anchored AS (SELECT doc_id, page_index, anchor, coalesce(bool_or(rest), false) AS ok FROM owned WHERE anchor > 0 GROUP BY ALL),
found AS (SELECT doc_id, page_index, bool_and(ok) AS ok, count(*) AS c FROM anchored GROUP BY ALL)
SELECT doc_id, page_index, CASE WHEN n % 4 = 3 THEN 'page_review' WHEN coalesce(g.ok, f.ok, false) THEN 'success' ELSE 'failed' END AS status, CAST(CASE WHEN coalesce(g.ok, f.ok, false) THEN coalesce(g.c, f.c) ELSE 0 END AS INTEGER) AS candidates
FROM sizes LEFT JOIN grid g USING (doc_id, page_index) LEFT JOIN found f USING (doc_id, page_index)""",
    "text_quality": r"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, length(text) AS n FROM documents), m AS (
  SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL THEN 'empty_text_layer' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]') THEN 'invalid_characters' END,
         CASE WHEN n % 700 > 600 OR n % 700 = 0 THEN 'bbox_out_of_bounds' END, CASE WHEN n % 300 + 1 > 200 THEN 'bbox_height_anomaly' END,
         CASE WHEN text IS NULL OR length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]', '', 'g')) < 4 THEN 'text_layer_too_sparse' END) AS reasons FROM d)
SELECT doc_id, reasons = '' AS accepted, reasons FROM m""",
    "variant_choice": rf"""WITH c AS (SELECT candidate_id AS region_id, fields['transaction_amount'].raw_text AS t, coalesce(fields['transaction_amount'].confidence, 0) AS p FROM candidates),
three AS (SELECT region_id, 0 AS k, 'original' AS variant, replace(t, '0', 'O') AS x, p FROM c UNION ALL SELECT region_id, 1, 'contrast', t, p * 0.75 FROM c UNION ALL SELECT region_id, 2, 'upscale', regexp_replace(t, '[,.]', '', 'g'), p * 0.5 FROM c),
scored AS (SELECT *, p + CASE WHEN {oracle.amount("x")} IS NOT NULL THEN 10 WHEN regexp_matches(x, '\d') THEN 0.25 ELSE 0 END AS score FROM three)
SELECT region_id, variant FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY score DESC, k) AS place FROM scored) WHERE place = 1""",
    "template_match": f"""WITH {_RANKED}, {_COLS}, heads AS (SELECT doc_id, page_index, count(*) AS hits, bool_or(name = 'transaction_amount') AS amount FROM sizes, cols WHERE (n + k) % 4 <> 0 GROUP BY ALL)
SELECT doc_id, page_index, 'printed_v1' AS template_id, round(hits / 5.0, 6) AS score FROM heads WHERE hits * 10 >= 5 * 6""",
    "grid_parse": f"WITH {_RANKED}, {_ALL_CELLS} SELECT doc_id, page_index, CAST(place AS INTEGER) AS row_index, field_name, t AS raw_text FROM cells WHERE t <> ''",
    "row_parse": f"WITH {_RANKED}, {_ALL_CELLS} SELECT doc_id, page_index, CAST(place AS INTEGER) AS row_index, field_name, t AS raw_text FROM cells WHERE t <> ''",
    "second_readings": f"""SELECT candidate_id, CASE WHEN trim(raw) <> '' THEN raw ELSE old2 END AS secondary_text, CASE WHEN trim(raw) <> '' THEN coalesce(CAST({oracle.amount("raw")} AS VARCHAR), old) ELSE old END AS suggested_text
FROM (SELECT candidate_id, fields['balance'].raw_text AS raw, fields['balance'].suggested_text AS old, fields['balance'].secondary_text AS old2 FROM candidates WHERE fields['balance'] IS NOT NULL)""",
    "required_missing": f"""WITH {_RANKED}, {_ALL_CELLS}, want AS (SELECT doc_id, page_index, place, count_if(t <> '' AND field_name IN ('balance', 'counterparty_name')) AS got, count_if(t <> '') AS some FROM cells GROUP BY ALL)
SELECT doc_id, page_index, CASE WHEN min(got) = 2 THEN 'success' ELSE 'failed' END AS status, CAST(CASE WHEN min(got) = 2 THEN count(*) ELSE 0 END AS INTEGER) AS candidates FROM want GROUP BY ALL""",
    "anchor_parse": f"""WITH {_RANKED}, {_ALL_CELLS}, rows_ AS (SELECT doc_id, page_index, place, {oracle.date("t")} IS NOT NULL AS dated FROM cells WHERE field_name = 'transaction_date'),
owned AS (SELECT *, sum(dated::INT) OVER (PARTITION BY doc_id, page_index ORDER BY place) - 1 AS row_index FROM rows_)
SELECT doc_id, page_index, CAST(row_index AS INTEGER) AS row_index, field_name, string_agg(t, ' ' ORDER BY place) AS raw_text
FROM cells JOIN owned USING (doc_id, page_index, place) WHERE row_index >= 0 AND t <> '' GROUP BY ALL""",
    "cell_regions": f"""WITH {_RANKED}, {_COLS}
SELECT doc_id, page_index, CAST(band AS INTEGER) AS row_index, name AS field_name, round(l * 600 + 1.5, 4)::DOUBLE AS x0, round(30 + 20 * (band - 1) + 1.5, 4)::DOUBLE AS y0,
       round(r * 600 - 1.5, 4)::DOUBLE AS x1, round(30 + 20 * band - 1.5, 4)::DOUBLE AS y1
FROM (SELECT doc_id, page_index, unnest(range(1, n + 1)) AS band FROM sizes), cols""",
    "topk_targets": oracle.ledger(f"""{_TARGETS}
SELECT * FROM targets"""),
    "field_regions": oracle.ledger(f"""{_TARGETS}
SELECT t.statement_id, t.page_index, t.row_index, t.field_name, min((i % 10) * 50.0 - 2)::DOUBLE AS x0, min(i * 3.0 - 2)::DOUBLE AS y0, max((i % 10) * 50.0 + 42)::DOUBLE AS x1, max(i * 3.0 + 4)::DOUBLE AS y1
FROM targets t JOIN (SELECT statement_id, page_index, row_index, e.key AS field_name, unnest(e.value.source_block_indices) AS i FROM (SELECT *, unnest(map_entries(fields)) AS e FROM candidates)) b
  ON t.statement_id = b.statement_id AND t.page_index = b.page_index AND t.row_index = b.row_index AND t.field_name = b.field_name WHERE i IS NOT NULL GROUP BY ALL"""),
    "ruling_boundaries": """WITH g AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS y FROM lineitem WHERE l_quantity * 5 >= 50 AND l_quantity <= 40)
SELECT doc_id, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS boundaries FROM g GROUP BY 1""",
    "header_suggestions": f"""WITH {_RANKED}, {_COLS} SELECT doc_id, page_index, string_agg(header, '|' ORDER BY k) AS suggestions FROM sizes, cols WHERE (n + k) % 4 <> 0 GROUP BY ALL""",
    "geometry_transform": """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, CAST(l_partkey % 500 AS DOUBLE) AS y FROM lineitem), t AS (SELECT *, (800 - y) * 0.5 + 10 AS px, x * 0.5 + 20 AS py FROM p)
SELECT l_orderkey, l_linenumber, round(px, 6) AS px, round(py, 6) AS py, round(x, 6) AS bx, round(y, 6) AS by,
       CAST(l AS INTEGER) AS left, CAST(u AS INTEGER) AS top, CAST(greatest(l + 1, least(300, ceil(px + 1.5))) AS INTEGER) AS right, CAST(greatest(u + 1, least(200, ceil(py + 1.5))) AS INTEGER) AS bottom, greatest(3.0, least(x / 2, 12.0)) AS font FROM (SELECT *, greatest(0, least(299, floor(px - 1.5))) AS l, greatest(0, least(199, floor(py - 1.5))) AS u FROM t)""",
}
