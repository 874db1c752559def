"""Queries of single functions and small operators, over whole tables of plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import geometry, ids, nested, text
from ledgerloom.operators import evaluate, layout, ledger, pages, review, runs
from ledgerloom.plans import layout_queries, oracle
from ledgerloom.session import table
from ledgerloom.sources import assets

KEY = ["statement_id", "page_index", "row_index"]


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name and the font for the description of every candidate."""
    raw = F.try_element_at("fields", F.lit("description"))["raw_text"]
    c = table(spark, sf_dir, "candidates").select("candidate_id", F.coalesce(F.concat(raw, F.lit("/?."), F.col("parser_id")), F.lit(" . ")).alias("t"))
    return c.select("candidate_id", text.safe_name("t").alias("name"), text.needs_wide_font("t").alias("wide"))


def header_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as headers are compared (F3) and as tokens are (F2)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" - ", "p_name", "p_brand", "p_type").alias("t"))
    return p.select("p_partkey", text.normalize_header("t").alias("header"), text.normalize_token("t").alias("token"))


def reading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every order's boxes from top to bottom (F8)."""
    return pages.reading_text(layout_queries.line_blocks(spark, sf_dir), ["doc_id"])


def column_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column lists written as text, every seventh broken."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size"))
    spec = F.concat(F.lit(" a:0:0."), F.col("p_size").cast("string"), F.lit(", b:0."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(":1"))
    made = p.select("p_partkey", layout.column_spec(spec).alias("c"))
    return made.select("p_partkey", F.size("c").alias("columns"), F.get("c", F.lit(1))["name"].alias("second"), F.get("c", F.lit(1))["left_ratio"].alias("starts")).where("columns > 0 or columns is null or columns = -1")


def polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of leaning quadrangles, a page and block id for each (A1, F32)."""
    x, y, lean = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 90).cast("double"), F.col("l_quantity")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(layout_queries.LINE).alias("line"), geometry.box_of(F.array(point(x + lean, y), point(x + 60, y + 3), point(x + 50, y + 20), point(x, y + 18))).alias("b"))
    return rows.select("l_orderkey", "line", "b.x0", "b.y0", "b.x1", "b.y1", ids.block_id(F.lit(7), F.lit("ocr"), F.lit("t"), F.col("b")).alias("block_id"))


def skew_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of every order's page from lines that rise by the quantity."""
    rows = table(spark, sf_dir, "lineitem")
    lines = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(400.0).alias("x1"), (F.col("l_quantity") - 20).alias("y1"))
    return layout.skew_angle(lines).select("doc_id", F.round("angle", 6).alias("angle"))


def moved_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of every record if a person moved each fifth row to another one."""
    c = table(spark, sf_dir, "candidates")
    over = c.where("row_index % 5 = 0").select(*KEY, F.concat(F.lit("explicit:"), "statement_id").alias("logical_key"))
    return ledger.transaction_records(c, over).select("candidate_id", "statement_stream_id")


def outcome_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports where the parser gave every fourth page up and could not read every fifth."""
    c = table(spark, sf_dir, "candidates")
    page = c.select("statement_id", "page_index").distinct()
    outcomes = page.select("*", F.when(F.col("page_index") % 4 == 3, "failed").alias("parser_status"), F.when(F.col("page_index") % 5 == 4, "torn").alias("page_error"))
    df = ledger.page_reports(c, ledger.validation_issues(c), outcomes)
    return df.select("statement_id", "page_index", "status", "risk_score", F.array_join("reasons", ",").alias("reasons"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that repeat a row's key (V1), every fortieth being stored once more under a new id."""
    c = table(spark, sf_dir, "candidates")
    again = c.where("candidate_id % 40 = 0").withColumn("candidate_id", F.col("candidate_id") + 1_000_000_000)
    return ledger.validation_issues(c.unionByName(again)).where("code = 'duplicate_row'").select("candidate_id", "severity")


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every text page after processing (P17), the parser's and the report's verdict from its id."""
    t = pages.classify_pages(layout_queries.text_pages(spark, sf_dir))
    parser = F.when(F.col("source_doc") % 6 == 1, "failed").when(F.col("source_doc") % 6 == 2, "page_review")
    report = F.when(F.col("source_doc") % 4 == 1, "review").when(F.col("source_doc") % 4 == 2, "pass")
    return t.select(F.col("source_doc").alias("page_id"), runs.page_state(F.col("kind"), parser, report).alias("state"))


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way every second page of a document is read."""
    t = pages.select_pages(layout_queries.text_pages(spark, sf_dir), [*range(0, 1000, 2)])
    return pages.routed_pages(t).select(F.col("source_doc").alias("page_id"), "route")


def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields typed by a person for every part (F46), every ninth without a value."""
    p = table(spark, sf_dir, "part")
    typed = F.concat(F.lit("name= "), "p_name", F.lit("; size="), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_size").cast("string")))
    return p.select("p_partkey", review.manual_fields(typed).alias("m")).select("p_partkey", F.try_element_at("m", F.lit("name")).alias("name"), F.try_element_at("m", F.lit("size")).alias("size"))


def source_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block indices of two fields as one list (F45, U7), and the digest of a page of them."""
    indices = lambda n: F.try_element_at("fields", F.lit(n))["source_block_indices"]
    both = nested.ordered_distinct(indices("balance"), indices("transaction_amount"))
    df = table(spark, sf_dir, "candidates").select("candidate_id", F.array_join(F.transform(both, lambda i: i.cast("string")), ",").alias("indices"))
    return df.select("candidate_id", "indices", ids.content_fingerprint(F.col("indices"), F.array(F.lit("img"))).alias("fingerprint"))


def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every order line as stored text."""
    x = (F.col("l_partkey") % 5).cast("double")
    point = F.struct(x.alias("x"), F.col("l_quantity").alias("y"))
    span = F.struct(F.lit(0).alias("page_index"), F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("text_block_id"), F.array(point, point).alias("polygon"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(layout_queries.LINE).alias("line"), nested.spans_json(F.when(F.col("l_linestatus") == "O", F.array(span)).otherwise(F.array().cast("array<struct<page_index:int,text_block_id:string,polygon:array<struct<x:double,y:double>>>>"))).alias("spans"))


def template_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of layouts with two columns made from the nations' keys."""
    n = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey") / 25.0, F.col("n_regionkey") / 5.0
    column = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("left_ratio"), b.alias("right_ratio"))
    return assets.template_faults(n.select(F.col("n_name").alias("template_id"), F.array(column("a", F.lit(0.0), k), column("b", r, F.lit(1.0))).alias("columns")))


def name_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character accuracy of part names that were read with c for e (A17, F9, J13, U9), every hundredth not at all."""
    p = table(spark, sf_dir, "part")
    read = p.where("p_partkey % 100 <> 0").select("p_partkey", F.replace("p_name", F.lit("e"), F.lit("c")).alias("text"))
    df = evaluate.character_accuracy(read, p.select("p_partkey", F.col("p_name").alias("text")), ["p_partkey"])
    return df.withColumn("character_accuracy", F.round("character_accuracy", 6))


def added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every page after a person added one under the first row's key and one under a free key."""
    c = table(spark, sf_dir, "candidates")
    first = c.groupBy("statement_id", "page_index").agg(F.min_by("row_index", "row_index").alias("row_index"))
    taken = c.join(first, KEY, "left_semi").withColumn("candidate_id", F.col("candidate_id") + 1_000_000_000)
    free = taken.withColumn("row_index", F.lit(500_000)).withColumn("candidate_id", F.col("candidate_id") + 1_000_000_000)
    df = review.add_rows(c, taken.unionByName(free))
    return df.select("candidate_id", "row_index", F.col("review_order").cast("bigint").alias("review_order"))


QUERIES = {
    f.__name__: f
    for f in (
        file_names, header_forms, reading_texts, column_specs, polygon_boxes, skew_angles, moved_streams, outcome_reports, repeated_keys, page_states, page_routes, typed_fields, source_lists, span_texts, template_checks,
        name_accuracy, added_rows,
    )
}

_LINE_NO = "CAST(l_linenumber * 1000000 + l_partkey AS INTEGER)"
ORACLE = {
    "file_names": r"""WITH t AS (SELECT candidate_id, coalesce(fields['description'].raw_text || '/?.' || parser_id, ' . ') AS t FROM candidates)
SELECT candidate_id, coalesce(nullif(regexp_replace(regexp_replace(t, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'results') AS name, regexp_matches(t, '[^\x00-\x{ff}]') AS wide FROM t""",
    "header_forms": """WITH t AS (SELECT p_partkey, lower(concat_ws(' - ', p_name, p_brand, p_type)) AS t FROM part) SELECT p_partkey, regexp_replace(t, '[^0-9a-z]', '', 'g') AS header, regexp_replace(t, '[^0-9a-z]', '', 'g') AS token FROM t""",
    "reading_texts": f"WITH {layout_queries._LINES} SELECT doc_id, string_agg('Line ' || right(t, 1), ' ' ORDER BY y0, x0, block_index) AS text FROM lines GROUP BY 1",
    "column_specs": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN 2 WHEN true THEN NULL END AS columns, CASE WHEN p_partkey % 7 <> 0 THEN 'b' END AS second, CASE WHEN p_partkey % 7 <> 0 THEN CAST('0.' || p_size AS DOUBLE) END AS starts FROM part",
    "polygon_boxes": f"""WITH p AS (SELECT l_orderkey, {_LINE_NO} AS line, (l_partkey % 500)::DOUBLE AS x, (l_suppkey % 90)::DOUBLE AS y, l_quantity AS q FROM lineitem), b AS (SELECT l_orderkey, line, x AS x0, y AS y0, x + greatest(60, q) AS x1, y + 20 AS y1 FROM p)
SELECT *, 'p0007:ocr:' || substr(sha256('{{"page":7,"source":"ocr","text":"t","box":{{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}}}}'), 1, 20) AS block_id FROM b""",
    "skew_angles": """WITH a AS (SELECT l_orderkey AS doc_id, degrees(atan2(l_quantity - 20, 400.0)) AS a FROM lineitem), m AS (SELECT doc_id, median(a) AS a FROM a WHERE abs(a) <= 5 GROUP BY 1) SELECT doc_id, round(CASE WHEN abs(a) >= 0.2 THEN a ELSE 0 END, 6) AS angle FROM m""",
    "moved_streams": oracle.ledger("SELECT candidate_id, CASE WHEN row_index % 5 = 0 THEN 'stream-' || substr(sha256('explicit:' || statement_id), 1, 16) ELSE statement_stream_id END AS statement_stream_id FROM records"),
    "outcome_reports": oracle.ledger("""SELECT statement_id, page_index, CASE WHEN page_index % 4 = 3 OR page_index % 5 = 4 THEN 'page_review' ELSE status END AS status, CAST(CASE WHEN page_index % 4 = 3 OR page_index % 5 = 4 THEN 100 ELSE risk_score END AS INTEGER) AS risk_score,
       CASE WHEN page_index % 4 = 3 OR page_index % 5 = 4 THEN concat_ws(',', CASE WHEN page_index % 5 = 4 THEN 'page_error' END, CASE WHEN page_index % 4 = 3 THEN 'parser:failed' END) ELSE reasons END AS reasons FROM reports"""),
    "repeated_keys": "SELECT candidate_id + 1000000000 AS candidate_id, 'critical' AS severity FROM candidates WHERE candidate_id % 40 = 0",
    "page_states": f"""WITH {layout_queries._TEXT_PAGES} SELECT page_id, CASE WHEN kind = 'page_error' THEN 'failed' WHEN page_id % 6 IN (1, 2) OR page_id % 4 = 1 THEN 'needs_review' ELSE 'completed' END AS state FROM kinds""",
    "page_routes": f"""WITH {layout_queries._TEXT_PAGES} SELECT page_id, CASE WHEN kind = 'native_text' THEN 'native' WHEN kind IN ('scan_image', 'hybrid') THEN 'image' ELSE 'none' END AS route FROM kinds WHERE page % 2 = 0""",
    "typed_fields": "SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN trim(p_name) END AS name, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part",
    "source_lists": """WITH l AS (SELECT candidate_id, list_concat(coalesce(fields['balance'].source_block_indices, []), coalesce(fields['transaction_amount'].source_block_indices, [])) AS l FROM candidates),
d AS (SELECT candidate_id, coalesce(array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: x::VARCHAR), ','), '') AS indices FROM l)
SELECT candidate_id, indices, sha256('{"text":"' || indices || '","images":["img"]}') AS fingerprint FROM d""",
    "span_texts": f"""SELECT l_orderkey, {_LINE_NO} AS line, CASE WHEN l_linestatus = 'O' THEN '[{{"page_index":0,"text_block_id":"b' || l_suppkey || '","polygon":[[' || (l_partkey % 5)::DOUBLE || ',' || l_quantity || '],[' || (l_partkey % 5)::DOUBLE || ',' || l_quantity || ']]}}]' END AS spans FROM lineitem""",
    "template_checks": """WITH c AS (SELECT n_name AS template_id, n_nationkey / 25.0 AS k, n_regionkey / 5.0 AS r FROM nation) SELECT template_id, CASE WHEN k <= 0 THEN 'bad_range' ELSE 'overlap' END AS fault FROM c WHERE k <= 0 OR CASE WHEN r = 0 THEN 1 > 0 AND (k > r OR 1 > 0) ELSE k > r END""",
    "name_accuracy": """WITH p AS (SELECT p_name AS t, CASE WHEN p_partkey % 100 <> 0 THEN replace(p_name, 'e', 'c') ELSE '' END AS r, p_partkey % 100 = 0 AS lone FROM part)
SELECT count(*) AS pages, count_if(t = r) AS exact_pages, count_if(lone) AS unmatched_pages, round(greatest(0, 1 - sum(levenshtein(t, r)) / sum(length(t))), 6) AS character_accuracy FROM p""",
    "added_rows": """WITH g AS (SELECT *, min(row_index) OVER w AS first, max(row_index) OVER w AS last, count(*) OVER w AS n, row_number() OVER (PARTITION BY statement_id, page_index ORDER BY coalesce(review_order, row_index), row_index, candidate_id) - 1 AS o FROM candidates WINDOW w AS (PARTITION BY statement_id, page_index))
SELECT candidate_id, row_index, o AS review_order FROM g UNION ALL SELECT candidate_id + 1000000000, CAST(last + 1 AS INTEGER), n FROM g WHERE row_index = first UNION ALL SELECT candidate_id + 2000000000, 500000, n + 1 FROM g WHERE row_index = first""",
}
