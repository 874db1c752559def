"""Schemas and enumerations of the statement pipeline.

A candidate row is (statement_id, page_index, row_index) with candidate_id as its order of ingestion and a
map of fields; a block is one piece of text with geometry on a page, block_index being its input order.
"""

from __future__ import annotations

FIELD = "struct<raw_text:string,suggested_text:string,final_text:string,secondary_text:string,confidence:double,source_block_indices:array<int>>"
CANDIDATES = (
    "candidate_id bigint, statement_id string, page_index int, row_index int, parser_id string, "
    f"fields map<string,{FIELD}>, status string, duplicate_of struct<page_index:int,row_index:int>, review_order int"
)
PAGES = "doc_id string, page_index int, native_text_chars int, image_count int, error string, page_width double, page_height double, rotation int, content_fingerprint string"
BLOCKS = (
    "doc_id string, page_index int, block_index int, text string, x0 double, y0 double, x1 double, y1 double, "
    "confidence double, source_type string"
)
TEMPLATES = (
    "template_id string, version string, template_ord int, header_tokens array<string>, "
    "columns array<struct<name:string,left_ratio:double,right_ratio:double>>, required_fields array<string>, row_strategy string, header_y_ratio double"
)
TRUTH = "sample_id string, transactions array<struct<page_index:int,row_index:int,fields:map<string,string>>>"

# States and kinds as they stand in stored data.
PAGE_KINDS = ("page_error", "hybrid", "native_text", "scan_image", "blank")
CANDIDATE_STATUSES = ("unreviewed", "accepted", "rejected", "duplicate")
RULE_STATES = ("fail", "indeterminate", "pass", "not_applicable")
REPORT_STATUSES = ("pass", "pass_with_normalization", "review", "page_review")
PAGE_STATES = ("pending", "running", "completed", "needs_review", "failed")
NATIVE_SOURCES = ("native_pdf", "native_text")
