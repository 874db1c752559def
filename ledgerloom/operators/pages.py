"""Page classification, document preflight, text-layer quality and duplicate blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.geometry import iou
from ledgerloom.functions.text import nfkc, no_space, normalize_block, present

PAGE = ["doc_id", "page_index"]


def page_kind() -> Column:
    """Kind of a page from its signals (P1): error first, then text with images, text, images, nothing."""
    text, image = F.col("native_text_chars") > 0, F.col("image_count") > 0
    return (
        F.when(present(F.col("error")).isNotNull(), "page_error").when(text & image, "hybrid").when(text, "native_text").when(image, "scan_image").otherwise("blank")
    )


def classify_pages(pages: DataFrame) -> DataFrame:
    """pages with kind; null counts are as 0."""
    return pages.fillna(0, ["native_text_chars", "image_count"]).withColumn("kind", page_kind())


def select_pages(pages: DataFrame, indexes: list[int]) -> DataFrame:
    """The pages of some indexes of every document."""
    return pages.where(F.col("page_index").isin(indexes))


def routed_pages(pages: DataFrame) -> DataFrame:
    """pages with kind and the route they are read by (P3): native for text, image for scans and both together, none for blank and unreadable ones."""
    rows = classify_pages(pages)
    route = F.when(F.col("kind") == "native_text", "native").when(F.col("kind").isin("scan_image", "hybrid"), "image").otherwise("none")
    return rows.withColumn("route", route)


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Groups of pages of one document with equal content: doc_id, content_fingerprint, pages (A5). Null and empty fingerprints group nothing; rotation and size do not matter (Q11)."""
    known = pages.where(F.col("content_fingerprint") != "")
    return known.groupBy("doc_id", "content_fingerprint").agg(F.array_sort(F.collect_list("page_index")).alias("pages")).where(F.size("pages") > 1)


def preflight(pages: DataFrame) -> DataFrame:
    """One row per document: page_count, lists of blank, rotated and unreadable pages, repeated groups, warnings."""
    rows = classify_pages(pages)
    turned = F.coalesce(F.pmod("rotation", F.lit(360)) != 0, F.lit(False))
    collect = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("page_index"))))
    per_doc = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        collect(F.col("kind") == "blank").alias("blank_pages"),
        collect(turned).alias("rotated_pages"),
        collect(F.col("kind") == "page_error").alias("error_pages"),
    )
    repeated = repeated_pages(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list("pages")).alias("repeated_pages"))
    df = per_doc.join(repeated, "doc_id", "left").withColumn("repeated_pages", F.coalesce("repeated_pages", F.array().cast("array<array<int>>")))
    warn = lambda column, text: F.when(F.size(column) > 0, F.lit(text))
    return df.withColumn(
        "warnings",
        F.array_compact(F.array(
            warn("repeated_pages", "repeated pages"), warn("blank_pages", "blank pages"), warn("error_pages", "unreadable pages"), warn("rotated_pages", "rotated pages"),
        )),
    )


def text_quality(pages: DataFrame, blocks: DataFrame, min_chars: int = 4, tolerance: float = 0.0, max_height_ratio: float = 0.25) -> DataFrame:
    """Verdict on each page's text layer (P4): doc_id, page_index, accepted, reasons (distinct, in order of first occurrence).

    Reasons: empty_text_layer, invalid_characters (control or replacement characters), bbox_out_of_bounds,
    bbox_height_anomaly, text_layer_too_sparse. A page without blocks is empty and too sparse.
    """
    text = nfkc(F.coalesce("text", F.lit("")))
    on = blocks.join(pages.select(*PAGE, "page_width", "page_height"), PAGE)
    outside = (
        (F.col("x0") < -tolerance) | (F.col("y0") < -tolerance) | (F.col("x1") > F.col("page_width") + tolerance) | (F.col("y1") > F.col("page_height") + tolerance)
        | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    )
    marks = F.array(
        F.when(text.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffd]"), 1), F.when(outside, 2), F.when(F.col("y1") - F.col("y0") > F.col("page_height") * max_height_ratio, 3)
    )
    first = lambda k: F.min(F.when(F.array_contains("marks", k), F.struct("block_index", F.lit(k).alias("k"))))
    seen = on.select(*PAGE, "block_index", F.array_compact(marks).alias("marks"), F.length(no_space(text)).alias("ink")).groupBy(*PAGE).agg(
        F.sum("ink").alias("ink"), first(1).alias("a"), first(2).alias("b"), first(3).alias("c")
    )
    df = pages.select(*PAGE).join(seen, PAGE, "left")
    names = F.create_map(F.lit(1), F.lit("invalid_characters"), F.lit(2), F.lit("bbox_out_of_bounds"), F.lit(3), F.lit("bbox_height_anomaly"))
    found = F.transform(F.array_sort(F.array_compact(F.array("a", "b", "c"))), lambda s: F.element_at(names, s["k"]))
    head = F.when(F.col("ink").isNull(), F.array(F.lit("empty_text_layer"))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.coalesce("ink", F.lit(0)) < min_chars, F.array(F.lit("text_layer_too_sparse"))).otherwise(F.array().cast("array<string>"))
    df = df.select(*PAGE, F.concat(head, F.coalesce(found, F.array().cast("array<string>")), tail).alias("reasons"))
    return df.select(*PAGE, (F.size("reasons") == 0).alias("accepted"), "reasons")


def is_native(source: Column) -> Column:
    return source.isin("native_pdf", "native_text")


def drop_ocr_copies(blocks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Blocks without the OCR ones that repeat a native block: same page, same text apart from form, case and white space, and boxes overlapping by threshold (J7, pairwise form).

    An equi-join on page and text, with the boxes compared only for equal texts.
    """
    keyed = blocks.withColumn("_k", normalize_block("text"))
    native, ocr = keyed.where(is_native(F.col("source_type"))), keyed.where(~F.coalesce(is_native(F.col("source_type")), F.lit(False)))
    same = (F.col("o.doc_id") == F.col("n.doc_id")) & (F.col("o.page_index") == F.col("n.page_index")) & (F.col("o._k") == F.col("n._k")) & (iou("o", "n") >= threshold)
    kept = ocr.alias("o").join(native.alias("n"), same, "left_anti")
    return native.unionByName(kept).drop("_k")


def deduplicate_blocks(blocks: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Blocks of each page without repeats, in order: the first match among the blocks kept so far decides, and a native block takes an OCR block's place (J7, exact form).

    The outcome depends on order and overlap is not transitive, so each page is folded on its own; only
    blocks of equal text meet. Pages are gathered in the JVM and only keys and boxes go through Python.
    """

    @F.pandas_udf("array<int>")
    def kept(keys: pd.Series, natives: pd.Series, boxes: pd.Series) -> pd.Series:
        def one(texts, native, flat) -> list[int]:
            box = np.asarray(flat, float).reshape(-1, 4)
            slots: dict[str, list[int]] = {}
            place: list[int] = []
            for i, text in enumerate(texts):
                for slot in slots.setdefault(text, []):
                    j = place[slot]
                    w = max(0.0, min(box[i, 2], box[j, 2]) - max(box[i, 0], box[j, 0]))
                    h = max(0.0, min(box[i, 3], box[j, 3]) - max(box[i, 1], box[j, 1]))
                    whole = sum(max(0.0, box[k, 2] - box[k, 0]) * max(0.0, box[k, 3] - box[k, 1]) for k in (i, j)) - w * h
                    if whole > 0 and w * h / whole >= threshold:
                        if native[i] and not native[j]:
                            place[slot] = i
                        break
                else:
                    slots[text].append(len(place))
                    place.append(i)
            return place

        return pd.Series([one(*x) for x in zip(keys, natives, boxes)])

    rest = [c for c in blocks.columns if c not in PAGE]
    keyed = blocks.withColumn("_k", normalize_block(F.coalesce("text", F.lit(""))))
    part = F.struct("block_index", F.col("_k").alias("k"), F.coalesce(is_native(F.col("source_type")), F.lit(False)).alias("native"), F.struct(*rest).alias("block"))
    page = keyed.groupBy(*PAGE).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    box = F.flatten(F.transform("parts", lambda p: F.array(*[p["block"][c] for c in ("x0", "y0", "x1", "y1")])))
    page = page.withColumn("kept", kept(F.transform("parts", lambda p: p["k"]), F.transform("parts", lambda p: p["native"]), box))
    found = F.transform("kept", lambda k: F.get("parts", k)["block"])
    return page.select(*PAGE, F.inline(found)).select(*blocks.columns)


def merge_layers(native: DataFrame, ocr: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Blocks of a page's text layer and of its reading, as one list without repeats.

    Read blocks are numbered after the native ones of their page, and native evidence wins.
    """
    last = native.groupBy(*PAGE).agg((F.max("block_index") + 1).alias("_n"))
    after = ocr.join(last, PAGE, "left").withColumn("block_index", (F.col("block_index") + F.coalesce("_n", F.lit(0))).cast("int")).select(*native.columns)
    return deduplicate_blocks(native.unionByName(after), threshold)


def reading_text(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Text of each group of blocks from top to bottom, then left to right (F8): the by columns and text."""
    word = F.trim(F.coalesce("text", F.lit("")))
    parts = F.array_sort(F.collect_list(F.when(word != "", F.struct("y0", "x0", "block_index", word.alias("t")))))
    return blocks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def block_evidence(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks as shown for mapping columns (P26): index, text, box text, ratio of the centre to the page width."""
    from ledgerloom.functions.geometry import box_text

    on = blocks.join(pages.select(*PAGE, "page_width"), PAGE)
    ratio = F.format_string("%.4f", (F.col("x0") + F.col("x1")) / 2 / F.col("page_width"))
    return on.select(*PAGE, "block_index", "text", box_text(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"), ratio.alias("center_ratio"))
