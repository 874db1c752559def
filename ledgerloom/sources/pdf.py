"""Optional edge: page signals and text blocks from PDF files, where PyMuPDF is installed.

Decoding is opaque per file; it runs in Arrow batches over binaryFile rows, and everything after it is
DataFrame work. Without PyMuPDF these functions raise ImportError when called; nothing else imports them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom import schemas


def page_signals(files: DataFrame) -> DataFrame:
    """Signals of each page of binaryFile rows (S1, S2, S4); a page that cannot be read is an error row, a file likewise as page 0."""
    import pymupdf  # noqa: F401

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pages = list(pymupdf.open(stream=content, filetype="pdf"))
                except Exception as e:
                    rows.append((path, 0, 0, 0, f"{type(e).__name__}: {e}", None, None, 0, None))
                    continue
                for k, page in enumerate(pages):
                    try:
                        text, images = page.get_text(), [list(map(str, i[:9])) for i in page.get_images(full=True)]
                        print_ = hashlib.sha256(json.dumps({"images": images, "text": text}, sort_keys=True).encode()).hexdigest()
                        rows.append((path, k, len(text.strip()), len(images), None, page.rect.width, page.rect.height, page.rotation, print_))
                    except Exception as e:
                        rows.append((path, k, 0, 0, f"{type(e).__name__}: {e}", None, None, 0, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, schemas.PAGES)


def native_blocks(files: DataFrame) -> DataFrame:
    """Text spans with their boxes (S3); blank spans are left out, confidence is null."""
    import pymupdf  # noqa: F401

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for k, page in enumerate(pymupdf.open(stream=content, filetype="pdf")):
                    spans = [s for b in page.get_text("dict")["blocks"] for line in b.get("lines", []) for s in line["spans"] if s["text"].strip()]
                    rows += [(path, k, n, s["text"], *map(float, s["bbox"]), None, "native_pdf") for n, s in enumerate(spans)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, schemas.BLOCKS)


def read_blocks(files: DataFrame, recognize, threshold: float = 0.0) -> DataFrame:
    """Blocks by any reader (S6, S8): recognize(path, content) yields (page_index, text, x0, y0, x1, y1, confidence) and is loaded once per worker.

    Readings below the threshold are dropped after numbering, so block_index is that of the reader (P5).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                for n, (page, text, x0, y0, x1, y1, confidence) in enumerate(recognize(path, content)):
                    if confidence is None or confidence >= threshold:
                        rows.append((path, page, n, text, x0, y0, x1, y1, confidence, "ocr"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schemas.BLOCKS.split(", ")])

    return files.select("path", "content").mapInPandas(run, schemas.BLOCKS)
