"""PDF pages as tables [S-06, S-07]. Needs the package `pymupdf`; without it the readers raise ImportError when they are called, and what
follows them (millrace.operators.blocks) works on any table of lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

LINES = "book string, page int, block int, line int, kind string, text string, size double, x0 double, y0 double, y1 double, rel_top double, rel_bot double"


def _library():
    try:
        import pymupdf
    except ImportError as e:
        raise ImportError("reading PDF files needs the package pymupdf") from e
    return pymupdf


def read_lines(files: DataFrame, least_chars: int = 40) -> DataFrame:
    """[S-06] Lines of files (path, content) with their geometry. A file with fewer characters a page than that is scanned: ValueError."""
    _library()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with _library().open(stream=bytes(content), filetype="pdf") as doc:
                    chars = 0
                    for number, page in enumerate(doc, 1):
                        height = page.rect.height or 1
                        for b, block in enumerate(page.get_text("dict")["blocks"]):
                            for n, line in enumerate(block.get("lines", [])):
                                text = "".join(s["text"] for s in line["spans"])
                                chars += len(text)
                                x0, y0, _, y1 = line["bbox"]
                                rows.append((path, number, b, n, "text", text, max(s["size"] for s in line["spans"]), x0, y0, y1, block["bbox"][1] / height, block["bbox"][3] / height))
                    if chars < least_chars * max(1, doc.page_count):
                        raise ValueError(f"{path} has images of pages only")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return files.select("path", "content").mapInPandas(parse, LINES)


def read_pages(files: DataFrame) -> DataFrame:
    """[S-07] (source, page, text) of files (path, content), in the publisher's order. Encrypted files: ValueError."""
    _library()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with _library().open(stream=bytes(content), filetype="pdf") as doc:
                    if doc.needs_pass:
                        raise ValueError(f"{path} is encrypted")
                    rows += [(path, n, page.get_text(sort=False)) for n, page in enumerate(doc, 1)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return files.select("path", "content").mapInPandas(parse, "source string, page int, text string")
