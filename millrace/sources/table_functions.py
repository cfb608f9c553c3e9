"""Parsers as table functions: SQL and DataFrames give them a table, they get each document's lines in order, one at a time.

    register(spark)
    spark.sql("SELECT * FROM document_blocks(TABLE(lines))")             -- lines (key, pos, line)

analyze() tells Spark the columns, how rows are dealt and how they are sorted, so callers need not: a document's lines meet in one task, and
only the state of the parser is held, never the document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _by_document(lines: AnalyzeArgument, *columns: Y.StructField) -> AnalyzeResult:
    """Columns after the key's; rows by key, in order of pos."""
    kinds = {f.name: f.dataType for f in lines.dataType.fields} if lines.isTable else {}
    if not {"key", "pos", "line"} <= set(kinds):
        raise ValueError("a table with the columns key, pos and line is asked for")
    schema = Y.StructType([Y.StructField("key", kinds["key"]), Y.StructField("pos", kinds["pos"]), *columns])
    return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("pos")])


@F.udtf
class DocumentBlocks:
    """[S-22] (key, pos, kind, panel, n_lines, detail): second-level headings outside fences, which begin panels, and fences with the lines that they
    hold; kind `open` where a document ends within a fence. A line that begins with three backquotes opens or closes a fence."""

    def __init__(self) -> None:
        self.panel, self.fence, self.inside = 0, None, 0

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        return _by_document(lines, Y.StructField("kind", Y.StringType()), Y.StructField("panel", Y.IntegerType()), Y.StructField("n_lines", Y.IntegerType()), Y.StructField("detail", Y.StringType()))

    def eval(self, row: Y.Row) -> Iterator[tuple]:
        line = row["line"] or ""
        if line.startswith("```"):
            if self.fence is None:
                self.fence, self.inside = (row["key"], row["pos"], line[3:].strip()), 0
            else:
                yield self._fence("fence")
        elif self.fence is not None:
            self.inside += 1
        elif line.startswith("## ") and line[3:].strip():
            self.panel += 1
            yield row["key"], row["pos"], "heading", self.panel, 0, line[3:].strip()

    def terminate(self) -> Iterator[tuple]:
        if self.fence is not None:
            yield self._fence("open")

    def _fence(self, kind: str) -> tuple:
        (key, pos, detail), self.fence = self.fence, None
        return key, pos, kind, self.panel, self.inside, detail


@F.udtf
class ListParents:
    """[W-07] (key, pos, parent, depth): of list items, by their indentation, the item that each belongs to, and how deep it lies. Only the open items
    are held."""

    def __init__(self) -> None:
        self.open: list[tuple[int, object]] = []

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        pos = next((f.dataType for f in lines.dataType.fields if f.name == "pos"), Y.IntegerType()) if lines.isTable else Y.IntegerType()
        return _by_document(lines, Y.StructField("parent", pos), Y.StructField("depth", Y.IntegerType()))

    def eval(self, row: Y.Row) -> Iterator[tuple]:
        line = row["line"] or ""
        text = line.lstrip(" ")
        if text[:2] not in ("- ", "* "):
            return
        indent = len(line) - len(text)
        while self.open and self.open[-1][0] >= indent:
            self.open.pop()
        yield row["key"], row["pos"], self.open[-1][1] if self.open else None, len(self.open)
        self.open.append((indent, row["pos"]))


#: [X-04] Parsers by the name under which SQL calls them.
REGISTRY = {"document_blocks": DocumentBlocks, "list_parents": ListParents}


def register(spark: SparkSession, names: tuple[str, ...] = tuple(REGISTRY)) -> None:
    """[X-04] Makes parsers known to a session's SQL; an unknown name raises KeyError."""
    for name in names:
        spark.udtf.register(name, REGISTRY[name])
