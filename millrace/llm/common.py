"""What the operators of this subpackage share: scratch tables, word rules, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import scratch_path

#: Words are maximal runs of other characters. bytes.split() and bytes.strip() use the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables; a small one of documents is dealt over all cores."""
    found = session.table(spark, sf_dir, name)
    return session.spread(found) if name == "documents" else found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither repeat its work nor need its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote; nothing may read df any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that Python never holds many long texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most `limit` bytes together, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_pieces(text: bytes, letters: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes that end with words, so that a very long one is never worked on whole. letters: a table for
    bytes.translate that leaves words and turns all else into blanks."""
    text = text.translate(letters)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + size) if at + size < len(text) else len(text)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def word_lists(text: bytes, letters: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, in a list for each of its pieces."""
    return (piece.split() for piece in text_pieces(text, letters, size))


def word_table(kept: bytes) -> bytes:
    """A table for word_lists: A-Z lower-cased, bytes of `kept` and of characters beyond ASCII left, others blank."""
    return bytes(c + 32 if 65 <= c <= 90 else c if c in kept or c >= 128 else 32 for c in range(256))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]
