"""Packing documents into sequences of a fixed number of tokens.

A document is its ids and one end id. Documents longer than a sequence are first cut into full windows; each of these is
a sequence of its own. What is left of every document, shorter than a sequence, is packed by best-fit decreasing: pieces
in order of falling length, each into the open sequence with the least room that still holds it. Open sequences are
found through a segment tree over their remaining capacity, which knows at every node whether any sequence below has
that much room.

Only lengths are packed. They are dealt at random into groups of bounded size; each group is packed on its own, so no task
grows with the input, and at 2,048 tokens a group of some ten thousand pieces leaves less than one sequence half empty.

A null or empty text is the end id alone. Rows that repeat, also with the same id, are packed as often as they come; a null
id is returned as it is. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, slices

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces in a group on average, and room for the sequence numbers of a group.
GROUP_PIECES, GROUP_ROOM = 20_000, 1 << 32


class CapacityTree:
    """A segment tree indexed by remaining capacity: leaf c counts the open sequences with room for c more tokens."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.counts = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += by
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that an open sequence has."""
        node = self.leaves + need
        if self.counts[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.counts[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.counts[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece. Equal lengths go in their order."""
    tree = CapacityTree(size)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tree.tightest(need)
        if room is None:
            at, room = opened, size
            opened += 1
        else:
            at = tree.take(room)
        sequence[k], offset[k] = at, size - room
        if room > need:
            tree.add(room - need, at)
    return sequence, offset


def _cutter(path: str, size: int, end_id: int, id_type: pa.DataType | None = None):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, end = bpe.load(path), np.array([end_id], "<u4")
        for batch in slices(batches):
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([pairs.encode(text or "").astype("<u4", copy=False), end])
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def cut_documents(docs: DataFrame, size: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: full windows, then the rest."""
    path = tokenizer_path or bpe.default_path()
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(path, size, end_id), PIECES.format(id=kind))


def pack_pieces(pieces: DataFrame, size: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. Pieces of full length get sequences of their own. pieces must be a stored table, so that a task
    that runs again numbers its rows alike."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = PIECES.format(id=kind) + ", sequence_id long, offset long"
    groups = max(1, -(-pieces.count() // group_pieces))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        sequence, offset = best_fit_decreasing(pdf["length"].to_numpy(), size)
        pdf = pdf.assign(sequence_id=sequence + int(key[0]) * GROUP_ROOM, offset=offset)
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # the number of the row keeps equal rows from gathering in one group
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, size: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document."""
    pieces = materialize(cut_documents(docs, size, end_id, tokenizer_path, doc_id, text), "pieces")
    return pack_pieces(pieces, size)
