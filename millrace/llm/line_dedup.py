"""Line deduplication through a sharded minimal perfect hash.

1. Every document gives the 128-bit hashes of its distinct long keys; a count by hash, aggregated before the shuffle,
   finds the hashes that several documents hold, with the smallest of these documents.
2. These hashes are dealt into shards of bounded size. Each shard becomes one row of arrays: the bit levels of a minimal
   perfect hash (keys that collide on one level go on to the next; a key's index is the rank of its bit), and, in the
   order of the index, 64-bit fingerprints, first documents and document counts. Keys whose first 64 bits are those of another
   key of the shard go to a further row of arrays.
3. Documents probe the arrays. A batch of documents sends each shard one row: its distinct hashes there, and who holds them.
   The rows of a shard, dealt over several tasks, come sorted behind a copy of the shard's arrays and stream past them. A line
   that a third of all documents hold is therefore spread over tasks, and no task holds more than one shard and one batch. A line is a
   repeat if its fingerprint is there with a count of two or more and another document is the first.
4. The hashes of repeats are gathered by document and joined to its text, whose lines of these hashes are cut. Probing moves no text; this
   join shuffles every text once, by doc_id.

A key is a line without white space at its ends, with A-Z lower-cased. Null and empty texts are one empty line. Keys of fewer
than min_chars code points are never dropped. Ids are integers. Rows that repeat an id are the same document: a key in such rows
alone isn't repeated. A document whose id is null holds no key and loses no line. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of

#: Repeated keys, and documents that probe, for each further shard; documents in a batch of probes; holders of a key for each further copy
#: of its shard.
SHARD_KEYS, SHARD_DOCS, BATCH_DOCS, COPY_DOCS = 4096, 20_000, 4096, 50_000
ARRAYS = "sizes binary, bits binary, fingerprints binary, first_docs binary, doc_counts binary"


def long_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line; None if it is too short to count."""
    key = line.strip().lower()  # of bytes: only the six white-space characters and only A-Z
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def key_hashes(text: bytes, min_chars: int) -> set[bytes]:
    """128-bit hashes of the long keys of a text."""
    keys = {long_key(line, min_chars) for line in text.split(b"\n")} - {None}
    return {xxhash.xxh3_128_digest(key) for key in keys}


def _mix(hashes: np.ndarray, level: int) -> np.ndarray:
    x = hashes + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bits at two bits a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bits = bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = max(64, 2 * len(keys))
            at = (_mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels).astype(np.uint8) if levels else np.zeros(0, np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Of the keys it was built from, each its own index from 0; of others, any index or -1."""
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + (_mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            found[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return found

    def pack(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        sizes = np.frombuffer(sizes, np.int64)
        return cls(sizes, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())))


def _key_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if doc is not None:
                    found = key_hashes(text, min_chars)
                    ids += [doc] * len(found)
                    hashes += found
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return rows


def repeated_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, first_doc, doc_count) of the keys that several documents hold. docs: (doc_id, text)."""
    rows = docs.mapInArrow(_key_rows(min_chars), "h1 long, h2 long, doc_id long")
    counts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("doc_count"))
    return counts.where("first_doc < last_doc").drop("last_doc")


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    # 64 bits of hash place a key, the other 64 tell it from others; of keys that share the first each has a row of its own
    pdf, rows = pdf.sort_values(["h1", "h2"]), []
    while len(pdf):
        own = pdf.drop_duplicates("h1")
        pdf = pdf.drop(own.index)
        keys = own["h1"].to_numpy().astype(np.uint64)
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed.index(keys))
        rows.append((int(key[0]), *hashed.pack(), *(own[name].to_numpy()[order].astype(np.int64).tobytes() for name in ("h2", "first_doc", "doc_count"))))
    return pd.DataFrame(rows, columns=["shard", "sizes", "bits", "fingerprints", "first_docs", "doc_counts"])


def _by_shard(repeated: DataFrame, shards: int) -> DataFrame:
    return repeated.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """A row of arrays for each shard that has keys, seldom more."""
    return _by_shard(repeated, shards).groupBy("shard").applyInPandas(_build_shard, f"shard int, {ARRAYS}")


def hot_shards(repeated: DataFrame, shards: int, per_copy: int) -> DataFrame:
    """(shard, copies) of the shards that have a key of more than per_copy documents; others have one copy."""
    most = _by_shard(repeated, shards).groupBy("shard").agg(F.max("doc_count").alias("most"))
    return most.where(F.col("most") > per_copy).select("shard", F.ceil(F.col("most") / per_copy).cast("int").alias("copies"))


def _probe_rows(min_chars: int, shards: int):
    """(shard, turn, h1, h2, counts, docs): for each batch of documents and shard, a number, hashes, how many hold each, and who."""

    def emit(ids: list[int], holders: list[int], hashes: list[bytes], turn: int) -> Iterator[pa.RecordBatch]:
        halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
        docs = np.array(ids, np.int64)[np.array(holders, np.int64)]
        shard = halves[:, 0] % shards
        order = np.lexsort((docs, halves[:, 1], halves[:, 0], shard))
        halves, docs, shard = halves[order], docs[order], shard[order]
        new = np.ones(len(docs), bool)
        new[1:] = (halves[1:] != halves[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(docs)))
        found, first = np.unique(shard, return_index=True)
        ends = np.append(first[1:], len(docs))
        rows: dict[str, list] = {n: [] for n in ("shard", "turn", "h1", "h2", "counts", "docs")}
        for s, a, b in zip(found.tolist(), first.tolist(), ends.tolist(), strict=True):
            lo, hi = np.searchsorted(starts, (a, b))
            keys = halves[starts[lo:hi]]
            for name, value in zip(rows, (s, turn, keys[:, 0].tobytes(), keys[:, 1].tobytes(), counts[lo:hi].tobytes(), docs[a:b].tobytes()), strict=True):
                rows[name].append(value)
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, holders, hashes, turn = [], [], [], None
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if doc is not None:
                    turn = doc if turn is None else turn + 1
                    found = key_hashes(text, min_chars)
                    holders += [len(ids)] * len(found)
                    hashes += found
                    ids.append(doc)
            if len(ids) >= BATCH_DOCS or len(hashes) >= 20 * BATCH_DOCS:
                yield from emit(ids, holders, hashes, turn)
                ids, holders, hashes = [], [], []
        if hashes:
            yield from emit(ids, holders, hashes, turn)

    return probe


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2) of repeats. Rows come by shard, its arrays first."""
    shard, layers = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
            if get("sizes") is not None:
                if get("shard") != shard:
                    shard, layers = get("shard"), []
                layers.append((PerfectHash.unpack(get("sizes"), get("bits")), *(np.frombuffer(get(name), np.int64) for name in ("fingerprints", "first_docs", "doc_counts"))))
            elif get("shard") == shard:  # else the shard has no repeated key
                h1, h2, counts, docs = (np.frombuffer(get(name), np.int64) for name in ("h1", "h2", "counts", "docs"))
                wide = np.repeat(np.arange(len(h1)), counts)
                drop = np.zeros(len(docs), bool)
                for hashed, fingerprints, first_docs, doc_counts in layers:
                    at = hashed.index(h1.astype(np.uint64))
                    hit = (at >= 0) & (fingerprints[at] == h2) & (doc_counts[at] > 1)
                    drop |= hit[wide] & (docs != first_docs[at[wide]])
                yield pa.RecordBatch.from_arrays([pa.array(docs[drop]), pa.array(h1[wide[drop]]), pa.array(h2[wide[drop]])], ["doc_id", "h1", "h2"])


def probe_index(docs: DataFrame, index: DataFrame, shards: int, hot: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, h1, h2): the keys whose lines each document loses. hot: as hot_shards gives them; only these shards have several copies, so
    the arrays that are sent follow the keys and the holders of hot ones, not their product."""
    copies = F.coalesce("copies", F.lit(1))
    arrays = index.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), *(c.split()[0] for c in ARRAYS.split(", ")))
    probes = docs.mapInArrow(_probe_rows(min_chars, shards), "shard int, turn long, h1 binary, h2 binary, counts binary, docs binary")
    probes = probes.join(hot, "shard", "left").withColumn("copy", F.pmod(F.col("turn"), copies).cast("int")).drop("turn", "copies")
    rows = arrays.unionByName(probes, allowMissingColumns=True)
    rows = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("sizes").isNull())
    return rows.mapInArrow(_look_up, "doc_id long, h1 long, h2 long")


def _cut(min_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, lines, dropped = [], [], []
            for text, repeats in zip(texts_of(batch), batch.column("repeats").to_pylist(), strict=True):
                parts = text.split(b"\n")
                stay = parts
                if repeats:
                    gone = {r["h1"].to_bytes(8, "big", signed=True) + r["h2"].to_bytes(8, "big", signed=True) for r in repeats}
                    stay = [p for p in parts if (k := long_key(p, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                kept.append(b"\n".join(stay))
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns.pop("repeats")
            columns |= {"text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return cut


def dedup_lines(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row of docs, and the columns named in keep as they are."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    repeated = materialize(repeated_keys(slim, min_chars), "repeated_lines")
    shards = max(1, -(-repeated.count() // SHARD_KEYS), -(-slim.count() // SHARD_DOCS))
    hot = materialize(hot_shards(repeated, shards, COPY_DOCS), "hot_shards")
    repeats = probe_index(slim, build_index(repeated, shards), shards, hot, min_chars).groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("repeats"))
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep).join(repeats, "doc_id", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields if f.name != "repeats")
    return whole.mapInArrow(_cut(min_chars), f"{fields}, n_lines long, n_dropped long")
