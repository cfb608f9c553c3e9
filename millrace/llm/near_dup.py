"""Near duplicates by one-permutation MinHash.

1. Every text becomes the set of its k-word shingles, each hashed to 64 bits. The leading bits of a hash choose one of
   128 bins, the rest compete for the bin's least value: one pass, one permutation. Empty bins borrow from another bin that
   a random permutation of their own picks (optimal densification), so small sets are signed as well as large ones. Bins are
   joined by fours to 32 bands; two sets of similarity 0.8 share no band with probability 5e-8.
2. Texts with equal sets form one class, of which the smallest id stands for all. Copies go no further.
3. A band's value is a bucket. Candidates are the edges of a star from the bucket's centre, its smallest id: as many as the
   bucket has members. Both texts of an edge are fetched and the exact sets compared.
4. A star may join two texts to a centre that neither resembles. Every pair that shares a bucket and is still in two components is
   therefore settled: a task takes a bucket whole, with its members' sets of hashes, and compares each member in turn with all later ones of
   other components whose sizes allow a link, until none are left. A pair is looked at in the first bucket that it shares. Buckets whose
   sets are too large for a task are cut into blocks, and each pair of blocks is a task. What is found linked is confirmed as in 3.
5. Confirmed edges are joined to components. No link between texts that share a band is missed.

Lower-cases A-Z only. Fewer than k words are one shingle; a text without words has the empty set and is linked with nothing.
Ids are integers; rows that repeat an id are the same document. Rows with a null id never stand for others: such a row is
kept if no other text equals its set, and its component is then null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, texts_of
from .graph import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Words whose hashes a worker remembers, and edges of a centre that one task compares.
REMEMBERED, CENTRE_EDGES = 400_000, 500
#: Shingles of a bucket up to which its members are one block; a task holds two blocks, some 8 bytes for each shingle.
BLOCK_SHINGLES = 2_000_000
#: What a task settles at once: a bucket and two of its blocks.
CELL = ("bucket", "low", "high")

_donors = np.argsort(np.random.default_rng(20170717).random((BINS, BINS)), axis=1)
_salts = np.random.default_rng(20140622).integers(1, 2**63, BINS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.k, len(words))
        joined = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            joined = _mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(joined)])
        return np.unique(joined)


_starts = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)


def band_values(hashes: np.ndarray) -> np.ndarray:
    """The bands of a set, given as sorted hashes."""
    at = np.searchsorted(hashes, _starts)
    ends = np.append(at[1:], len(hashes))
    full = ends > at
    donor = np.where(full, np.arange(BINS), _donors[np.arange(BINS), np.argmax(full[_donors], axis=1)])
    values = hashes[at[donor]]
    mixed = _mix(values + _salts).reshape(BANDS, ROWS)
    joined = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        joined = _mix(joined * np.uint64(0x9E3779B97F4A7C15) + mixed[:, i])
    return joined.astype(np.int64)


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in slices(batches):
            sizes, first, second, bands = [], [], [], []
            for text in texts_of(batch):
                hashes = shingles(text)
                sizes.append(len(hashes))
                digest = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else bytes(16)
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
                bands.append(band_values(hashes) if len(hashes) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), listed], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return sign


def _exact_set(text: bytes, k: int) -> set:
    words = text.lower().split()
    if not words:
        return set()
    width = min(k, len(words))
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _confirmer(k: int, percent: int):
    """(u, v, linked) of edges with both texts, by exact sets; texts of other rows that share an id are passed over."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)

        def parsed(text: bytes) -> tuple[set, int]:
            hashes = shingles(text)
            return _exact_set(text, k), int.from_bytes(xxhash.xxh3_128_digest(hashes.tobytes())[:8], "big", signed=True)

        last, centre = None, (set(), 0)
        for batch in slices(batches, 256):
            keep, linked = [], []
            for row, (text, digest, other, other_digest) in enumerate(zip(texts_of(batch, "text"), batch.column("u_d1").to_pylist(), texts_of(batch, "centre_text"), batch.column("v_d1").to_pylist(), strict=True)):
                if other != last:
                    last, centre = other, parsed(other)
                mine = parsed(text)
                if mine[1] == digest and centre[1] == other_digest:
                    shared = len(mine[0] & centre[0])
                    keep.append(row)
                    linked.append(100 * shared >= percent * (len(mine[0]) + len(centre[0]) - shared))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return confirm


def confirm_edges(edges: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """edges: (u, u_d1, v, v_d1), v being the centre. Many edges of one centre are dealt over tasks with copies of its text."""
    shares = edges.groupBy("v").agg(F.ceil(F.count("*") / CENTRE_EDGES).cast("int").alias("shares"))
    centres = docs.hint("merge").join(shares, F.col("doc_id") == F.col("v"), "inner").select("v", F.col("text").alias("centre_text"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = edges.join(shares, "v").withColumn("share", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int")).drop("shares")
    members = dealt.join(docs.hint("merge"), F.col("doc_id") == F.col("u"), "inner").drop("doc_id")
    return members.join(centres.hint("merge"), ["v", "share"]).mapInArrow(_confirmer(k, percent), "u long, v long, linked boolean")


def texts_in(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The documents that rows name, written down: later joins move these texts only. By merge at any size, as both sides grow alike."""
    return materialize(docs.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), name)


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in slices(batches):
            hashes = [shingles(text).tobytes() for text in texts_of(batch)]
            first = [int.from_bytes(xxhash.xxh3_128_digest(h)[:8], "big", signed=True) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(first, pa.int64()), pa.array(hashes, pa.binary())], ["doc_id", "d1", "hashes"])

    return sets


class Cell:
    """Members of a bucket, by size, that one task settles."""

    def __init__(self, rows: pa.Table, percent: int):
        rows = rows.sort_by("n_shingles").combine_chunks()
        self.rows, self.percent = rows, percent
        self.ids, self.d1, self.sizes, self.block = (rows.column(c).to_numpy() for c in ("doc_id", "d1", "n_shingles", "block"))
        self.of = rows.column("of").to_numpy().copy()
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(self.ids), BANDS)
        self.bucket, self.whole = rows.column("bucket")[0].as_py(), rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        self.ends = np.searchsorted(self.sizes, 100 * self.sizes // percent, side="right")

    def against(self, i: int) -> np.ndarray:
        """The later members that may be linked with i, are in other components and share no earlier band with it."""
        later = np.arange(i + 1, self.ends[i])
        later = later[self.of[later] != self.of[i]]
        if not self.whole:
            later = later[self.block[later] != self.block[i]]
        if len(later):
            first = np.argmax(self.bands[later] == self.bands[i], axis=1)
            later = later[self.bands[i][first] == self.bucket]
        return later


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[Cell]:
    """Rows of one cell come one after another."""
    held, last = [], None
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy() for c in CELL])
            for at, end in pairwise([0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]):
                key = tuple(keys[:, at].tolist())
                if held and key != last:
                    yield Cell(pa.Table.from_batches(held), percent)
                    held = []
                held.append(batch.slice(at, end - at))
                last = key
    if held:
        yield Cell(pa.Table.from_batches(held), percent)


def _unsettled(percent: int):
    """The rows of members that some pair of their cell still needs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, percent):
            needed = np.zeros(len(cell.ids), bool)
            for i in range(len(cell.ids) - 1):
                others = cell.against(i)
                needed[others] = True
                needed[i] |= len(others) > 0
            if needed.any():
                yield from cell.rows.filter(pa.array(needed)).to_batches()

    return find


def _settler(percent: int):
    """(u, u_d1, v, v_d1) that link the components of a cell, until no pair of two components is left uncompared."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, percent):
            sets = [np.frombuffer(h, np.uint64) for h in cell.rows.column("hashes").to_pylist()]
            found = []
            for i, mine in enumerate(sets):
                others = cell.against(i)
                if not len(others):
                    continue
                joined = np.concatenate([sets[j] for j in others])
                at = np.minimum(np.searchsorted(mine, joined), len(mine) - 1)
                starts = np.cumsum(cell.sizes[others]) - cell.sizes[others]
                shared = np.add.reduceat((mine[at] == joined).astype(np.int64), starts)
                for j in others[100 * shared >= percent * (len(mine) + cell.sizes[others] - shared)]:
                    if cell.of[j] != cell.of[i]:
                        found.append((j, i))
                        cell.of[cell.of == cell.of[j]] = cell.of[i]
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell.ids[u], cell.d1[u], cell.ids[v], cell.d1[v])], ["u", "u_d1", "v", "v_d1"])

    return settle


def remaining_edges(rows: DataFrame, stars: DataFrame, joined: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges between the components of joined, found by comparing every pair that shares a bucket, and the texts that they need."""
    # a centre has met all members of its bucket
    rest = rows.join(stars, "bucket").where((F.col("doc_id") != F.col("centre.doc_id")) | (F.col("d1") != F.col("centre.d1"))).drop("centre")
    named = rest.join(joined, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "d1", "n_shingles", F.coalesce("component", "doc_id").alias("of"))
    named = materialize(named, "named")
    blocks = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")
    mixed = named.groupBy("bucket").agg(blocks, F.min("of").alias("least"), F.max("of").alias("most")).where("least < most").select("bucket", "blocks")
    members = named.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    members = members.drop("blocks", "other").join(reps.select("doc_id", "d1", "bands").dropDuplicates(["doc_id", "d1"]).hint("merge"), ["doc_id", "d1"])
    kinds = "bucket long, low int, high int, block int, doc_id long, d1 long, n_shingles long, of long, bands array<long>"
    cells = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    members = members.select(*[c.split()[0] for c in kinds.split(", ")])
    needed = materialize(cells(members).mapInArrow(_unsettled(percent), kinds), "unsettled")
    texts = texts_in(texts, needed, "open_texts")
    sets = texts.mapInArrow(_setter(k), "doc_id long, d1 long, hashes binary").dropDuplicates(["doc_id", "d1"])
    found = cells(needed.join(sets.hint("merge"), ["doc_id", "d1"])).mapInArrow(_settler(percent), "u long, u_d1 long, v long, v_d1 long")
    return materialize(found.distinct(), "candidates"), texts


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs; kept: it is the smallest id of its component."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(slim.mapInArrow(_signer(k), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    classes = materialize(signed.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")

    reps = signed.where("doc_id is not null and n_shingles > 0").join(classes.where("rep is not null"), (F.col("doc_id") == F.col("rep")) & (signed.d1 == classes.d1) & (signed.d2 == classes.d2), "left_semi")
    rows = reps.select("doc_id", "d1", "n_shingles", F.explode("bands").alias("bucket")).dropDuplicates(["bucket", "doc_id", "d1"])
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    rows = materialize(rows.join(shared, "bucket"), "buckets")

    texts = texts_in(slim, rows, "candidate_texts")
    member = F.struct("doc_id", "d1", "n_shingles")
    # sizes alone rule out many pairs: the smaller set is at most the intersection
    possible = 100 * F.least("n_shingles", "centre.n_shingles") >= percent * F.greatest("n_shingles", "centre.n_shingles")
    stars = rows.groupBy("bucket").agg(F.min(member).alias("centre"))
    pairs = rows.join(stars, "bucket").where("doc_id <> centre.doc_id").where(possible)
    edge = [F.col("doc_id").alias("u"), F.col("d1").alias("u_d1"), F.col("centre.doc_id").alias("v"), F.col("centre.d1").alias("v_d1")]
    edges = materialize(pairs.select(*edge).dropDuplicates(["u", "u_d1", "v", "v_d1"]), "candidates")
    decided = materialize(confirm_edges(edges, texts, k, percent), "confirmed")
    joined = components(decided.where("linked").select("u", "v"))

    edges, texts = remaining_edges(rows, stars, joined, reps, texts, k, percent)
    decided = decided.union(materialize(confirm_edges(edges, texts, k, percent), "confirmed"))
    joined = components(decided.where("linked").select("u", "v"))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
