"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel noise, the highest scores drawn.

1. Every text becomes its runs of one to three words, each in the bucket of its crc32. Buckets are counted over all documents and all
   texts of the target; a bucket's gain is the logarithm of the two shares' ratio.
2. The gains, an array of fixed length, go to every task. A text's weight is the sum over its runs, its score the weight plus noise from
   its id. The checksum of a run follows from the checksums of its words by shifting, so that arrays of words are handled at once.
3. Scored rows are stored sorted, eligible rows first by falling score: each partition is a run. Histograms of bounded length, each finer
   than the one before, find the score of the last row to be drawn.
4. Each run is cut where score ranges of about RANGE_ROWS rows end. A range's segments meet in one task, which merges them by trees of
   losers, at most FAN_IN runs to a tree, and trees over trees where there are more. The rows of the ranges before are counted,
   so a range knows its first rank and where to stop; what comes after the exact draw count leaves the merge as it is.

Words are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have no features and weight 0.
A null id counts as the empty text in the noise and comes after other ids in ties. Rows that repeat an id are rows of their own. Empty
tables give empty results; an empty target has counts of 0. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices_of_bytes, texts_of, word_lists, word_table

LETTERS = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Words of the longest feature.
LONGEST = 3
#: Rows of a score range, runs of one tree, bins of a histogram.
RANGE_ROWS, FAN_IN, BINS = 65_536, 64, 4096

_POLYNOMIAL = 0xEDB88320  # of crc32, reflected


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1)
    return x


_STEP = _byte_table()


def _images(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over GF(2), given by the images of the 32 bits, of each of x."""
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits, columns, 0), axis=1).astype(np.uint32)


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """What `length` zero bytes do to a checksum, for each value of each of its four bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    done, power = bits, _STEP[bits & 255] ^ (bits >> 8)
    while length:
        if length & 1:
            done = _images(power, done)
        power = _images(power, power)
        length >>= 1
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_images(done, values << np.uint32(8 * k)) for k in range(4)])


def _blank(checksums: np.ndarray) -> np.ndarray:
    """Of texts with a blank put behind them."""
    x = ~checksums
    return ~(_STEP[(x ^ 32) & 255] ^ (x >> 8))


def run_checksums(words: list[bytes]) -> list[np.ndarray]:
    """For runs of 1, 2, ... words the crc32 of those that end at each word, as if the words before the first were empty."""
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    lengths, kind = np.unique(np.fromiter(map(len, words), np.int64, len(words)), return_inverse=True)
    tables = np.concatenate([_shift(n) for n in lengths.tolist()]).ravel() if len(words) else np.zeros(0, np.uint32)
    found = [own]
    for _ in range(1, LONGEST):
        before = np.zeros(len(words), np.uint32)
        before[1:] = _blank(found[-1][:-1])
        out = own.copy()
        for k in range(4):
            out ^= tables[kind * 1024 + k * 256 + ((before >> np.uint32(8 * k)) & 255)]
        found.append(out)
    return found


def _features(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number of each feature, its bucket, words) in pieces of bounded length."""
    words, owners, places, fresh = [], [], [], 0

    def piece() -> tuple[np.ndarray, np.ndarray, int]:
        who, at = np.array(owners, np.int64), np.array(places, np.int64)
        parts = [(who[ok], sums[ok] % np.uint32(buckets)) for n, sums in enumerate(run_checksums(words)) for ok in [at >= n]]
        return np.concatenate([w for w, _ in parts]), np.concatenate([b for _, b in parts]).astype(np.int64), fresh

    for number, text in enumerate(texts):
        seen = 0
        for some in word_lists(text, LETTERS):
            words += some
            owners += [number] * len(some)
            places += range(seen, seen + len(some))
            seen, fresh = seen + len(some), fresh + len(some)
            if fresh >= 200_000:
                yield piece()
                # the next features may begin with these words, which end no further feature
                words, owners, places, fresh = words[1 - LONGEST :], owners[1 - LONGEST :], [-1] * min(LONGEST - 1, len(words)), 0
    if fresh:
        yield piece()


def _bucket_rows(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices_of_bytes(batches):
            for _, found, _ in _features(texts_of(batch), buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    return rows


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often features of all rows of texts (text) fall in each bucket: an array of fixed length on the driver."""
    counts = np.zeros(buckets, np.int64)
    for row in texts.mapInArrow(_bucket_rows(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed shares' ratio for each bucket."""
    buckets, s, t = len(all_counts), int(all_counts.sum()), int(target_counts.sum())
    ratios = [((b + 1) * (s + buckets)) / ((a + 1) * (t + buckets)) for a, b in zip(all_counts.tolist(), target_counts.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise in thousandths from the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score_rows(weights: np.ndarray, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches):
            ids, n = batch.column("doc_id").to_pylist(), batch.num_rows
            features, sums, words = (np.zeros(n, np.int64) for _ in range(3))
            texts = texts_of(batch)
            for who, bucket, _ in _features(texts, len(weights)):
                features += np.bincount(who, minlength=n)
                sums += np.bincount(who, weights[bucket], minlength=n).astype(np.int64)  # exact: far below 2 ** 53
            # a text of n words has n + (n - 1) + (n - 2) features
            words = np.where(features < 3, (features + 1) // 2, (features + 3) // 3)
            scores = sums + np.array([noise(i, seed) for i in ids], np.int64)
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(sums), "score": pa.array(scores)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so that after a row only the path of its run is played again."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [0] * max(1, len(runs))
        self.winner = self._play(1) if runs else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (row := self.heads[self.winner]) is not None:
            yield row
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in order, by trees of at most FAN_IN runs."""
    while len(runs) > FAN_IN:
        runs = [iter(LoserTree(runs[i : i + FAN_IN])) for i in range(0, len(runs), FAN_IN)]
    return iter(LoserTree(runs))


def _cut_rows(splits: list[int]):
    """Segments of runs: the number of splitting scores above a row's score is its range."""
    falling = np.array(splits[::-1], np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = len(falling) - np.searchsorted(falling, batch.column("score").to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(above.astype(np.int32)), *batch.columns], ["range", *batch.schema.names])

    return rows


PAYLOAD = ("doc_id", "n_features", "weight", "score")


def _merge_rows(first_ranks: dict[int, int], drawn: int):
    """(PAYLOAD, rank) of rows that come by range and run."""

    def merged(number: int, runs: dict[int, list[tuple]]) -> Iterator[tuple]:
        rank = first_ranks[number]
        rest = [iter(r) for r in runs.values()]
        for row in merge_runs(rest) if rank <= drawn else ():
            yield (*row[3:], rank)
            rank += 1
            if rank > drawn:
                break
        left = sum(map(len, runs.values())) - (rank - first_ranks[number])
        if left:  # what the trees have not given, in their order again but without a rank
            order = sorted((row for rows in runs.values() for row in rows))
            for row in order[len(order) - left :]:
                yield (*row[3:], None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [*PAYLOAD, "rank"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, runs = None, {}
        for batch in batches:
            for at, run, doc, features, weight, score in zip(*(batch.column(c).to_pylist() for c in ("range", "run", *PAYLOAD)), strict=True):
                if at != number:
                    if runs:
                        yield batch_of(list(merged(number, runs)))
                    number, runs = at, {}
                runs.setdefault(run, []).append((-score, doc is None, doc or 0, doc, features, weight, score))
        if runs:
            yield batch_of(list(merged(number, runs)))

    return rows


def last_drawn_score(rows: DataFrame, drawn: int) -> int:
    """The drawn-th highest score, by histograms of at most BINS rows."""
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    above = 0
    while low < high:
        width = -(-(high - low + 1) // BINS)
        bins = rows.where(F.col("score").between(low, high)).groupBy(F.expr(f"(score - {low}) div {width}").alias("bin")).count().collect()
        for row in sorted(bins, reverse=True):
            if above + row["count"] >= drawn:
                low, high = low + row.bin * width, min(high, low + row.bin * width + width - 1)
                break
            above += row["count"]
    return low


def draw(rows: DataFrame, percent: int) -> DataFrame:
    """(PAYLOAD, rank) of every row of rows (PAYLOAD, eligible boolean): percent of the eligible rows, those of highest score, have ranks from
    1, ties go to the smaller doc_id, other ranks are null."""
    columns = [F.col(c) for c in PAYLOAD]
    none = F.lit(None).cast("long").alias("rank")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
    stored = materialize(rows.withColumn("run", F.spark_partition_id()).sortWithinPartitions(F.desc("eligible"), *order), "scored_runs")
    drawn = stored.where("eligible").count() * percent // 100
    if not drawn:
        return stored.select(*columns, none)
    last = last_drawn_score(stored.where("eligible"), drawn)
    upper = stored.where(F.col("eligible") & (F.col("score") >= last)).select("run", *columns)
    ranges = max(16, -(-drawn // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    splits = sorted(set(upper.agg(F.percentile_approx("score", shares, 100 * ranges)).first()[0]), reverse=True)
    segments = materialize(upper.mapInArrow(_cut_rows(splits), "range int, run int, doc_id long, n_features long, weight long, score long"), "segments")
    first_ranks, rank = {}, 1
    for row in sorted(segments.groupBy("range").count().collect()):
        first_ranks[row["range"]], rank = rank, rank + row["count"]
    dealt = segments.repartition(max(ranges, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range")
    dealt = dealt.sortWithinPartitions("range", "run", *order)
    merged = dealt.mapInArrow(_merge_rows(first_ranks, drawn), "doc_id long, n_features long, weight long, score long, rank long")
    return stored.where(~F.col("eligible") | (F.col("score") < last)).select(*columns, none).unionByName(merged)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rows with at least min_words words are eligible, percent of them are
    drawn. target: texts (text) of the distribution to come near to. Ids are integers."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights = gains(bucket_counts(slim.select("text"), buckets), bucket_counts(target.select(F.col(text).alias("text")), buckets))
    rows = slim.mapInArrow(_score_rows(weights, seed), "doc_id long, n_words long, n_features long, weight long, score long")
    return draw(rows.withColumn("eligible", F.col("n_words") >= min_words).drop("n_words"), percent)
