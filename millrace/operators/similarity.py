"""The lossless q-gram similarity join [J-01..J-06]: every pair of strings whose difflib ratio reaches a threshold, without
comparing all pairs.

Strings are made distinct first. A pair of lengths m and n needs h matches, so h <= min(m, n) bounds which lengths meet [J-02], and
matching blocks of h characters leave at least `overlap_bound` shared q-grams, counted with repetition [J-04]. Strings meet in cells: two blocks
of strings, from bands of lengths that can meet. There a common token (gram, occurrence) is a bit of each string and a rarer one lists its holders [J-03], so the
overlaps of a string with all others are counted at once: no pair moves before it has passed.
Pairs whose bound is 0 must still share a character if h is positive; they meet over their characters [J-05].

Ratios ask for less than all those pairs: in the same cells, characters that both strings have [J-06], shared grams by bits, and grams at places
that can match sieve first, whatever the bound. What is left is dealt anew, with its texts, and passes the longest common subsequence, and at last the
ratio itself, in both orders, as it isn't symmetric.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import common_subsequence, matcher_ratio, shared_characters
from ..session import stored


#: Rows up to which a table of lengths goes to every task.
SMALL = 100_000


def _to_all(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has no more than SMALL of the `rows` that were counted."""
    return F.broadcast(df) if rows <= SMALL else df


def distinct_strings(items: DataFrame, key: str = "id", value: str = "s") -> DataFrame:
    """(sid, s, n, members): each distinct string under its smallest key."""
    return items.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("s")).agg(F.min(key).alias("sid"), F.count("*").alias("members")).select("sid", "s", F.length("s").alias("n"), "members")


def occurrence_tokens(strings: DataFrame, q: int) -> DataFrame:
    """[W-02] (sid, n, token): every q-gram of each string with its number among equal ones."""
    grams = strings.select("sid", "n", F.posexplode(T.qgrams(F.col("s"), q)).alias("pos", "gram"))
    occ = F.row_number().over(Window.partitionBy("sid", "gram").orderBy("pos"))
    return grams.select("sid", "n", F.concat("gram", F.lit("\u0001"), occ.cast("string")).alias("token"))


def feasible_lengths(strings: DataFrame, q: int, percent: int) -> DataFrame:
    """[J-02] (m, n, h, bound) for the lengths that occur, m <= n. A length meets only those up to (200 - percent) / percent of it."""
    lengths = strings.select("n").distinct()
    reach = F.floor(F.col("n") * (200 - percent) / percent).cast("int")
    pairs = lengths.select(F.col("n").alias("m"), F.explode(F.sequence(F.col("n"), F.greatest(reach, F.col("n")))).alias("n")).join(lengths, "n")
    h = T.minimum_matches(F.col("m") + F.col("n"), percent)
    pairs = pairs.withColumn("h", h).where("h <= m")
    return pairs.withColumn("bound", T.overlap_bound(F.col("m"), F.col("n"), q, percent))


#: Code points and strings of a block.
BLOCK_POINTS, BLOCK_STRINGS = 1 << 20, 8192


def _compact(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the values of x, in their order."""
    if int(x.max(initial=0)) >= 1 << 22:
        return np.unique(x, return_inverse=True)[1]
    return (np.cumsum(np.bincount(x) > 0) - 1)[x]


def _numbered(strings: list[str]) -> np.ndarray:
    """The characters of all strings, equal ones under the same number, from 0."""
    return _compact(np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32))


def _tokens(strings: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the string, token) of all tokens by string; equal q-grams that are the same one in number among equals have the same token, from 0."""
    points = _numbered(strings)
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    n = np.maximum(length - q + 1, 0)
    number = np.repeat(np.arange(len(strings)), n)
    at = np.arange(len(number)) + np.repeat(np.cumsum(length) - length - np.cumsum(n) + n, n)
    gram, base = points[at], int(points.max(initial=0)) + 1
    for k in range(1, q):
        gram = _compact(gram * base + points[at + k])
    key = number * (int(gram.max(initial=0)) + 1) + gram
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    runs = np.flatnonzero(new)
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(runs, np.diff([*runs, len(order)]))
    return number, _compact(nth * (int(gram.max(initial=0)) + 1) + gram)


#: A token that more than one in so many strings of a cell have is a bit of each; the holders of all others are listed.
COMMON = 12


def _cell_pairs(a: list[tuple[int, str]], b: list[tuple[int, str]] | None, q: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, m, n, overlap) of the pairs of a block with another one, or with itself, whose overlap reaches a positive bound. Overlaps of a string with
    all others of fitting lengths are counted at once: common bits, and lists of those that hold its rarer tokens."""
    by_length = lambda rows: sorted(rows, key=lambda r: len(r[1]))
    rows = by_length(a) + (by_length(b) if b is not None else [])
    sid, n = np.array([r[0] for r in rows], np.int64), np.array([len(r[1]) for r in rows], np.int64)
    number, token = _tokens([r[1] for r in rows], q)
    ends = (len(a), len(rows)) if b is not None else (0, len(a))
    holders = np.bincount(token)
    common = holders * COMMON > len(rows)
    often = common[token]
    bits = np.zeros((len(rows), max(-(-int(common.sum()) // 64), 1) * 64), bool)
    bits[number[often], (np.cumsum(common) - 1)[token[often]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    seldom = ~often & (holders[token] > 1)
    number, token = number[seldom], token[seldom]
    first = np.searchsorted(number, np.arange(len(rows) + 1))
    other = (number >= ends[0]) & (number < ends[1])
    by = np.argsort(token[other], kind="stable")
    held = number[other][by]
    many = np.bincount(token[other], minlength=len(holders))
    start, out, waiting = np.cumsum(many) - many, [], 0
    for i in range(len(a)):
        lo, hi = ends[0] + np.searchsorted(n[ends[0] : ends[1]], [n[i] * percent // (200 - percent), n[i] * (200 - percent) // percent + 1])
        lo = max(lo, i + 1)  # within a block each pair once; all of another block come behind
        if lo >= hi:
            continue
        h = (percent * (n[i] + n[lo:hi]) + 199) // 200
        bound = np.where(h <= np.minimum(n[i], n[lo:hi]), h - (q - 1) * (n[i] + n[lo:hi] - 2 * h + 1), 0)
        met = held[_of_all(start, many, token[first[i] : first[i + 1]])] - lo
        overlap = np.bitwise_count(bits[lo:hi] & bits[i]).sum(axis=1, dtype=np.int64) + np.bincount(met[(met >= 0) & (met < hi - lo)], minlength=hi - lo)
        good = np.flatnonzero((bound > 0) & (overlap >= bound))
        if len(good):
            some = good + lo
            out.append((np.minimum(sid[i], sid[some]), np.maximum(sid[i], sid[some]), np.minimum(n[i], n[some]), np.maximum(n[i], n[some]), overlap[good]))
            waiting += len(some)
        if waiting > 50_000:
            yield _pair_batch(out)
            out, waiting = [], 0
    yield _pair_batch(out)


def _pair_batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0)] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()).cast(k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "m", "n", "overlap"])


def _met_in_cells(met, q: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])

        def pairs() -> Iterator[pa.RecordBatch]:
            itself = cell[0] == cell[2] and cell[1] == cell[3]
            if sides[0] and (itself or sides[1]):
                yield from met(sides[0], None if itself else sides[1], q, percent)

        for batch in batches:
            for *own, side, sid, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != cell:
                    if cell:
                        yield from pairs()
                    cell, sides = own, ([], [])
                sides[side].append((sid, s))
        if cell:
            yield from pairs()

    return rows


#: Characters that are counted one by one when strings meet, and those of them that are asked first; all others count as one.
COUNTED, FIRST = 64, 12
#: Bytes of text in a batch of close pairs.
PAIR_BYTES = 4 << 20


def _counts(known: np.ndarray, number: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(COUNTED, strings): how often each has the commonest characters of them all, in the last row all others together."""
    often = np.bincount(known)
    place = np.empty(len(often), np.int64)
    place[np.argsort(-often, kind="stable")] = np.minimum(np.arange(len(often)), COUNTED - 1)
    counts = np.bincount(place[known] * len(n) + number, minlength=COUNTED * len(n)).reshape(COUNTED, len(n))
    return counts.astype(np.int16 if n.max(initial=0) < 1 << 15 else np.int32)


def _bits(number: np.ndarray, gram: np.ndarray, strings: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, words) of bits, some 32 times as many as a string has grams, and how many grams of each found their bit set by another one of the string.
    A gram sets another bit for each time that it comes; grams come by string and in order."""
    runs = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (number[1:] != number[:-1])])[: len(gram)])
    nth = np.arange(len(gram)) - np.repeat(runs, np.diff([*runs, len(gram)]))
    most = 64 << max(32 * len(gram) // max(strings, 1) // 64, 1).bit_length()
    mixed = (gram * 1_000_003 + nth).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - most.bit_length() + 1)
    where = number * most + mixed.astype(np.int64)
    out = np.zeros(strings * most, bool)
    out[where] = True
    out = np.packbits(out.reshape(strings, most), axis=1).view(np.uint64)
    return out, np.bincount(number, minlength=strings) - np.bitwise_count(out).sum(axis=1, dtype=np.int64)


def _of_all(first: np.ndarray, size: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Places of what some strings have, one string after the other."""
    ends = np.cumsum(size[some])
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[some] - ends + size[some], size[some])


def _sums(marks: np.ndarray, size: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The sum of marks for each of some strings, whose marks follow one another."""
    total, ends = np.concatenate([[0], np.cumsum(marks)]), np.cumsum(size[some])
    return total[ends] - total[ends - size[some]]


def _close(left: list[str], right: list[str] | None, q: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others): strings of a block with those of another one, or with later ones of itself, that pass the bounds of the ratio: on characters that both
    have, on grams that both have, and on grams at places that can match. Both blocks come by length; numbers of the right block go on from those of the left."""
    strings = left + (right or [])
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    known, number = _numbered(strings), np.repeat(np.arange(len(strings)), n)
    counts = _counts(known, number, n)
    rest = n - counts[: FIRST - 1].sum(axis=0, dtype=np.int64)
    size = np.maximum(n - q + 1, 0)
    first, number = np.cumsum(size) - size, np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(number)) - np.repeat(first, size)
    gram, base = np.zeros(len(number), np.int64), int(known.max(initial=0)) + 1
    for k in range(q):
        gram = (gram if base ** (k + 1) < 1 << 40 else np.unique(gram, return_inverse=True)[1]) * base + known[np.repeat(np.cumsum(n) - n, size) + place + k]
    gram = gram if int(gram.max(initial=0)) < 1 << 40 else np.unique(gram, return_inverse=True)[1]
    order = np.argsort(number * (int(gram.max(initial=0)) + 1) + gram, kind="stable")
    gram, place = gram[order], place[order]
    bits, doubled = _bits(number, gram, len(strings))
    apart = 4 * int(n.max(initial=0)) + 4
    at = gram * apart + place
    ends = (len(left), len(strings)) if right is not None else (0, len(left))
    for i in range(len(left)):
        lo, hi = ends[0] + np.searchsorted(n[ends[0] : ends[1]], [n[i] * percent // (200 - percent), n[i] * (200 - percent) // percent + 1])
        lo = max(lo, i + 1)
        if lo >= hi:
            continue
        h = (percent * (n[i] + n[lo:hi]) + 199) // 200
        shared = np.minimum(rest[lo:hi], rest[i])
        for k in range(FIRST - 1):
            shared += np.minimum(counts[k, lo:hi], counts[k, i])
        some = np.flatnonzero(shared >= h)
        if not len(some):
            continue
        h, some = h[some], some + lo
        for part in range(0, len(some), 1024):
            met, least = some[part : part + 1024], h[part : part + 1024]
            good = np.minimum(counts[:, met], counts[:, i, None]).sum(axis=0, dtype=np.int64) >= least
            met, least = met[good], least[good]
            bound = least - (q - 1) * (n[i] + n[met] - 2 * least + 1)
            good = np.bitwise_count(bits[met] & bits[i]).sum(axis=1, dtype=np.int64) + doubled[i] >= bound
            met, least, bound = met[good], least[good], bound[good]
            if len(met) and size[i]:
                mine = at[first[i] : first[i] + size[i]]
                theirs = at[_of_all(first, size, met)]
                # what is left out of one string before a match moves it back, of the other on
                found = np.searchsorted(mine, theirs - np.repeat(n[met] - least, size[met]))
                near = np.append(mine, np.iinfo(np.int64).max)[found] <= theirs + np.repeat(n[i] - least, size[met])
                met = met[(bound <= 0) | (_sums(near, size, met) >= bound)]
            if len(met):
                yield i, met


def _close_pairs(a: list[tuple[int, str]], b: list[tuple[int, str]] | None, q: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sa, sb) of the pairs of a block with another one, or with itself, that may be as similar as that."""
    by_length = lambda rows: sorted(rows, key=lambda r: len(r[1]))
    rows = [by_length(a), by_length(b) if b is not None else None]
    every, out, waiting = rows[0] + (rows[1] or []), [], 0

    def batch() -> pa.RecordBatch:
        ids, texts = ([[row[k] for row in side] for side in zip(*out, strict=True)] or [[], []] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ids] + [pa.array(c, pa.string()) for c in texts], ["a", "b", "sa", "sb"])

    for i, others in _close([r[1] for r in rows[0]], rows[1] and [r[1] for r in rows[1]], q, percent):
        for j in others.tolist():
            pair = (every[i], every[j]) if every[i][0] < every[j][0] else (every[j], every[i])
            out.append(pair)
            waiting += len(pair[0][1]) + len(pair[1][1])
            if waiting > PAIR_BYTES:
                yield batch()
                out, waiting = [], 0
    yield batch()


def _in_blocks(strings: DataFrame, percent: int, shortest: int) -> DataFrame:
    """(u, i, v, j, side, sid, s): strings, each copied once for each block that its own one meets, by the cells (u, i, v, j) of two blocks.

    Lengths that may meet are in the same band or in neighbours. A band has as many blocks as its text needs; two blocks that may meet are a cell,
    which one task compares.
    """
    band = F.floor(F.log("n") / math.log((200 - percent) / percent)).cast("int")
    banded = strings.where(F.col("n") >= shortest).select("sid", "s", band.alias("band"), "n")
    # a row for each band that occurs: as many as the logarithm of the longest string
    sizes = banded.groupBy("band").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_POINTS, F.count("*") / BLOCK_STRINGS)).cast("int").alias("blocks")).collect()
    blocks = {r.band: r.blocks for r in sizes}
    cells = sum(k * (k + 1) // 2 + k * blocks.get(x + 1, 0) for x, k in blocks.items())
    counts = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]) if blocks else F.create_map().cast("map<int,int>")
    numbers = lambda of: F.sequence(F.lit(0), F.try_element_at(counts, of) - 1)
    i, x = F.col("block"), F.col("band")
    cell = lambda *c: F.struct(*[v.cast("int").alias(k) for k, v in zip(("u", "i", "v", "j", "side"), c, strict=True)])
    within = F.transform(numbers(x), lambda j: cell(x, F.least(i, j), x, F.greatest(i, j), (i > j).cast("int")))
    above, below = F.transform(numbers(x + 1), lambda j: cell(x, i, x + 1, j, F.lit(0))), F.transform(numbers(x - 1), lambda j: cell(x - 1, j, x, i, F.lit(1)))
    none = F.array().cast("array<struct<u:int,i:int,v:int,j:int,side:int>>")
    own = banded.withColumn("block", F.pmod(F.xxhash64("sid"), F.try_element_at(counts, x)))
    dealt = own.select(F.explode(F.concat(within, F.coalesce(above, none), F.coalesce(below, none))).alias("c"), "sid", "s").select("c.*", "sid", "s")
    keys = ["u", "i", "v", "j"]
    return dealt.repartition(max(1, min(cells, 4000)), *keys).sortWithinPartitions(*keys)


def blocked_overlaps(strings: DataFrame, q: int = 3, percent: int = 90) -> DataFrame:
    """[J-02, J-03, J-04] (a, b, m, n, overlap), a < b: the pairs whose bound is positive and whose overlap reaches it."""
    dealt = _in_blocks(strings, percent, q)
    return dealt.mapInArrow(_met_in_cells(_cell_pairs, q, percent), "a long, b long, m int, n int, overlap int")


def close_pairs(strings: DataFrame, q: int = 3, percent: int = 90) -> DataFrame:
    """[J-02, J-04, J-05, J-06] (a, b, sa, sb), a < b: the pairs that may be as similar as that, with their texts. A gram longer than q sieves more."""
    dealt = _in_blocks(strings, percent, 1)
    return dealt.mapInArrow(_met_in_cells(_close_pairs, q + 1, percent), "a long, b long, sa string, sb string")


def zero_bound_candidates(strings: DataFrame, lengths: DataFrame, rows: int = SMALL + 1) -> DataFrame:
    """[J-05] (a, b): pairs whose bound is 0, by shared characters; those that need no match at all are the empty string alone."""
    zero = lengths.where("bound = 0")
    short = strings.join(_to_all(zero.select(F.col("m").alias("n")).union(zero.select("n")).distinct(), rows), "n")
    chars = occurrence_tokens(short.select("sid", "s", "n"), 1)
    left, right = chars.select("token", F.col("sid").alias("a"), F.col("n").alias("na")), chars.select("token", F.col("sid").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "token").where("a < b").select("a", "b", F.least("na", "nb").alias("m"), F.greatest("na", "nb").alias("n")).distinct()
    return pairs.join(_to_all(zero.select("m", "n"), rows), ["m", "n"]).select("a", "b")


def overlap_pairs(strings: DataFrame, q: int = 3, percent: int = 90) -> DataFrame:
    """[J-04] (a, b, m, n, h, bound, overlap): distinct strings that may be as similar as that, with their exact q-gram overlap."""
    strings = stored(strings, "strings")
    passed = blocked_overlaps(strings, q, percent)
    lengths = stored(feasible_lengths(strings, q, percent), "lengths")
    rows = lengths.count()
    tokens = lambda c: occurrence_tokens(c, q).groupBy("sid").agg(F.collect_list("token").alias("tokens"))
    short = strings.join(_to_all(lengths.where("bound = 0").select(F.explode(F.array("m", "n")).alias("n")).distinct(), rows), "n")
    sets = short.select("sid", "n").join(tokens(short), "sid", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    both = _with_both(zero_bound_candidates(strings, lengths, rows), sets, "tokens").withColumn("overlap", F.size(F.array_intersect("ta", "tb")))
    zero = both.select("a", "b", F.least("na", "nb").alias("m"), F.greatest("na", "nb").alias("n"), "overlap")
    bound = T.overlap_bound(F.col("m"), F.col("n"), q, percent)
    every = passed.union(zero).withColumns({"h": T.minimum_matches(F.col("m") + F.col("n"), percent), "bound": bound})
    return every.where("overlap >= bound").select("a", "b", "m", "n", "h", "bound", "overlap")


def _with_both(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col(name).alias(f"t{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def character_pairs(pairs: DataFrame, strings: DataFrame) -> DataFrame:
    """[J-06] pairs with shared_chars, the characters that both strings have, counted with repetition; fewer than h go."""
    both = _with_both(pairs, strings.where("n > 0"), "s").withColumn("shared_chars", shared_characters("ta", "tb"))
    return both.where("shared_chars >= h").drop("na", "nb", "ta", "tb")


def ratio_classes(items: DataFrame, q: int = 3, percent: int = 90, key: str = "id", value: str = "s", exclude: DataFrame | None = None) -> DataFrame:
    """[J-01] (a, b, ratio_ab, ratio_ba, members_a, members_b): pairs of distinct strings, each under its smallest key, of which one
    order at least reaches the threshold.

    exclude: [X-01] pairs (a, b) that need no comparison.
    """
    strings = stored(distinct_strings(items, key, value), "strings")
    pairs = close_pairs(strings, q, percent)
    if exclude is not None:
        pairs = pairs.join(exclude, ["a", "b"], "left_anti")
    # dealt anew: near copies meet in a few cells, and their ratios take longer than all the rest
    both = pairs.repartition(max(32, 4 * strings.sparkSession.sparkContext.defaultParallelism), "a", "b").sortWithinPartitions("sb")
    # blocks of matches are a common subsequence; it takes a fraction of the ratio's time, and few pairs without the ratio pass it
    both = both.where(common_subsequence("sa", "sb") >= T.minimum_matches(F.length("sa") + F.length("sb"), percent))
    rated = both.withColumns({"ratio_ab": matcher_ratio("sa", "sb"), "ratio_ba": matcher_ratio("sb", "sa")})
    rated = rated.where(F.greatest("ratio_ab", "ratio_ba") >= percent / 100).select("a", "b", "ratio_ab", "ratio_ba")
    side = lambda s: strings.select(F.col("sid").alias(s), F.col("members").alias(f"members_{s}"))
    return rated.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ratio_ab", "ratio_ba", "members_a", "members_b")


def ratio_pairs(items: DataFrame, q: int = 3, percent: int = 90, key: str = "id", value: str = "s", exclude: Column | None = None) -> DataFrame:
    """[J-01] (i, j, ratio): all pairs of rows with i < j whose ratio, in that order, reaches the threshold. Equal strings have
    ratio 1. The number of pairs grows with the square of the copies of a string; ratio_classes avoids that."""
    strings = distinct_strings(items, key, value)
    rows = items.select(F.col(key).alias("key"), F.col(value).alias("s")).join(strings.select("s", "sid"), "s").select("key", "sid")
    rated = ratio_classes(items, q, percent, key, value)
    directed = rated.select("a", "b", F.col("ratio_ab").alias("ratio")).union(rated.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ratio_ba").alias("ratio")))
    directed = directed.union(strings.where("members > 1").select(F.col("sid").alias("a"), F.col("sid").alias("b"), F.lit(1.0).alias("ratio"))).where(F.col("ratio") >= percent / 100)
    left, right = rows.select(F.col("key").alias("i"), F.col("sid").alias("a")), rows.select(F.col("key").alias("j"), F.col("sid").alias("b"))
    pairs = directed.join(left, "a").join(right, "b").where("i < j").select("i", "j", "ratio")
    return pairs if exclude is None else pairs.where(~exclude)
