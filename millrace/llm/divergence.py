"""Divergence of sources within each language, by exact counts of a vocabulary.

1. First pass: each document gives its distinct terms; a term's documents are counted by language, partly in the task and then over all
   tasks. Terms of at least min_docs documents are kept.
2. Second pass: the kept terms, a blank at both ends, make an automaton for each language, in blocks of at most BLOCK_BYTES of terms; texts, whose other
   characters become blanks, run through it, and every hit is an occurrence. Counts by language, source and term are kept sparse: only those
   above 0 are rows.
3. A term's share in a group is p; a term that the group lacks has the group's least share, p0. The sum of |p - q| over all terms is that of all
   terms as if both groups lacked them, plus a correction for each posting (in one row for each group, against all p0 of the language, by
   prefix sums over its sorted shares), plus one for each term of both groups. The last are summed by tiles: postings of a term in blocks of
   TILE sources, each pair of blocks a small matrix in the task that has its language, tile and part of the terms.

Terms are maximal runs of letters and characters beyond ASCII, A-Z lower-cased. Null text, language and source count as ''. A group
without kept terms has all its pairs with N = 0; a language without kept terms has pairs of value 0. Rows that repeat an id are documents of
their own. Counts may pass 2^31 and products 2^63: shares are divided as decimals. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices_of_bytes, text_pieces, texts_of, word_lists, word_table

LETTERS = word_table(b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of terms of one automaton's block, entries that a task counts before it passes them on, sources of a side of a tile, and terms for each
#: further part of a tile.
BLOCK_BYTES, HELD, TILE, PART_TERMS = 16 << 20, 400_000, 256, 2_000


def _slim(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))


def _repeated(values: list[tuple[str, int]]) -> pa.Array:
    """Each string so often."""
    return pa.array([v for v, _ in values], pa.string()).take(pa.array(np.repeat(np.arange(len(values)), [n for _, n in values])))


def _joined(parts: list[np.ndarray]) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


def _term_rows(held: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, term, n): documents of a task, or of a stretch of it, that hold a term."""
        counts: dict[str, Counter] = defaultdict(Counter)

        def emit() -> pa.RecordBatch:
            parts = [(lang, list(own), np.fromiter(own.values(), np.int64, len(own))) for lang, own in counts.items() if own]
            counts.clear()
            return pa.RecordBatch.from_arrays([_repeated([(lang, len(n)) for lang, _, n in parts]), pa.array([t for _, own, _ in parts for t in own], pa.binary()).cast(pa.string()), _joined([n for *_, n in parts])], ["lang", "term", "n"])

        for batch in slices_of_bytes(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                seen: set[bytes] = set()
                for some in word_lists(text, LETTERS):
                    seen.update(some)
                counts[lang].update(seen)
            if sum(map(len, counts.values())) > held:
                yield emit()
        yield emit()

    return rows


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """(lang, term) that at least min_docs rows of docs (lang, text) hold."""
    rows = docs.select("lang", "text").mapInArrow(_term_rows(HELD), "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def _automata(terms: list[tuple[str, str]]) -> dict[str, ahocorasick.Automaton]:
    """One for each language, of the terms between blanks; a hit's value is the term's number."""
    found: dict[str, ahocorasick.Automaton] = defaultdict(ahocorasick.Automaton)
    for number, (lang, term) in enumerate(terms):
        found[lang].add_word(f" {term} ", number)
    for automaton in found.values():
        automaton.make_automaton()
    return dict(found)


def _posting_rows(block):
    """(lang, source, term, n): occurrences of a block's terms in the documents of a task, or of a stretch of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value
        automata, names = _automata(terms), pa.array([term for _, term in terms], pa.string())
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def emit() -> pa.RecordBatch:
            parts = [(group, np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))) for group, found in counts.items() if found]
            counts.clear()
            langs, sources = (_repeated([(group[i], len(n)) for group, _, n in parts]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([langs, sources, names.take(_joined([at for _, at, _ in parts])), _joined([n for *_, n in parts])], ["lang", "source", "term", "n"])

        for batch in slices_of_bytes(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch), strict=True):
                if lang in automata:
                    for piece in text_pieces(text, LETTERS):
                        counts[lang, source].update(map(itemgetter(1), automata[lang].iter((b" %b " % piece).decode())))
            if sum(map(len, counts.values())) > HELD:
                yield emit()
        yield emit()

    return rows


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) of all n > 0, for docs (lang, source, text) and a stored table of kept terms. Each block of terms is one pass over the texts."""
    size = kept.agg(F.sum(F.octet_length("term") + F.octet_length("lang") + 16)).first()[0] or 0
    blocks = -(-size // (BLOCK_BYTES // 2)) or 1
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    spark, passes = docs.sparkSession, []
    for block in range(blocks):
        terms = spark.sparkContext.broadcast([(r.lang, r.term) for r in numbered.where(F.col("block") == block).collect()])  # about half of BLOCK_BYTES
        passes.append(docs.mapInArrow(_posting_rows(terms), "lang string, source string, term string, n long"))
    return reduce(DataFrame.union, passes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly."""
    over = (n + 5).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    under = total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * 5
    return F.call_function("div", over, under) + 1


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): of each group and every other one of its language, what its own postings add, in both directions, and once
    what all terms have without postings."""
    for batch in batches:
        for row in batch.to_pylist():
            order = np.argsort(np.array(row["shares"] or [], np.int64))
            p, n = (np.array(row[c] or [], np.int64)[order] for c in ("shares", "terms"))
            z = np.array([g["p0"] for g in row["groups"]], np.int64)
            before, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
            at = np.searchsorted(p, z)
            away = (z * before[at] - sums[at]) + (sums[-1] - sums[at] - z * (before[-1] - before[at]))
            apart = np.abs(z - row["p0"])
            own = away - before[-1] * apart
            others = [i for i, g in enumerate(row["groups"]) if g["source"] != row["source"]]
            names = [row["groups"][i]["source"] for i in others]
            mine = [row["source"]] * len(names)
            value = np.concatenate([(row["v"] * apart + own)[others], own[others]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(value), pa.string()), pa.array(mine + names, pa.string()), pa.array(names + mine, pa.string()), pa.array(value)],
                ["lang", "source", "item", "value"],
            )


def _flat(lists: pa.ListArray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of lists of (at, p, p0): places in the tile, p, p0, all in one, and where each list begins."""
    entries = lists.flatten()
    at, p, p0 = (entries.field(n).to_numpy(zero_copy_only=False) for n in ("at", "p", "p0"))
    return at % tile, p, p0, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).tolist()


def _tile_rows(tile: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, a, b, value): corrections for terms of both groups, by tile. Rows come by language and tile."""
        key, sums = None, None

        def emit() -> pa.RecordBatch:
            lang, left, right = key
            i, j = np.nonzero(sums)
            a, b, value = i + left * tile, j + right * tile, sums[i, j]
            if left == right:
                a, b, value = a[i != j], b[i != j], value[i != j]
            else:
                a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(value)], ["lang", "a", "b", "value"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "left", "right")), strict=True))
            (i, p, y, upper), (j, q, z, lower) = (_flat(batch.column(side), tile) for side in ("ls", "rs"))
            for row, own in enumerate(keys):
                if own != key:
                    if key:
                        yield emit()
                    key, sums = own, np.zeros((tile, tile), np.int64)
                a, b = slice(upper[row], upper[row + 1]), slice(lower[row], lower[row + 1])
                p_, y_ = p[a, None], y[a, None]
                sums[i[a, None], j[b]] += np.abs(p_ - q[b]) - np.abs(p_ - z[b]) - np.abs(y_ - q[b]) + np.abs(y_ - z[b])
        if key:
            yield emit()

    return rows


def divergence(
    docs: DataFrame, min_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group the other sources of its language by falling difference (part pair), and the top
    terms of which it has more than the language (part term)."""
    slim = _slim(docs, text, lang, source)
    kept = materialize(kept_terms(slim, min_docs), "kept_terms")
    counts = materialize(term_counts(slim, kept), "term_counts")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    p0 = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)
    by_place = Window.partitionBy("lang").orderBy("source")
    groups = materialize(groups.withColumn("p0", p0).withColumn("at", F.row_number().over(by_place).cast("long") - 1), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    shares = materialize(shares.select("lang", "source", "term", "at", "n", "p", "p0"), "shares")

    of_langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v")), "lang")
    of_langs = of_langs.select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("q"))
    more = shares.join(of_langs, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    sets = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("held"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("groups"))
    rows = groups.select("lang", "source", "p0", "v").join(sets, ["lang", "source"], "left").join(peers, "lang")
    rows = rows.select("lang", "source", "p0", "v", F.col("held.p").alias("shares"), F.col("held.n").alias("terms"), "groups")
    alone = rows.mapInArrow(_group_rows, "lang string, source string, item string, value long")

    part = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-kept.count() // PART_TERMS)))).alias("part")
    lists = shares.groupBy("lang", "term", F.floor(F.col("at") / TILE).cast("long").alias("tile")).agg(F.collect_list(F.struct("at", "p", "p0")).alias("ps"))
    lists = materialize(lists, "posting_lists")
    left, right = (lists.select("lang", "term", F.col("tile").alias(tile), F.col("ps").alias(ps)) for tile, ps in (("left", "ls"), ("right", "rs")))
    tiles = left.join(right, ["lang", "term"]).where("left <= right").select("lang", "left", "right", part, "ls", "rs")
    tiles = tiles.repartition("lang", "left", "right", "part").sortWithinPartitions("lang", "left", "right")
    both = tiles.mapInArrow(_tile_rows(TILE), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "source", "at")
    both = both.join(names.withColumnRenamed("at", "a"), ["lang", "a"]).join(names.select("lang", F.col("source").alias("item"), F.col("at").alias("b")), ["lang", "b"])

    pairs = alone.unionByName(both.select("lang", "source", "item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
