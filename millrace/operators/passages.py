"""Strings sought in texts through hashes of their beginnings and of themselves, and excerpts verified against pages.

1. Each string sets three bits of a bitmap of fixed size: of its first code points, as many as the largest of SIZES that it has; of those as many
   as the largest power of two that it has; of all of it. The lengths of strings are kept beside the bitmap.
2. Texts are read once. A place whose first code points have their bit is asked for the power of two, and then for each length below the next
   power; what has all its bits is given as it stands in the text.
3. What is given is joined to the strings by equality, so a bit that another string has set costs a row and no more. All places are found, those
   that overlap too.

Strings and texts stay in tables throughout, and texts are not moved; the driver holds the bitmap and the lengths. Null and empty strings stand
nowhere; null texts hold nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import RunHashes, slices_of_bytes
from ..functions.udfs import excerpt_pieces, forms_of_pages
from ..session import stored

#: Code points of beginnings, powers of two, and bits of the bitmap.
SIZES = (8, 4, 2, 1)
BITS = 1 << 24
#: The kind of hashes of whole strings, so that a string does not stand where a longer one begins.
WHOLE = 1
#: Bytes of texts whose places are looked at together, and code points of strings given together.
TEXT_BYTES, FOUND_POINTS = 1 << 20, 1 << 20


def _beginnings(length: int) -> tuple[int, int]:
    """The sizes of beginnings at which a string of this length sets bits."""
    return next(n for n in SIZES if n <= length), 1 << length.bit_length() - 1


def _string_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, gram) of the runs of strings that set bits."""
    for batch in slices_of_bytes(batches, "string"):
        runs = RunHashes(batch.column("string").to_pylist())
        length = runs.ends - runs.starts
        for n in np.unique(length).tolist():
            at = runs.starts[length == n]
            grams = np.unique(np.concatenate([runs.at(at, n, WHOLE), *(runs.at(at, size) for size in _beginnings(n))]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), n, np.int64)), pa.array(grams)], ["length", "gram"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Which of BITS remainders the grams have, as bytes of eight bits."""
    bit = F.pmod(F.col("gram"), F.lit(BITS))
    rows = grams.groupBy((bit / 32768).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for row in rows:
        out[row.bucket * 4096 : row.bucket * 4096 + 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _held(gram: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the grams have their bit."""
    bit = gram & (8 * len(bitmap) - 1)  # the remainder, as BITS is a power of two
    return np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)


def _runs_with_bits(runs: RunHashes, lengths: list[int], bitmap: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the runs within a text, of these lengths, that have all their bits."""
    below: dict[int, dict[int, list[int]]] = {}
    for n in lengths:
        base, power = _beginnings(n)
        below.setdefault(base, {}).setdefault(power, []).append(n)

    def kept(at: np.ndarray, room: np.ndarray, size: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        inside = np.flatnonzero(room >= size)
        some = inside[_held(runs.at(at[inside], size, kind), bitmap)]
        return at[some], room[some]

    for base, powers in below.items():
        begun = _held(runs.everywhere(base), bitmap)
        room = runs.ends[runs.number(begun)] - begun
        begun, room = begun[room >= base], room[room >= base]
        for power, whole in powers.items():
            at = (begun, room) if power == base else kept(begun, room, power)
            for n in whole if len(at[0]) else ():
                yield n, kept(*at, n, WHOLE)[0]


def _string_places(lengths: list[int], bitmap: np.ndarray, read: Callable):
    def given(batch: pa.RecordBatch, runs: RunHashes, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        strings = [runs.whole[i : i + n] for n, at in found for i in at.tolist()]
        at = np.concatenate([at for _, at in found])
        number = runs.number(at)
        return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), batch.column("place").take(pa.array(number)), pa.array(at - runs.starts[number])], ["string", "place", "start"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(read(batches), limit=TEXT_BYTES):
            runs = RunHashes([t or "" for t in batch.column("text").to_pylist()])
            found, size, most = [], 0, FOUND_POINTS
            for n, at in _runs_with_bits(runs, lengths, bitmap):
                step = max(1, most // n)
                for i in range(0, len(at), step):
                    found.append((n, at[i : i + step]))
                    size += n * len(found[-1][1])
                    if size >= most:
                        yield given(batch, runs, found)
                        found, size = [], 0
            if found:
                yield given(batch, runs, found)

    return rows


def found_strings(texts: DataFrame, strings: DataFrame, read: Callable = iter, kind: str | None = None) -> DataFrame:
    """[J-14, J-15, J-16] (string, place, start) of every place, from 0 in code points, at which a string of strings (string) stands in a text of
    texts (place, text); place is a key of any type. Other tables are texts by `read`, which makes batches (place, text) of theirs within a task;
    `kind` is then the type of place."""
    wanted = stored(strings.select("string").where("coalesce(string, '') <> ''").distinct(), "strings")
    grams = stored(wanted.mapInArrow(_string_grams, "length long, gram long"), "string_grams")
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())
    if not lengths:
        texts = texts.limit(0)
    kind = kind or texts.schema["place"].dataType.simpleString()
    given = texts.mapInArrow(_string_places(lengths, _bitmap(grams), read), f"string string, place {kind}, start long")
    return given.join(wanted, "string").select("string", "place", "start")


def _page_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, page, form, text, ends): the comparable forms of pages with what follows, and where the page itself ends."""
    for batch in slices_of_bytes(batches):
        rows, forms, texts, ends = [], [], [], []
        for row, (joined, stands, end) in enumerate(forms_of_pages(batch.column("text").to_pylist(), batch.column("following").to_pylist())):
            for form, one in enumerate((joined,) if joined == stands else (joined, stands)):
                rows.append(row)
                forms.append(form)
                texts.append(one)
                ends.append(end)
        at = pa.array(rows, pa.int64())
        columns = {"source": batch.column("source").take(at), "page": batch.column("page").take(at), "form": pa.array(forms, pa.int32()), "text": pa.array(texts, pa.string()), "ends": pa.array(ends, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _placed_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, text) of the forms of pages."""
    for batch in _page_forms(batches):
        names = ["source", "page", "form", "ends"]
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([batch.column(n) for n in names], names), batch.column("text")], ["place", "text"])


def page_forms(pages: DataFrame) -> DataFrame:
    """(source, page, form, text, ends): the one or two comparable forms of pages (source, page, text, following)."""
    kinds = dict(pages.dtypes)
    return pages.select("source", "page", "text", "following").mapInArrow(_page_forms, f"source {kinds['source']}, page {kinds['page']}, form int, text string, ends long")


def pieces_stand(pieces: Column, text: Column, ends: Column) -> Column:
    """Whether pieces stand in a text in their order without overlap, the first beginning before `ends`. The first place beyond the piece before is
    the best for each."""
    place = lambda piece, at: F.call_function("locate", piece, text, at)
    # from 1; once a piece is missing 0, from which nothing is found
    after = F.aggregate(pieces, F.lit(1), lambda at, p: F.when(place(p, at) > 0, place(p, at) + F.length(p)).otherwise(F.lit(0)))
    return place(pieces[0], F.lit(1)).between(1, ends) & (after > 0)


def located_excerpts(excerpts: DataFrame, pages: DataFrame) -> DataFrame:
    """[F-09] (excerpt, source, page) of the pages, of pages (source, page, text, following), on which an excerpt of excerpts (excerpt) stands.

    An excerpt's pieces, parted by ellipses, must stand in their order without overlap; the first begins on the page, the others may run on
    into the following one. Pieces have eight comparable characters at least.
    """
    kinds = dict(pages.dtypes)
    place = f"struct<source: {kinds['source']}, page: {kinds['page']}, form: int, ends: bigint>"
    pieces = excerpts.select("excerpt").distinct().withColumn("pieces", excerpt_pieces("excerpt")).where(F.size("pieces") > 0)
    pieces = stored(pieces.select("excerpt", F.size("pieces").alias("n"), F.posexplode("pieces").alias("nth", "string")), "pieces")
    found = pieces.join(found_strings(pages.select("source", "page", "text", "following"), pieces, _placed_forms, place), "string").select("excerpt", "n", "place", F.struct("nth", "start", (F.col("start") + F.length("string")).alias("stop")).alias("hit"))
    hits = F.array_sort(F.collect_list("hit"))
    # by piece and start: the first place of the awaited piece beyond the last one is the best
    begun = F.struct(F.lit(0).alias("nth"), F.lit(0).cast("long").alias("at"))
    step = lambda s, h: F.when((h["nth"] == s["nth"]) & (h["start"] >= s["at"]), F.struct((s["nth"] + 1).alias("nth"), h["stop"].alias("at"))).otherwise(s)
    chains = found.groupBy("excerpt", "n", "place").agg(hits.alias("hits")).where((F.col("hits")[0]["nth"] == 0) & (F.col("hits")[0]["start"] < F.col("place.ends")))
    return chains.where(F.aggregate("hits", begun, step)["nth"] == F.col("n")).select("excerpt", "place.source", "place.page").distinct()
