"""Scores of texts by a log-bilinear neural model, beside a smoothed unigram model of all training words.

Counts. Every training text gives its words' 64-bit hashes and one end token; they are counted by task first, then by shuffle, so
counts cover the whole corpus and grow with it. The most frequent 2**18 counts, a fixed bound, go to every task. Other words of a text
are rare: (row, hash, times) joins the counts by hash and is summed by row.

Model. A unit is one of the most frequent words or, for all others, a class of endings. Units are dealt into 64 groups of 64. A context,
the four units before, gives r = sum of C_i * R[unit_i]; the unit's group has logits A r + a, its place in the group Q r + b. Both levels
are trained by noise-contrastive estimation against the unigram distribution, in numpy; the loss takes the expectation over noise samples
rather than drawing them, so that all of it is matrix products. A bounded sample of the training texts gives first weights on the driver.
From these, every training text is learned from once: texts are dealt to parts by a hash of id and text, each part is fitted in the
order of that hash, and the parts' weights are averaged by tokens, as a tree of 64 to a task. How many parts there are follows from the
number of tokens, and neither partitions nor batches of the input change the result. Driver and tasks hold one set of weights at a time,
and averaging tasks one for each of 64 parts.

Scoring. Batched matrix products give the logits of all groups and, group by group, of all places, so both levels are normalised
exactly. A word outside the vocabulary has its class's probability times (c + 0.1) / (words of that class + 0.1 * (its types + 1)): with one
unseen type to each class, as to the unigram model, the probabilities of all words sum to one.

A-Z are lower-cased. A null or empty text is its end token alone. Rows that repeat are counted, learned from and scored as often as they
come (rows equal in id and text by the same part, whose memory they don't fill), a null id counts as the empty id for choosing held-out
rows and is returned as it is. Other columns are not read. Without training texts all counts are 0.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize, slices, texts_of

WORD_UNITS, CLASS_UNITS, GROUPS = 2047, 2048, 64
UNITS = 4096  # the last one of WORD_UNITS + 1 stands for the end token
PLACES = UNITS // GROUPS
CONTEXT, DIMENSIONS, NOISE, BATCH, RATE = 4, 16, 16, 8192, 0.07
FREQUENT, COUNTED_AT_ONCE = 1 << 18, 400_000
#: What squared gradients start from.
FIRST_SQUARE = 0.6
#: Expected tokens of the driver's first sample; tokens that are fitted at once; tokens of a part, more where there would be over MOST_PARTS.
WARM_TOKENS, FITTED_AT_ONCE, PART_TOKENS, MOST_PARTS = 400_000, 1 << 16, 2_000_000, 1 << 16
SCORED_AT_ONCE = 1 << 15
#: Parts whose weights one task averages.
AVERAGED = 64
END = 0x0E4D_0E4D_0E4D_0E4D
LOG10 = np.log(10.0)


def tail_class(word: bytes) -> int:
    """The class of a word outside the vocabulary: by its last three bytes before punctuation."""
    return zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % CLASS_UNITS


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _signed(x: list[int]) -> np.ndarray:
    return np.array(x, np.uint64).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    ends = 0

    def out() -> pa.RecordBatch:
        words = list(counts)
        hashes = _signed([*map(word_hash, words), END] if ends else [word_hash(w) for w in words])
        kinds = [*map(tail_class, words), *([0] if ends else [])]
        numbers = [*counts.values(), *([ends] if ends else [])]
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(kinds, pa.int32()), pa.array(numbers, pa.int64())], ["hash", "kind", "times"])

    for batch in slices(batches):
        for text in texts_of(batch):
            for word in text.lower().split():
                counts[word] = counts.get(word, 0) + 1
            ends += 1
        if len(counts) > COUNTED_AT_ONCE:
            yield out()
            counts.clear()
            ends = 0
    if ends:
        yield out()


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, kind, times) of every distinct word and of the end token. docs: (text)."""
    rows = docs.select("text").mapInArrow(_count_words, "hash long, kind int, times long")
    return rows.groupBy("hash").agg(F.min("kind").alias("kind"), F.sum("times").alias("times"))


@dataclass
class Vocabulary:
    """What scoring knows of the counts: totals, the frequent counts by sorted hash, units, and the mass of each class."""

    tokens: int
    types: int
    hashes: np.ndarray
    times: np.ndarray
    unit_hashes: np.ndarray
    unit_numbers: np.ndarray
    class_logs: np.ndarray
    order: np.ndarray  # the unit at each place; units of like frequency go to different groups

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Counts; -1 where a word isn't frequent."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.times[at], -1)

    def units(self, hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units of words, and whether a word is outside the vocabulary."""
        unit = WORD_UNITS + 1 + kinds
        if len(self.unit_hashes):
            at = np.minimum(np.searchsorted(self.unit_hashes, hashes), len(self.unit_hashes) - 1)
            known = self.unit_hashes[at] == hashes
            unit = np.where(known, self.unit_numbers[at], unit)
        outside = unit > WORD_UNITS
        return self.order[unit].astype(np.int64), outside


def frequent_words(counts: DataFrame) -> pd.DataFrame:
    """The words whose counts reach the least level, in steps of a sixteenth of a doubling, at which they are at most FREQUENT; found
    from the number of words at each level, so that no task sends more than what is kept. Most frequent first."""
    levels = counts.groupBy(F.floor(F.log2("times") * 16).alias("level")).agg(F.count("*").alias("words"), F.min("times").alias("least")).toArrow().to_pandas()
    levels = levels.sort_values("level", ascending=False)
    fits = levels[levels["words"].cumsum() <= FREQUENT]
    least = int(fits["least"].min()) if len(fits) else 2**62
    found = counts.where(F.col("times") >= least).toArrow().to_pandas()
    return found.sort_values(["times", "hash"], ascending=[False, True])


def build_vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the number of training tokens of each place."""
    total = counts.agg(F.sum("times").alias("tokens"), F.count("*").alias("types")).first()
    top = frequent_words(counts)
    classes = counts.where(F.col("hash") != END).groupBy("kind").agg(F.sum("times").alias("times"), F.count("*").alias("types")).toArrow().to_pandas()
    mass, types = np.zeros(CLASS_UNITS), np.zeros(CLASS_UNITS)
    mass[classes["kind"]], types[classes["kind"]] = classes["times"], classes["types"]
    words = top[top["hash"] != END].head(WORD_UNITS)
    np.subtract.at(mass, words["kind"].to_numpy(), words["times"].to_numpy())
    np.subtract.at(types, words["kind"].to_numpy(), 1)
    seen = np.zeros(UNITS)
    seen[: len(words)] = words["times"]
    seen[WORD_UNITS] = top.loc[top["hash"] == END, "times"].sum()
    seen[WORD_UNITS + 1 :] = mass
    ranked = np.argsort(-seen, kind="stable")
    order = np.zeros(UNITS, np.int64)
    order[ranked] = (np.arange(UNITS) % GROUPS) * PLACES + np.arange(UNITS) // GROUPS
    at_place = np.zeros(UNITS)
    at_place[order] = seen
    unit_hashes = np.append(words["hash"].to_numpy(np.int64), np.int64(END))
    numbers = np.append(np.arange(len(words)), WORD_UNITS)
    by = np.argsort(unit_hashes)
    top = top.sort_values("hash")
    vocabulary = Vocabulary(
        int(total["tokens"] or 0), int(total["types"]), top["hash"].to_numpy(np.int64), top["times"].to_numpy(np.int64), unit_hashes[by], numbers[by],
        np.log10(mass + 0.1 * (types + 1)), order,
    )
    return vocabulary, at_place


@dataclass
class Texts:
    """The tokens of some texts: words by number, texts' lengths, and each distinct word's hash and class."""

    tokens: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray


def read_texts(texts: list[bytes]) -> Texts:
    split = [t.lower().split() for t in texts]
    numbers: dict[bytes, int] = {}
    for words in split:
        for word in words:
            if word not in numbers:
                numbers[word] = len(numbers) + 1
    get = numbers.__getitem__
    lengths = np.array([len(w) + 1 for w in split], np.int64)
    tokens = np.zeros(int(lengths.sum()), np.int64)  # 0 is the end token
    at = 0
    for words in split:
        tokens[at : at + len(words)] = np.fromiter(map(get, words), np.int64, len(words))
        at += len(words) + 1
    return Texts(tokens, lengths, _signed([END, *map(word_hash, numbers)]), np.array([0, *map(tail_class, numbers)], np.int64))


def contexts(units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token; UNITS before a text's start."""
    padded = np.full(len(units) + CONTEXT * len(lengths), UNITS, np.int64)
    at = np.arange(len(units)) + CONTEXT * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    padded[at] = units
    return np.stack([padded[at - i - 1] for i in range(CONTEXT)], axis=1)


def _noise_errors(margins: np.ndarray, noise: np.ndarray, true: np.ndarray) -> np.ndarray:
    """The slope of the noise-contrastive loss by logits, noise being drawn in expectation: noise times its chance to be taken for a word,
    less, at the true one, the chance that it is taken for noise. margins: log(noise) - logits; they are overwritten."""
    rows = np.arange(len(true))
    with np.errstate(over="ignore"):
        taken = np.exp(margins, out=margins)
    taken += 1
    at_true = taken[rows, true]
    np.divide(noise, taken, out=taken)
    taken[rows, true] -= 1 - 1 / at_true
    return taken


def _log_softmax(logits: np.ndarray, taken: np.ndarray, safe: bool) -> np.ndarray:
    """The log probability of the taken place of each row; safe: exponentials do not overflow. logits are overwritten."""
    if not safe:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(taken)), taken].astype(np.float64)
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where each run of them starts."""
    order = np.argsort(keys.astype(np.int16), kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))


class LogBilinear:
    """Weights R, C, A, a, Q, b and the squared gradients that set their step sizes."""

    def __init__(self, at_place: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (0.3 * r.standard_normal(shape)).astype(np.float32)
        p = at_place + 1.0
        group = p.reshape(GROUPS, PLACES).sum(axis=1)
        self.group_noise = (NOISE * group / group.sum()).astype(np.float32)
        self.place_noise = (NOISE * p.reshape(GROUPS, PLACES) / group[:, None]).astype(np.float32)
        self.log_place_noise = np.log(self.place_noise).ravel()
        self.weights = {
            "R": draw(UNITS + 1, DIMENSIONS), "C": np.full((CONTEXT, DIMENSIONS), 1 / CONTEXT, np.float32), "A": 0.1 * draw(GROUPS, DIMENSIONS), "a": np.log(self.group_noise / NOISE),
            "Q": 0.1 * draw(UNITS, DIMENSIONS), "b": np.log(self.place_noise / NOISE).ravel(),
        }
        self.squares = {k: np.full(w.shape, FIRST_SQUARE, np.float32) for k, w in self.weights.items()}

    def copy(self) -> LogBilinear:
        other = copy.copy(self)
        other.weights, other.squares = ({k: w.copy() for k, w in kept.items()} for kept in (self.weights, self.squares))
        return other

    def _update(self, name: str, slope: np.ndarray) -> None:
        self.squares[name] += slope * slope
        self.weights[name] -= RATE * slope / np.sqrt(self.squares[name])

    def _step(self, context: np.ndarray, unit: np.ndarray) -> None:
        w, n = self.weights, len(unit)
        order, starts = _runs(unit // PLACES)
        unit, context = unit[order], context[order]
        group, place = unit // PLACES, unit % PLACES
        embedded = w["R"][context]
        r = np.einsum("ncd,cd->nd", embedded, w["C"])
        errors = _noise_errors(np.log(self.group_noise) - w["a"] - r @ w["A"].T, self.group_noise, group)
        dr = errors @ w["A"]
        self._update("A", errors.T @ r)
        self._update("a", errors.sum(axis=0))
        # each group's own places
        shift = self.log_place_noise - w["b"]
        dq, db = np.zeros_like(w["Q"]), np.zeros_like(w["b"])
        for at, end in pairwise([*starts.tolist(), n]):
            g = int(group[at])
            rows = slice(g * PLACES, (g + 1) * PLACES)
            q, own = w["Q"][rows], r[at:end]
            errors = _noise_errors(shift[rows] - own @ q.T, self.place_noise[g], place[at:end])
            dr[at:end] += errors @ q
            dq[rows], db[rows] = errors.T @ own, errors.sum(axis=0)
        self._update("Q", dq)
        self._update("b", db)
        self._update("C", np.einsum("ncd,nd->cd", embedded, dr))
        at, slopes, spread = context.ravel(), np.empty((DIMENSIONS, UNITS + 1)), dr.T.copy()
        for d in range(DIMENSIONS):
            slopes[d] = np.bincount(at, np.multiply.outer(spread[d], w["C"][:, d]).ravel(), UNITS + 1)
        self._update("R", slopes.T.astype(np.float32))

    def fit(self, units: np.ndarray, lengths: np.ndarray, passes: int = 1, seed: int = 1) -> None:
        random = np.random.default_rng(seed)
        context = contexts(units, lengths)
        for _ in range(passes):
            order = random.permutation(len(units))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                self._step(context[rows], units[rows])

    def log10_probability(self, units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each token, given the units before it; over all units it sums to one."""
        w, out = self.weights, np.zeros(len(units))
        context = contexts(units, lengths)
        largest = np.sqrt(max((w["A"] ** 2).sum(axis=1).max(), (w["Q"] ** 2).sum(axis=1).max()))
        most = max(abs(w["a"]).max(), abs(w["b"]).max())
        for at in range(0, len(units), SCORED_AT_ONCE):
            unit = units[at : at + SCORED_AT_ONCE]
            order, starts = _runs(unit // PLACES)
            unit, near = unit[order], context[at : at + SCORED_AT_ONCE][order]
            r = sum(w["R"][near[:, i]] * w["C"][i] for i in range(CONTEXT))
            # no logit is larger; under 80 its exponential is a float32
            safe = largest * np.sqrt((r * r).sum(axis=1).max()) + most < 80
            logs = _log_softmax(r @ w["A"].T + w["a"], unit // PLACES, safe)
            for start, end in pairwise([*starts.tolist(), len(unit)]):
                g = int(unit[start]) // PLACES
                rows = slice(g * PLACES, (g + 1) * PLACES)
                logs[start:end] += _log_softmax(r[start:end] @ w["Q"][rows].T + w["b"][rows], unit[start:end] % PLACES, safe)
            out[at + order] = logs / LOG10
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()]).astype(np.float32)

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k, w in self.weights.items():
            self.weights[k] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size


def _average(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (part, tokens, weights) become one, in the order of their parts."""
    pdf = pdf.sort_values("part")
    total = sum(t * np.frombuffer(w, np.float32).astype(np.float64) for t, w in zip(pdf["tokens"], pdf["weights"], strict=True))
    tokens = pdf["tokens"].sum()
    return pd.DataFrame({"part": [int(key[0])], "tokens": [tokens], "weights": [(total / tokens).astype(np.float32).tobytes()]})


FITTED = "part int, tokens double, weights binary"


def _fitter(first: LogBilinear):
    """A row of weights for each part; rows (part, units) come part by part."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, model, seen, held, waiting = None, first, 0, [], 0

        def learn() -> None:
            model.fit(np.concatenate(held).astype(np.int64), np.array([len(h) for h in held]), seed=seen)

        def fitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(seen)]), pa.array([model.flat().tobytes()], pa.binary())], ["part", "tokens", "weights"])

        for batch in slices(batches, 256):
            for row_part, units in zip(batch.column("part").to_pylist(), batch.column("units").to_pylist(), strict=True):
                if row_part != part or waiting >= FITTED_AT_ONCE:
                    if held:
                        learn()
                    seen, held, waiting = seen + waiting, [], 0
                if row_part != part:
                    if part is not None:
                        yield fitted()
                    part, model, seen = row_part, first.copy(), 0
                held.append(np.frombuffer(units, np.int16))
                waiting += len(held[-1])
        if part is not None:
            learn()
            seen += waiting
            yield fitted()

    return fit


def train(texts: DataFrame, at_place: np.ndarray) -> LogBilinear:
    """A model of texts: (key, units), key being a hash, units two bytes for each token. at_place: how many tokens each place has."""
    model, tokens = LogBilinear(at_place), int(at_place.sum())
    every = max(1, tokens // WARM_TOKENS)
    warm = texts.where(F.pmod(F.xxhash64("key", F.lit("warm")), F.lit(every)) == 0).select("units").toArrow().to_pandas()
    if len(warm):
        units = [np.frombuffer(b, np.int16).astype(np.int64) for b in sorted(warm["units"])]
        model.fit(np.concatenate(units), np.array([len(u) for u in units]), passes=2)
    parts = min(MOST_PARTS, -(-tokens // PART_TOKENS)) or 1
    dealt = texts.withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "key", "units")
    fitted = dealt.select("part", "units").mapInArrow(_fitter(model), FITTED)
    while parts > 1:
        parts = -(-parts // AVERAGED)
        fitted = fitted.groupBy(F.floor(F.col("part") / AVERAGED).cast("int").alias("part")).applyInPandas(_average, FITTED)
    for row in fitted.toArrow().to_pylist():
        model.set_flat(np.frombuffer(row["weights"], np.float32))
    return model


def _reader(vocabulary: Vocabulary):
    """What texts give without the model: sums over words whose counts are known here, units, and a row for each rare word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            read = read_texts(texts_of(batch))
            rows = np.repeat(np.arange(batch.num_rows), read.lengths)
            sums = lambda values: np.bincount(rows, values[read.tokens], batch.num_rows)  # noqa: B023, E731
            times = vocabulary.look_up(read.hashes)
            unit, outside = vocabulary.units(read.hashes, read.kinds)
            # what a word adds in any context, as far as its count is known here
            own = np.where(times >= 0, np.log10(np.maximum(times, 0) + 0.1), 0.0)
            shift = np.where(outside, own - vocabulary.class_logs[read.kinds], 0.0)
            units = unit.astype(np.int16)[read.tokens].tobytes()
            ends = 2 * np.cumsum(read.lengths)
            listed = [units[at:end] for at, end in pairwise([0, *ends.tolist()])]
            rare = np.flatnonzero((times < 0)[read.tokens])
            keyed, numbers = np.unique(rows[rare] * len(times) + read.tokens[rare], return_counts=True)
            n, m = batch.num_rows, len(keyed)
            row_ids = batch.column("row_id").to_numpy()
            nothing = lambda k, kind: pa.nulls(k, kind)
            columns = {"row_id": pa.array(np.concatenate([row_ids, row_ids[keyed // len(times)]]))}
            for name in ("doc_id", "key", "held_out"):
                columns[name] = pa.concat_arrays([batch.column(name), nothing(m, batch.column(name).type)])
            columns |= {
                "n_tokens": pa.concat_arrays([pa.array(read.lengths), nothing(m, pa.int64())]),
                "n_known": pa.concat_arrays([pa.array(sums((times > 0).astype(float)).astype(np.int64)), nothing(m, pa.int64())]),
                "base": pa.concat_arrays([pa.array(sums(own)), nothing(m, pa.float64())]),
                "outside": pa.concat_arrays([pa.array(sums(shift)), nothing(m, pa.float64())]),
                "units": pa.concat_arrays([pa.array(listed, pa.binary()), nothing(m, pa.binary())]),
                "hash": pa.concat_arrays([nothing(n, pa.int64()), pa.array(read.hashes[keyed % len(times)])]),
                "times": pa.concat_arrays([nothing(n, pa.int64()), pa.array(numbers.astype(np.int64))]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return read


def read_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of texts, whose n_tokens is not null, and rows of their rare words, whose times is not null. docs: (doc_id, text, held_out)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = docs.withColumns({"row_id": F.monotonically_increasing_id(), "key": F.xxhash64("doc_id", "text")})
    columns = f"row_id long, doc_id {kind}, key long, held_out boolean, n_tokens long, n_known long, base double, outside double, units binary, hash long, times long"
    return told.mapInArrow(_reader(vocabulary), columns)


def _scorer(model: LogBilinear):
    """The rows with column units replaced by model, the log10 probability of all units of a row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            listed = [np.frombuffer(b, np.int16) for b in batch.column("units").to_pylist()]
            lengths = np.array([len(u) for u in listed], np.int64)
            logs = model.log10_probability(np.concatenate(listed).astype(np.int64), lengths) if listed else np.zeros(0)
            sums = np.bincount(np.repeat(np.arange(len(listed)), lengths), logs, len(listed))
            at = batch.schema.get_field_index("units")
            yield batch.set_column(at, pa.field("model", pa.float64()), pa.array(sums))

    return score


def lm_scores(docs: DataFrame, held_out: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Rows whose bucket of `held_out` is 0 are scored but not learned from.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("held_out", bucket_of(F.col("doc_id"), held_out) == 0)
    counts = materialize(count_words(slim.where("not held_out")), "word_counts")
    vocabulary, at_place = build_vocabulary(counts)
    kind = slim.schema["doc_id"].dataType.simpleString()
    read = materialize(read_documents(slim, vocabulary), "texts")
    texts = read.where("n_tokens is not null")
    model = train(texts.where("not held_out").select("key", "units"), at_place)
    scored = texts.select("row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "outside", "units").mapInArrow(
        _scorer(model), f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, outside double, model double"
    )
    rare = read.where("times is not null").select("row_id", "hash", "times").join(counts.select("hash", F.col("times").alias("c")), "hash", "left")
    log = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    rest = rare.groupBy("row_id").agg(F.sum(log).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    whole = scored.join(rest, "row_id", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    mass = float(np.log10(vocabulary.tokens + 0.1 * (vocabulary.types + 1)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest") - F.col("n_tokens") * F.lit(mass)).alias("base_score"), (F.col("model") + F.col("outside") + F.col("rest")).alias("score"),
    )
