"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words; only the whole document has a label. Every passage is encoded by its
character classes, its repetition and a hashed mean of word vectors, and a learned layer. Gated attention weighs the passages of a
document (softmax of w . (tanh(V h) * sigmoid(U h))), and the weighted mean is scored. Weights are learned in numpy by Adam from a
bounded sample of labelled documents; scoring is a pass over all texts. One passage of junk in a long clean text can so weigh as
much as it must, and the encoding never cuts a text short.

A null or empty text is one passage without words, all features 0. Rows that repeat are returned as often as they come, a null id as
it is. Only the text enters a score. Other columns are not read. Without labelled documents every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, slices_of_bytes, texts_of
from .quality_rules import labelled_sample

PASSAGE_WORDS, HASHED, TABLE = 64, 16, 4096
_vectors = np.random.default_rng(11).standard_normal((TABLE, HASHED)).astype(np.float32)

#: Byte classes: white space, upper, lower, digit, exclamation, bar, other symbols, other punctuation, bytes over 127.
CLASSES = 9
_class = np.full(256, 8, np.uint8)
_class[:128] = 7
_class[list(b" \t\n\v\f\r")] = 0
_class[65:91], _class[97:123], _class[48:58] = 1, 2, 3
_class[ord("!")], _class[ord("|")] = 4, 5
_class[list(b"#*$%&<>")] = 6
WIDTH = CLASSES + 4 + HASHED

_P = np.uint64(0x9E3779B97F4A7C15)
_Pinv = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of all texts in order, and the number of passages of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kinds = _class[data]
    inside = np.concatenate([[False], kinds != 0])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    stops = np.flatnonzero(inside[:-1] & ~inside[1:])
    stops = stops[stops > 0] if len(stops) > len(starts) else stops
    words = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    total = int(passages.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if not len(starts):
        return out, passages
    # the passage of each word, counted over all texts
    first_passage = np.cumsum(passages) - passages
    text_of = np.repeat(np.arange(len(texts)), words)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passage = first_passage[text_of] + within // PASSAGE_WORDS
    heads = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    used, sizes = passage[heads], np.diff(np.append(heads, len(starts))).astype(np.float32)
    # a word's hash: the part of a running polynomial between its ends, moved to the origin
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * _powers(_P, len(data)), dtype=np.uint64)])
    hashes = (running[stops] - running[starts]) * _powers(_Pinv, len(data))[starts]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    # classes: counts between the first bytes of passages
    head_bytes = starts[heads]
    letters = np.zeros((len(heads), CLASSES), np.float32)
    for c in range(1, CLASSES):
        letters[:, c] = np.add.reduceat((kinds == c).astype(np.int32), head_bytes)
    chars = letters.sum(axis=1)
    letters[:, 0] = chars / sizes / 10
    letters[:, 1:] /= chars[:, None]
    same = np.zeros(len(starts), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    keyed = np.sort(passage.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.concatenate([[True], keyed[1:] != keyed[:-1]])
    distinct = np.bincount((keyed >> np.uint64(40)).astype(np.int64)[new], minlength=total)[used]
    mean = np.add.reduceat(_vectors[(hashes % np.uint64(TABLE)).astype(np.int64)], heads, axis=0) / sizes[:, None]
    out[used] = np.concatenate([letters, (np.add.reduceat(same, heads) / sizes)[:, None], (distinct / sizes)[:, None], (sizes / PASSAGE_WORDS)[:, None], np.ones((len(heads), 1), np.float32), mean], axis=1)
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Encoder, gated attention and scorer. weights: E, e (layer), V, U, w (attention), c, c0 (scorer)."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH, np.float32))

    def _forward(self, x: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, heads = self.weights, np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), sizes))
        a = s / np.repeat(np.add.reduceat(s, heads), sizes)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["c0"][0])}

    def score(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(sizes), 0.5)
        return self._forward((x - self.mean) / self.scale, sizes)["y"].astype(np.float64)

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 30, width: int = 16, gate: int = 8, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = ((x - self.mean) / self.scale).astype(np.float32)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = self.weights = {"E": draw(WIDTH, width), "e": np.zeros(width, np.float32), "V": draw(width, gate), "U": draw(width, gate), "w": draw(gate), "c": draw(width), "c0": np.zeros(1, np.float32)}
        m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
        starts = np.cumsum(sizes) - sizes
        for _ in range(epochs):
            order = r.permutation(len(sizes))
            for at in range(0, len(order), 256):
                bags = order[at : at + 256]
                n = sizes[bags]
                rows = np.repeat(starts[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for k, grad in self._gradients(x[rows], n, y[bags]).items():
                    grad = grad + decay * p[k]
                    step_k = step + 1
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - (rate * (m[k] / (1 - 0.9**step_k)) / (np.sqrt(v[k] / (1 - 0.999**step_k)) + 1e-8)).astype(np.float32)
                step += 1
        return self

    def _gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self._forward(x, sizes)
        heads = np.cumsum(sizes) - sizes
        dlogit = (f["y"] - y) / len(y)
        dz = np.repeat(dlogit[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, heads), sizes))
        gated = f["t"] * f["g"]
        dgated = ds[:, None] * p["w"]
        dt, dg = dgated * f["g"] * (1 - f["t"] ** 2), dgated * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": gated.T @ ds, "c": f["z"].T @ dlogit, "c0": np.array([dlogit.sum()])}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices_of_bytes(batches):
        x, sizes = encode_passages(texts_of(batch))
        parts = np.split(x, np.cumsum(sizes)[:-1]) if len(sizes) else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, held_out: int = 5) -> AttentionModel:
    """A model from at most `sample` labelled documents whose bucket of `held_out` is not 0."""
    sampled = labelled_sample(docs, labels, sample, held_out).withColumn("quality", F.col("quality").cast("int"))
    kind = sampled.schema["doc_id"].dataType.simpleString()
    rows = sampled.mapInArrow(_features, f"doc_id {kind}, quality int, x binary").toArrow().to_pandas().sort_values(["doc_id", "x"], kind="stable")
    if not len(rows):
        return AttentionModel()
    parts = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in rows["x"]]
    return AttentionModel().fit(np.concatenate(parts), np.array([len(p) for p in parts]), rows["quality"].to_numpy(np.float32))


def _scorer(model: AttentionModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of_bytes(batches):
            scores = model.score(*encode_passages(texts_of(batch))) if batch.num_rows else np.zeros(0)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)} | {"score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return score


def score_documents(docs: DataFrame, model: AttentionModel, keep: tuple[str, ...] = (), threshold: float = 0.3, held_out: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, and the columns named in keep as they are."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    scored = slim.mapInArrow(_scorer(model), f"{fields}, score double")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), held_out) == 0).alias("held_out"), "score", predicted.alias("predicted"), *(["text"] if keep else []), *keep)
