"""Document quality by a byte-level convolutional network in numpy (operator 8).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Bytes
are embedded, ``FILTERS`` filters of ``WIDTH`` bytes run over each chunk every
``STRIDE`` bytes, and each filter's largest answer in the chunk is kept. A
document's mean, largest and smallest answer over its chunks go through a hidden
layer to one probability. Training (Adam, cross-entropy with both classes
weighing the same) runs on the driver over a bounded sample of whole documents: at most
``max_docs`` labelled ones of each class (those with the smallest hash of their id), but
for texts over ``max_bytes``, with all their chunks. A pass shortens a ``SHORT``
share of the good ones at random, so that a short text isn't taken for a poor one. Scoring
covers every chunk of every text, of any length, in Arrow batches.

Defined cases: null and empty texts are scored as one chunk of zero bytes;
labels that are null are no labels; a document with several label rows counts
each; if a class has no labelled document, every score is the share of label 1
(0.5 without any label); extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, utf8

CHUNK, OVERLAP, DIM, WIDTH, STRIDE, FILTERS, HIDDEN = 512, 64, 8, 8, 4, 48, 24
SHORT = 0.1  # share of the good texts that a training pass shortens, so that short texts aren't taken for poor ones


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks of CHUNK bytes, zero-filled; first chunk of each text, and the end)."""
    step = CHUNK - OVERLAP
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - OVERLAP) // step))
    first = np.concatenate([[0], np.cumsum(n)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], n)
    start = np.repeat(offsets[:-1], n) + nth * step
    end = np.repeat(offsets[1:], n)
    at = start[:, None] + np.arange(CHUNK)
    inside = at < end[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8), first


@dataclass
class Network:
    """Weights; ``prior`` is the answer when there was nothing to learn from."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float | None = None

    @classmethod
    def random(cls, seed: int, prior: float | None = None) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            normal(256, DIM, scale=0.5), normal(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32),
            normal(3 * FILTERS, HIDDEN, scale=(3 * FILTERS) ** -0.5), np.zeros(HIDDEN, np.float32), normal(HIDDEN, 1, scale=HIDDEN**-0.5), np.zeros(1, np.float32), prior,
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def windows(self, pieces: np.ndarray) -> np.ndarray:
        """(chunk, place, WIDTH * DIM): the embedded bytes under each filter place."""
        x = self.embed[pieces].reshape(len(pieces), CHUNK // STRIDE, STRIDE * DIM)
        return np.concatenate([x[:, i : CHUNK // STRIDE - WIDTH // STRIDE + 1 + i] for i in range(WIDTH // STRIDE)], axis=2)

    def pooled(self, pieces: np.ndarray) -> np.ndarray:
        out = np.empty((len(pieces), FILTERS), np.float32)
        for a in range(0, len(pieces), 64):
            x = self.windows(pieces[a : a + 64])
            out[a : a + 64] = (x.reshape(-1, WIDTH * DIM) @ self.filters).reshape(len(x), -1, FILTERS).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def features(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        at = first[:-1]
        mean = np.add.reduceat(p, at) / np.diff(first)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(p, at), np.minimum.reduceat(p, at)], axis=1).astype(np.float32)

    def score(self, pieces: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(first) - 1, self.prior)
        h = np.tanh(self.features(self.pooled(pieces), first) @ self.hidden + self.hidden_bias)
        return 1 / (1 + np.exp(-(h @ self.out + self.out_bias)[:, 0].astype(np.float64)))

    def gradients(self, pieces: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n, docs = len(pieces), len(y)
        x = self.windows(pieces)
        answers = (x.reshape(-1, WIDTH * DIM) @ self.filters).reshape(n, -1, FILTERS)
        place = answers.argmax(axis=1)  # only the largest answer learns
        p = np.maximum(np.take_along_axis(answers, place[:, None, :], 1)[:, 0] + self.bias, 0)
        f = self.features(p, first)
        h = np.tanh(f @ self.hidden + self.hidden_bias)
        s = 1 / (1 + np.exp(-(h @ self.out + self.out_bias)[:, 0]))
        g_out = (((s - y) * weight) / docs).astype(np.float32)[:, None]
        g_h = (g_out @ self.out.T) * (1 - h * h)
        g_f = g_h @ self.hidden.T
        owner = np.repeat(np.arange(docs), np.diff(first))
        count = np.diff(first).astype(np.float32)[owner][:, None]
        mean, most, least = (g_f[:, i * FILTERS : (i + 1) * FILTERS][owner] for i in range(3))
        g_p = mean / count + most * (p == f[:, FILTERS : 2 * FILTERS][owner]) + least * (p == f[:, 2 * FILTERS :][owner])
        g_p *= p > 0
        under = np.take_along_axis(x, place[:, :, None], 1)  # (chunk, filter, WIDTH * DIM)
        g_filters = np.einsum("nf,nfd->df", g_p, under)
        g_x = (g_p[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
        at = (place * STRIDE)[:, :, None] + np.arange(WIDTH)
        byte = np.take_along_axis(pieces, at.reshape(n, -1), 1).ravel()
        g_embed = np.stack([np.bincount(byte, weights=g_x[:, d], minlength=256) for d in range(DIM)], axis=1)
        return [g_embed, g_filters, g_p.sum(0), f.T @ g_h, g_h.sum(0), h.T @ g_out, g_out.sum(0)]


def train(texts: list[np.ndarray], y: np.ndarray, *, epochs: int = 14, least_steps: int = 400, batch: int = 32, rate: float = 3e-3, seed: int = 8) -> Network:
    """``texts``: each document's chunks, (n, CHUNK) bytes; ``y``: 0 or 1."""
    if len(y) == 0 or y.min() == y.max():
        return Network.random(seed, prior=float(y.mean()) if len(y) else 0.5)
    net, rng = Network.random(seed), np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    step, steps = 0, max(least_steps, epochs * -(-len(y) // batch))
    while step < steps:
        order = rng.permutation(len(y))
        for a in range(0, len(y), batch):
            pick = order[a : a + batch]
            now_texts = [texts[i] for i in pick]
            for j in np.flatnonzero((y[pick] == 1) & (rng.random(len(pick)) < SHORT)):
                now_texts[j] = now_texts[j][:1].copy()
                now_texts[j][0, rng.integers(8, CHUNK // 3) :] = 0
            first = np.concatenate([[0], np.cumsum([len(t) for t in now_texts])])
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, (m, v) in zip(net.weights(), net.gradients(np.concatenate(now_texts), first, y[pick], weight[pick]), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _all_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (doc_id, label, text) -> (doc_id, label, chunks)."""
    for whole in batches:
        for batch in chunks(whole):
            pieces, first = cut(*utf8(batch.column("text")))
            out = [pieces[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
        max_docs: int = 1500, max_bytes: int = 1 << 17, seed: int = 8) -> Network:
    """A network for the 0/1 labels of ``labels`` (id, label)."""
    pool = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    chosen = [pool.where(f"label = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 x max_docs rows
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    sample = texts.join(chosen, "doc_id").select("doc_id", "label", "text")
    rows = sample.mapInArrow(_all_chunks, "doc_id long, label int, chunks binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.chunks))
    return train([np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in rows], np.array([r.label for r in rows], np.float32), seed=seed)


def _scorer(net: Network, columns: list[str], text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text_column):
                scores = net.score(*cut(*utf8(batch.column(text_column))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores)], [*columns, "score"])

    return run


def score(docs: DataFrame, net: Network, *, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default, but one named score) and
    score, the probability of label 1."""
    columns = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("score", F.lit(0.0)).schema
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, text_column])]).mapInArrow(_scorer(net, columns, text_column), schema)


def held_out(id_column: str = "doc_id") -> Column:
    """The quarter of all ids that is never learned from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2
