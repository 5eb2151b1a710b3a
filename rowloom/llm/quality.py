"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes, one learned weight for each place and byte, are laid over the whole document every STRIDE bytes. The
document is cut into overlapping chunks of two halves of HALF bytes each; rectified filter outputs are max-pooled over
each chunk, and the means and maxima over all chunks go through a logistic unit to one probability. Every byte of the
document counts, however long it is; memory is bounded by the pieces that are worked on at a time.

The network is trained on the driver from at most `per_class` labelled texts of each class, which a hash picks.

Rows that repeat come out as often as they come in, each with the same result; tables without rows give none; further
columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import map_arrow, picked, text_bytes

WIDTH, STRIDE, HALF, FILTERS = 8, 2, 256, 16
#: Bytes that are convolved at a time.
PIECE = 1 << 18


class Network:
    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.filters = random.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.trained = False

    def halves(self, text: bytes) -> np.ndarray:
        """Max-pooled filter outputs of each half chunk, rectified; windows may reach past a half's end."""
        data = np.frombuffer(text + bytes(WIDTH + (-len(text)) % HALF + (HALF if not text else 0)), np.uint8)
        n = max(HALF, len(text) + (-len(text)) % HALF)
        out = []
        for at in range(0, n, PIECE):
            size = min(PIECE, n - at)
            part = data[at : at + size + WIDTH]
            total = np.take(self.filters[0], part[0:size:STRIDE], axis=0)
            for k in range(1, WIDTH):
                total += np.take(self.filters[k], part[k : k + size : STRIDE], axis=0)
            out.append(total.reshape(-1, HALF // STRIDE, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.offset, 0)

    @staticmethod
    def features(halves: np.ndarray) -> np.ndarray:
        chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])

    def score(self, text: bytes) -> float:
        if not self.trained:
            return 0.5
        return float(1 / (1 + np.exp(-(self.features(self.halves(text)) @ self.out + self.bias[0]).astype(float))))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 8, batch: int = 24, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
        """Adam on the cross-entropy; both classes weigh the same."""
        labels_ = np.asarray(labels, np.float32)
        if not 0 < labels_.sum() < len(labels_):
            return self
        weight = np.where(labels_ == 1, 0.5 / labels_.mean(), 0.5 / (1 - labels_.mean()))
        random = np.random.default_rng(seed)
        params = [self.filters, self.offset, self.out, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = random.permutation(len(texts))
            for low in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                for k in order[low : low + batch]:
                    self._backward(texts[k], labels_[k], weight[k] / batch, grads)
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    g += decay * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.trained = True
        return self

    def _backward(self, text: bytes, label: float, weight: float, grads: list[np.ndarray]) -> None:
        data = np.frombuffer(text + bytes(WIDTH + (-len(text)) % HALF + (HALF if not text else 0)), np.uint8)
        n = len(data) - WIDTH
        total = np.take(self.filters[0], data[0:n:STRIDE], axis=0)
        for k in range(1, WIDTH):
            total += np.take(self.filters[k], data[k : k + n : STRIDE], axis=0)
        pooled = total.reshape(-1, HALF // STRIDE, FILTERS)
        where = pooled.argmax(axis=1)
        raw = np.take_along_axis(pooled, where[:, None, :], axis=1)[:, 0] + self.offset
        halves = np.maximum(raw, 0)
        pairs = np.stack([halves[:-1], halves[1:]]) if len(halves) > 1 else halves[None]
        left = pairs.argmax(axis=0)
        chunks = np.take_along_axis(pairs, left[None], axis=0)[0]
        top = chunks.argmax(axis=0)
        feats = np.concatenate([chunks.mean(axis=0), chunks[top, np.arange(FILTERS)]])
        error = weight * (1 / (1 + np.exp(-(feats @ self.out + self.bias[0]))) - label)
        grads[2] += error * feats
        grads[3] += error
        d_chunks = np.repeat((error * self.out[None, :FILTERS] / len(chunks)), len(chunks), axis=0)
        d_chunks[top, np.arange(FILTERS)] += error * self.out[FILTERS:]
        d_halves = np.zeros_like(halves)
        rows = np.arange(len(chunks))[:, None] + left
        np.add.at(d_halves, (rows, np.arange(FILTERS)[None, :]), d_chunks)
        d_halves *= raw > 0
        grads[1] += d_halves.sum(axis=0)
        at = (where + np.arange(len(halves))[:, None] * (HALF // STRIDE)) * STRIDE
        for k in range(WIDTH):
            np.add.at(grads[0][k], (data[at + k], np.arange(FILTERS)[None, :]), d_halves)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 700) -> Network:
    """labels: (doc_id, quality). A hash picks at most per_class labels of each class; their texts are used.

    Rows of null ids, of null or other labels are not. Without texts of both classes every score is 0.5. The picked labels
    are at most 2 * per_class rows, and so are broadcast.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = picked(known, "quality", F.xxhash64("doc_id"), "doc_id", per_class)
    rows = docs.select("doc_id", text_bytes(docs["text"]).alias("text")).join(F.broadcast(known), "doc_id").select("text", "quality").collect()
    rows.sort(key=lambda r: (bytes(r["text"]), r["quality"]))
    return Network().fit([bytes(r["text"]) for r in rows], [r["quality"] for r in rows])


def score(docs: DataFrame, network: Network, *more: Column) -> DataFrame:
    """(doc_id, more, score, predicted) for each row; null texts count as empty and are scored as such."""
    shipped = docs.sparkSession.sparkContext.broadcast(network)
    frame = docs.select("doc_id", *more, text_bytes(docs["text"]).alias("__text"))
    n = len(frame.columns) - 1
    names = [*frame.columns[:n], "score", "predicted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shipped.value
        for batch in batches:
            scores = np.array([net.score(t.as_py()) for t in batch.column(n)], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:n])
    return map_arrow(frame, work, f"{fields}, score double, predicted int")
