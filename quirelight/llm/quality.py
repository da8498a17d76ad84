"""Quality scores by a byte-level convolutional network in numpy.

Bytes become learned vectors; learned filters of WIDTH bytes slide by STEP bytes over chunks of CHUNK bytes, which
overlap by OVERLAP so that no window is lost at a chunk's end and every byte of a document is covered. A chunk's
filters are max-pooled; a document is the largest and the mean of its chunks' pools, which a small dense layer
combines into one probability. Training (Adam, backpropagation through the pooled windows) takes a bounded
sample of labelled rows (SAMPLE_ROWS, the rows with the smallest hash of doc_id), whole texts; scoring reads whole texts, in a pass without a shuffle. The model is some
20 kB, whatever the input.

Defined results: a null or empty text is one chunk of padding; repeated rows give repeated rows; rows without a
label are scored alike; a null label is no label; with no labelled row the untrained network scores; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import buffers_of, fold, prepare, slices, text_of

#: Labelled rows that training takes at most, with their whole texts.
SAMPLE_ROWS = 4000
EPOCHS = 5
BATCH = 32
RATE = 0.01
CHUNK, OVERLAP, WIDTH, STEP = 1024, 32, 16, 4
DIM, FILTERS, HIDDEN = 8, 24, 16
#: A score from which a text is predicted good; a fixed value.
THRESHOLD = 0.3
#: Bytes that the network works on at once.
WORK_BYTES = 1 << 18
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def chunk_starts(length: int) -> np.ndarray:
    """First bytes of the chunks that cover a text of this many bytes."""
    return np.arange(0, max(length - OVERLAP, 1), CHUNK - OVERLAP)


def chunk_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks as rows of CHUNK bytes; bytes past a text's end are 0."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class Network:
    """Parameters and the forward and backward passes."""

    NAMES = ("embed", "filters", "shift", "dense", "dense_shift", "out", "out_shift")

    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        self.embed = draw(0.5, 256, DIM)
        self.filters = draw((WIDTH * DIM) ** -0.5, WIDTH * DIM, FILTERS)
        self.shift = np.zeros(FILTERS, np.float32)
        self.dense = draw((2 * FILTERS) ** -0.5, 2 * FILTERS, HIDDEN)
        self.dense_shift = np.zeros(HIDDEN, np.float32)
        self.out = draw(HIDDEN**-0.5, HIDDEN)
        self.out_shift = np.zeros(1, np.float32)

    def pool(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filters of each chunk, and the window that gave each."""
        steps, per = CHUNK // STEP, WIDTH // STEP
        blocks = self.embed[chunks].reshape(len(chunks), steps, STEP * DIM)
        total = None
        for k in range(per):
            part = blocks[:, k : steps - per + 1 + k] @ self.filters[k * STEP * DIM : (k + 1) * STEP * DIM]
            total = part if total is None else np.add(total, part, out=total)
        top = np.maximum(total.max(axis=1) + self.shift, 0)
        return top, total.argmax(axis=1) if where else None

    def combine(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of documents whose chunks start at first; with the layers' values."""
        counts = np.diff(np.append(first, len(pooled)))
        feats = np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / counts[:, None]], axis=1)
        hidden = np.maximum(feats @ self.dense + self.dense_shift, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_shift[0], -30, 30))), feats, hidden, counts

    def gradients(self, chunks: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        pooled, at = self.pool(chunks, where=True)
        p, feats, hidden, counts = self.combine(pooled, first)
        d = ((p - labels) / len(labels)).astype(np.float32)
        g = {"out": hidden.T @ d, "out_shift": np.array([d.sum()], np.float32)}
        dh = np.where(hidden > 0, d[:, None] * self.out, 0)
        g["dense"], g["dense_shift"] = feats.T @ dh, dh.sum(axis=0)
        df = dh @ self.dense.T
        doc = np.repeat(np.arange(len(first)), counts)
        largest = pooled == feats[doc, :FILTERS]
        dp = largest * df[doc, :FILTERS] + df[doc, FILTERS:] / counts[doc][:, None]
        dp = np.where(pooled > 0, dp, 0).astype(np.float32)
        g["shift"] = dp.sum(axis=0)
        window = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] * STEP + np.arange(WIDTH)]
        vectors = self.embed[window].reshape(len(chunks), FILTERS, WIDTH * DIM)
        g["filters"] = np.einsum("cfw,cf->wf", vectors, dp)
        back = (dp[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
        g["embed"] = np.zeros_like(self.embed)
        flat = window.reshape(-1)
        for k in range(DIM):
            g["embed"][:, k] = np.bincount(flat, weights=back[:, k], minlength=256)
        return g


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Network:
    """A network from (chunks, label) pairs; their order is seeded."""
    net = Network()
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in net.NAMES}
    t = 0
    for epoch in range(epochs if examples else 0):
        order = np.random.default_rng(epoch).permutation(len(examples))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            part = [examples[i] for i in order[at : at + BATCH]]
            first = np.cumsum([0, *[len(c) for c, _ in part[:-1]]])
            g = net.gradients(np.concatenate([c for c, _ in part]), first, np.array([y for _, y in part], np.float32))
            t += 1
            for n in net.NAMES:
                m, v = moments[n]
                m += 0.1 * (g[n] - m)
                v += 0.001 * (g[n] * g[n] - v)
                getattr(net, n)[...] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS) -> Network:
    prepare(docs.sparkSession)
    keys = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    keys = keys.filter(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers_of(batch.column(2))
            out = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                starts = chunk_starts(int(b - a))
                out.append(chunk_bytes(data, starts + a, np.full(len(starts), b)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "chunks"])

    # the keys are at most sample_rows rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(keys), "doc_id")
    texts = texts.select("doc_id", "label", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = texts.mapInArrow(run, "doc_id long, label int, chunks binary").collect()
    examples = [(np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK), r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunks"]))]
    return fit(examples)


def score_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of the whole texts data[offsets[i]:offsets[i+1]]; a text of any length is taken in pieces."""
    starts = [chunk_starts(int(n)) for n in np.diff(offsets)]
    counts = np.array([len(s) for s in starts])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.concatenate(starts) + np.repeat(offsets[:-1], counts)
    ends = np.repeat(offsets[1:], counts)
    n = WORK_BYTES // CHUNK
    pooled = [net.pool(chunk_bytes(data, at[i : i + n], ends[i : i + n]))[0] for i in range(0, len(at), n)]
    return net.combine(np.concatenate(pooled), first)[0]


def score(docs: DataFrame, net: Network, held_out: Column) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers_of(batch.column(2))
            found = [np.zeros(0)]
            for a, b in slices(offsets):
                found.append(score_texts(shipped.value, data, offsets[a : b + 1]))
            p = np.concatenate(found).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document, learned from labelled rows outside the held-out fold."""
    held_out = fold("doc_id", 5) == 0
    return score(docs, train(docs, labels, ~held_out), held_out)
