"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z lower-cased. Features of a text are the distinct hashed words, word
pairs and pairs with one word between them. FTRL-proximal
keeps a learning rate for each coordinate and an L1 penalty leaves most weights at zero, so the weights that
are broadcast are a sparse list, at most 2**HASH_BITS of them. Training takes a bounded sample of labelled rows
(SAMPLE_ROWS, the rows with the smallest hash of doc_id); scoring reads whole texts in a pass without a shuffle.

Defined results: a null or empty text has no feature and gets the score of the bias; repeated rows give repeated
rows; rows without a label are scored alike; a null label is no label; with no labelled row every score is the
bias 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import PUNCTUATION, buffers_of, fold, lean, packed, prepare, rows_of, slices, splitmix, text_of, word_hashes

#: Labelled rows that training takes at most.
SAMPLE_ROWS = 7_000
HASH_BITS = 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: A score from which a text is predicted toxic; a fixed value.
THRESHOLD = 0.3
_MASK = np.uint64((1 << HASH_BITS) - 1)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def gram_slots(words: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs and skip pairs: the slot of each and the word position that starts it."""
    rows = rows_of(offsets)
    out = [(splitmix(words) & _MASK, rows)]
    for skip in (1, 2):
        if len(words) > skip:
            same = rows[skip:] == rows[:-skip]
            pair = splitmix(words[:-skip] + np.uint64(skip) * splitmix(words[skip:] ^ np.uint64(0xA5A5 + skip)))
            out.append(((pair & _MASK)[same], rows[:-skip][same]))
    return [(slots.astype(np.int64), rows) for slots, rows in out]


def packed_slots(slots: np.ndarray) -> bytes:
    """Slots in order, for the way to the driver: how many bytes their gaps take, then those, byte by byte of four, compressed."""
    raw = np.diff(slots, prepend=0).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_slots(held: bytes) -> bytes:
    """The slots as uint32 bytes."""
    raw = np.frombuffer(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd"), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4"), dtype=np.uint32).astype("<u4").tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, distinct slots: the gaps between them as uint32 bytes, compressed)."""
    for batch in batches:
        data, offsets = buffers_of(batch.column(1))
        out = []
        for i in range(batch.num_rows):
            words, counts = word_hashes(data, offsets[i : i + 2], PUNCTUATION)
            out.append(packed_slots(np.unique(np.concatenate([s for s, _ in gram_slots(words, counts)]))))
        yield pa.RecordBatch.from_arrays([batch.column(0), packed(out)], ["label", "slots"])


class Ftrl:
    """FTRL-proximal logistic regression with per-coordinate rates; the last coordinate is the bias."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> float:
        at = np.append(at.astype(np.int64), len(self.z) - 1)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        return p


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias, from at most sample_rows labelled rows."""
    prepare(docs.sparkSession)
    keys = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    keys = keys.filter(usable).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # the keys are at most sample_rows rows
    sample = texts.join(F.broadcast(keys), "doc_id").select("label", "text", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # what is collected is compressed; unpacked, the examples have four bytes for each distinct slot of a sampled text
    examples = sorted((unpacked_slots(bytes(r["slots"])), r["label"]) for r in sample.select("label", "text").mapInArrow(lean(_features), "label int, slots binary").collect())
    examples = [(np.frombuffer(s, "<u4"), y) for s, y in examples]
    model = Ftrl(1 << HASH_BITS)
    for epoch in range(EPOCHS if examples else 0):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[i])
    weights = model.weights(np.arange(len(model.z)))
    slots = np.flatnonzero(weights[:-1])
    return slots.astype(np.uint32), weights[slots].astype(np.float32), float(weights[-1])


def score_slots(words: np.ndarray, offsets: np.ndarray, dense: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(offsets) - 1, bias)
    hit_slots, hit_rows = [], []
    for slots, rows in gram_slots(words, offsets):
        keep = np.flatnonzero(dense[slots])
        hit_slots.append(slots[keep])
        hit_rows.append(rows[keep])
    key = np.unique((np.concatenate(hit_rows) << HASH_BITS) | np.concatenate(hit_slots))
    np.add.at(total, key >> HASH_BITS, dense[key & ((1 << HASH_BITS) - 1)])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = shipped.value
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[slots] = weights
        for batch in batches:
            data, offsets = buffers_of(batch.column(2))
            found = [np.zeros(0)]
            for a, b in slices(offsets):
                found.append(score_slots(*word_hashes(data, offsets[a : b + 1], PUNCTUATION), dense, bias))
            p = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), text_of().alias("text")).mapInArrow(lean(run), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every document, learned from labelled rows outside the held-out fold."""
    held_out = fold("doc_id", 4) == 2
    return score(docs, train(docs, labels, "toxic", ~held_out), held_out)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, all columns as they are; learned as in toxicity(), in a pass without a shuffle."""
    spark = docs.sparkSession
    model = train(docs, labels, "toxic", fold("doc_id", 4) != 2)
    if not len(model[0]) and model[2] == 0:
        return docs  # nothing was learned, so nothing is rejected
    shipped = spark.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = shipped.value
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[slots] = weights
        for batch in batches:
            data, offsets = buffers_of(batch.column(text))
            found = [np.zeros(0)]
            for a, b in slices(offsets):
                found.append(score_slots(*word_hashes(data, offsets[a : b + 1], PUNCTUATION), dense, bias))
            yield batch.filter(pa.array(np.concatenate(found) < THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)
